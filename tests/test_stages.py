"""Output, corrections, runs, JSON files, listings, streams and the whole run."""

import dataclasses
import json

from pyspark.sql import functions as F

from quirewise.operators import corrections as C
from quirewise.operators import output as O
from quirewise.operators import runs as R
from quirewise.plans import collection
from quirewise.plans.storage import materialize, shared_dir
from quirewise.sources import json_tables as J
from quirewise.sources import listing
from quirewise.sources.replies import read_replies, rejected_entries, unreadable_replies
from quirewise.streaming import progress

A = "成都某嘉祥外国语学校初2026届新初一分班真卷数学"
B = "成都某七中育才学校初2026届新初一分班真卷数学"
LOG = "run_id string, seq long, line string, exit_code int"


def test_render_cap(one, spark):
    df = spark.createDataFrame([(600.0, 842.0), (7200.0, 842.0)], "w double, h double")
    got = [r["s"] for r in df.select(O.render_scale(F.col("w"), F.col("h"), 250).alias("s")).collect()]
    assert got == [250 / 72, 10000 / 7200]


def test_strict_names_are_unique(spark):
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate(["X", "X", "X(2)", "Y"], 1)], "book_id string, idx int, name string")
    simple = [r["name"] for r in O.unique_names(df, "name", "idx").orderBy("idx").collect()]
    strict = [r["name"] for r in O.unique_names(df, "name", "idx", "strict").orderBy("idx").collect()]
    assert simple == ["X", "X(2)", "X(2)", "Y"]
    assert strict == ["X", "X(2)", "X(2) #3", "Y"]


def test_replies(spark):
    rows = [
        (1, 'text [{"orig":"a","fixed":"b [x]","conf":"low"}] and [more]', ""),
        (2, "", 'because [{"orig":"c","fixed":"d","conf":"high"}]'),
        (3, "nothing", None),
        (4, '```json\n[{"orig":"e","fixed":"f"}]\n```', None),
    ]
    df = spark.createDataFrame(rows, "batch int, content string, reasoning string")
    got = {r["batch"]: (r["orig"], r["fixed"], r["conf"]) for r in read_replies(df).collect()}
    assert got == {1: ("a", "b [x]", "low"), 2: ("c", "d", "high"), 4: ("e", "f", None)}


def test_reply_arrays_are_balanced_outside_strings(spark):
    texts = {
        1: 'I read [{"orig": "a ] \\" [", "fixed": "b [1"}, {"orig": "c", "fixed": "}]"}] and later ["x"]',
        2: '[{"orig": "a", "notes": [[1, 2], ["]"]]}, {"fixed": "no title"}, "text", null, 5, ["z"], {"orig": null}]',
        3: 'She said "this [ is" odd',
        4: "open [1, 2",
        5: "```\n[]\n```",
        6: 'quote " before [{"orig":"q"}] after',
        7: None,
        8: "no [brackets] that hold titles",
    }
    df = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "batch int, content string, reasoning string")
    got = [(r["batch"], r["pos"], r["orig"], r["fixed"]) for r in read_replies(df).orderBy("batch", "pos").collect()]
    assert got == [(1, 0, 'a ] " [', "b [1"), (1, 1, "c", "}]"), (2, 0, "a", None), (6, 0, "q", None)]
    rejected = [(r["batch"], r["pos"], r["item"]) for r in rejected_entries(df).orderBy("batch", "pos").collect()]
    assert [r[:2] for r in rejected] == [(2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6)]
    assert rejected[0][2] == '{"fixed":"no title"}' and rejected[2][2] is None
    assert {r["batch"] for r in unreadable_replies(df).collect()} == {3, 4, 7, 8}


def test_request_batches(spark):
    df = spark.createDataFrame([("b", i, f"t{i}") for i in range(1, 9)], "book_id string, index int, name string")
    got = C.request_batches(df).orderBy("batch").collect()
    assert [r["n_titles"] for r in got] == [6, 2]
    assert got[1]["request"] == "1. t7\n2. t8"


def test_run_states(spark):
    rows = [
        ("r", 1, "== Stage 1: layout ==", None),
        ("r", 2, "  ocr done 5/10", None),
        ("r", 3, "=== TOTAL EXAMS: 7 ===", None),
        ("r", 4, "[ 1/12] x.pdf  (src p1-2, 3 pages)", None),
        ("r", 5, "", 0),
        ("s", 1, "DONE. 3 exam PDFs, 9 total pages -> /o", None),
        ("s", 2, "", 2),
        ("q", 1, "hello", None),
    ]
    got = {r["run_id"]: r for r in R.run_states(spark.createDataFrame(rows, LOG)).collect()}
    assert (got["r"]["status"], got["r"]["summary_exams"], got["r"]["summary_pages"]) == ("done", 7, None)
    assert abs(got["r"]["progress"] - (85 + 13 / 12)) < 1e-9
    assert (got["s"]["status"], got["s"]["summary_pages"]) == ("error", 9)
    assert "2" in got["s"]["error"]
    assert (got["q"]["status"], got["q"]["progress"]) == ("running", 0.0)


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    log = [("r%d" % (i % 3), i, f"  ocr done {i}/40", None if i < 39 else 0) for i in range(40)]
    src = str(tmp_path / "log")
    df = spark.createDataFrame(log, LOG)
    for lo in (0, 15, 30):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 15)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "states")
    progress.write_states(stream, out, str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in progress.current_states(spark, out).collect()}
    assert got == {tuple(r) for r in R.run_states(df).collect()}


def test_json_files_round_trip(spark, tmp_path):
    book = tmp_path / "bookA"
    book.mkdir()
    strips = {"3": {"col": ["a", "b"], "full": "f"}, "10": "bare"}
    (book / "strips.json").write_text(json.dumps(strips), encoding="utf-8")
    (book / "layout.json").write_text('{"3": "3-up", "10": "odd"}', encoding="utf-8")
    got = J.read_strips(J.read_json_texts(spark, str(book / "strips.json"))).orderBy("page").collect()
    assert [(r["book_id"], r["page"], r["cols"], r["full"]) for r in got] == [
        ("bookA", 3, ["a", "b"], "f"), ("bookA", 10, ["bare"], "")
    ]
    lay = J.read_layout(J.read_json_texts(spark, str(book / "layout.json"))).orderBy("page").collect()
    assert [len(r["cuts"]) for r in lay] == [3, 2]


def test_replacing_one_book_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "books")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 9000, "y"), ("b", 1, "z")], "book_id string, page int, v string")
    J.replace_books(df, path, fmt="json")
    J.replace_books(df.filter("book_id = 'a' AND page = 1").withColumn("v", F.lit("new")), path, fmt="json")
    got = J.read_books(spark, path, "page int, v string, book_id string", fmt="json").collect()
    assert {tuple(r) for r in got} == {(1, "new", "a"), (1, "z", "b")}


def test_listing_reads_documents_only(spark, tmp_path):
    for name in ("one.pdf", "TWO.PDF", "note.txt"):
        (tmp_path / name).write_bytes(b"x" * 5)
    got = listing.list_collections(spark, str(tmp_path)).collect()
    assert {(r["name"], r["size"]) for r in got} == {("one.pdf", 5), ("TWO.PDF", 5)}


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _inputs(spark):
    strips = spark.createDataFrame(
        [
            ("b", 1, [A + "\n1.题", "2.题"], ""),
            ("b", 2, ["3.题", "4.题"], ""),
            ("b", 3, [B, "5.题"], ""),
            ("b", 4, ["参考答案", ""], ""),
        ],
        "book_id string, page int, cols array<string>, full string",
    )
    pages = strips.select("book_id", "page", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    lay = strips.select("book_id", "page", F.lit("2-up").alias("layout")).withColumn(
        "cuts", F.lit(None).cast("array<struct<x0:double,x1:double>>")
    )
    return collection.Inputs(strips, pages, layout=lay)


def test_whole_run_and_recompute(spark):
    given = _inputs(spark)
    result = collection.split_collections(given, keep=materialize)
    man = {r["index"]: r for r in result.manifest.collect()}
    assert {i: (r["name"], r["src_start"], r["src_end"], r["pdf_pages"]) for i, r in man.items()} == {
        1: (A, 1, 2, 4), 2: (B, 3, 3, 2)
    }
    assert [tuple(r) for r in collection.summary(result).collect()] == [("b", 2, 6)]
    fixes = spark.createDataFrame([("b", 2, "1-up")], "book_id string, page int, layout string")
    again = spark.createDataFrame([("b", 2, ["3.题 4.题"], "")], given.page_strip.schema)
    redone = collection.recompute(given, fixes, again, keep=materialize)
    man = {r["index"]: r["pdf_pages"] for r in redone.manifest.collect()}
    assert man == {1: 3, 2: 2}
    known = dataclasses.replace(given, detected=result.detected)
    quick = collection.recompute(known, fixes, again, keep=materialize)
    assert {tuple(r) for r in quick.manifest.collect()} == {tuple(r) for r in redone.manifest.collect()}
    work = collection.reread_worklist(given.layout, given.pages, fixes).collect()
    assert [(r["page"], r["col"]) for r in work] == [(2, 0)]
