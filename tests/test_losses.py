"""Rows that used to vanish: null orders and groups, queued runs, doubled overrides, unreadable replies."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirewise.operators import layout, ordered, output, runs, segments, subpages
from quirewise.sources import json_tables as J
from quirewise.sources import replies
from quirewise.streaming.arrivals import stream_books


def test_null_order_and_group_stay(spark):
    rows = [("a", 1, "x"), ("a", 2, None), (None, 5, "y"), (None, 6, None), ("a", None, "n")]
    df = spark.createDataFrame(rows, "g string, o long, v string")
    got = {(r.g, r.o): r.c for r in ordered.carry_forward(df, ["g"], "o", "v", "c").collect()}
    assert got == {("a", None): None, ("a", 1): "n", ("a", 2): "x", (None, 5): None, (None, 6): "y"}
    ranks = {(r.g, r.o): r.k for r in ordered.rank_in_group(df, ["g"], "o", "k").collect()}
    assert ranks == {("a", None): 1, ("a", 1): 2, ("a", 2): 3, (None, 5): 1, (None, 6): 2}


def test_queued_runs_count(spark):
    batch = spark.createDataFrame([("b", "r1"), ("b", "r2"), ("b", "gone")], "batch_id string, run_id string")
    schema = "run_id string, status string, progress double, summary_exams long, summary_pages long"
    states = spark.createDataFrame([("r1", "running", 8.0, None, None)], schema)
    registry = spark.createDataFrame([Row(run_id="r1"), Row(run_id="r2")])
    r = runs.batch_rollup(batch, states, registry).head()
    assert (r.total, r.queued, r.running, r.percent) == (2, 1, 1, 4)


def test_log_tail_beyond_a_thousand(spark):
    log = spark.range(4000).selectExpr("'r' AS run_id", "id AS seq", "'l' AS line")
    seqs = {r.seq for r in runs.log_tail(log, 1500).collect()}
    assert seqs == set(range(2500, 4000))


def test_first_exams_per_book(spark):
    man = spark.createDataFrame([("a", i) for i in range(1, 7)] + [("b", i) for i in range(7, 13)], "book_id string, index int")
    got = sorted((r.book_id, r["index"]) for r in output.first_exams(man).collect())
    assert got == [("a", i) for i in range(1, 5)] + [("b", i) for i in range(7, 11)]


def test_last_title_override_wins(spark):
    key = "struct<school:string,branch:string,year:string,title:string,volume:boolean>"
    sub = spark.createDataFrame([("a", 1, 0, None, True, True)], f"book_id string, page int, col int, key {key}, is_answer boolean, is_toc boolean")
    ov = spark.createDataFrame([("a", 1, "s", None, None, "old", 1), ("a", 1, "s", None, None, "new", 2)], "book_id string, page int, school string, branch string, year string, title string, seq int")
    rows = subpages.apply_title_overrides(sub, ov).collect()
    assert [r.key.title for r in rows] == ["new"]


def test_unknown_pages_are_all_named(spark):
    known = spark.createDataFrame([("a", 1, "1-up")], "book_id string, page int, layout string").withColumn("cuts", layout.default_cuts(__import__("pyspark").sql.functions.lit("1-up")))
    ov = spark.createDataFrame([("a", p, "2-up") for p in range(2, 42)], "book_id string, page int, layout string")
    with pytest.raises(ValueError, match="40 overrides.*a:41"):
        layout.apply_layout_overrides(known, ov, on_unknown="fail")


def test_unreadable_replies(spark):
    df = spark.createDataFrame([(1, "no list", None), (2, '[{"orig":"a","fixed":"b","conf":"high"}]', None)], "batch int, content string, reasoning string")
    assert [r.batch for r in replies.unreadable_replies(df).collect()] == [1]


def test_emptied_book_is_cleared(spark, tmp_path):
    path, schema = str(tmp_path / "books"), "book_id string, page int, v string"
    J.replace_books(spark.createDataFrame([("a", 1, "x"), ("b", 1, "z")], schema), path, buckets=1)
    books = spark.createDataFrame([("a",)], "book_id string")
    J.replace_books(spark.createDataFrame([], schema), path, books=books, buckets=1)
    assert [r.book_id for r in J.read_books(spark, path, schema).collect()] == ["b"]


def test_book_in_two_files(spark, tmp_path):
    schema = "book_id string, page int, cols array<string>, full string"
    for i in (1, 2):
        rows = [("a", i, [f"t{i}"], ""), (f"only{i}", 1, ["t"], "")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    split = lambda pages: pages.selectExpr("book_id", "page AS index")
    stream_books(texts, split, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    got = J.read_books(spark, str(tmp_path / "out"), "index int, book_id string").collect()
    assert sorted((r.book_id, r["index"]) for r in got) == [("a", 1), ("a", 2), ("only1", 1), ("only2", 1)]


def test_unplaced_segments(spark):
    segs = spark.createDataFrame([("a", 1, 1, 1, 0), ("a", 1, 2, 1, 2), ("a", 1, 3, 9, 0)], "book_id string, idx int, seq int, page int, col int")
    pages = spark.createDataFrame([("a", 1, 600.0, 800.0)], "book_id string, page int, width double, height double")
    lay = spark.createDataFrame([], "book_id string, page int, layout string, cuts array<struct<x0:double,x1:double>>")
    assert [r.out_page for r in output.slice_plan(segs, lay, pages).collect()] == [1]
    assert {(r.seq, r.reason) for r in output.unplaced_segments(segs, lay, pages).collect()} == {(2, "no window"), (3, "no page size")}


def test_two_layouts_for_a_page_without_an_order_stop_the_query(spark):
    known = spark.createDataFrame([("b", 1, "2-up", None)], f"book_id string, page long, layout string, cuts {layout.CUTS_TYPE}")
    twice = spark.createDataFrame([("b", 1, "1-up"), ("b", 1, " 1-up")], "book_id string, page long, layout string")
    assert layout.apply_layout_overrides(known, twice).head()["layout"] == "1-up"
    odd = twice.unionByName(spark.createDataFrame([("b", 1, "3-up")], twice.schema))
    with pytest.raises(Exception, match="several layouts"):
        layout.apply_layout_overrides(known, odd).collect()
    ordered = odd.withColumn("seq", F.when(F.col("layout") == "3-up", 2).otherwise(1))
    assert layout.apply_layout_overrides(known, ordered).head()["layout"] == "3-up"


def test_many_unknown_pages_are_counted_and_written(spark, monkeypatch):
    monkeypatch.setattr(layout, "NAMED", 3)
    known = spark.createDataFrame([("b", 1, "2-up", None)], f"book_id string, page long, layout string, cuts {layout.CUTS_TYPE}")
    ov = spark.range(2, 12).selectExpr("'b' AS book_id", "id AS page", "'1-up' AS layout")
    with pytest.raises(ValueError) as raised:
        layout.apply_layout_overrides(known, ov, on_unknown="fail")
    text = str(raised.value)
    assert text.startswith("10 overrides") and "b:2, b:3, b:4 and others" in text
    assert spark.read.parquet(text.rsplit(" in ", 1)[1]).count() == 10


def test_pages_without_a_book_are_segmented(spark):
    key = "struct<school:string,branch:string,year:string,title:string,volume:boolean>"
    rows = [(b, p, 0, ("S", None, "2026", "T", False) if p == 1 else None, False, False) for b in ("b", None) for p in (1, 2)]
    df = spark.createDataFrame(rows, f"book_id string, page long, col int, key {key}, is_answer boolean, is_toc boolean")
    got = {(r["book_id"], r["page"]): (r["idx"], r["seq"]) for r in segments.segment_columns(df).collect()}
    assert got == {(b, p): (1, p) for b in ("b", None) for p in (1, 2)}
