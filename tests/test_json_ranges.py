"""JSON documents by ranges against json.loads, and round trips of the writers."""

import json
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirewise.plans.storage import shared_dir
from quirewise.sources import json_ranges as R
from quirewise.sources import json_tables as J


@pytest.fixture
def splits(spark):
    """Files are cut every 700 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def texts(rng, n):
    signs = ['"', "\\", ",", "[", "]", "{", "}", ":", "漢", "é", "\n", " ", "a", "b", "\\\"", '",', "},{", "\t", "😀"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def write(folder, name, value, **how):
    (folder / name).mkdir(parents=True, exist_ok=True)
    (folder / name / "x.json").write_text(json.dumps(value, **how), encoding="utf-8")


@pytest.mark.parametrize("how", [{}, {"indent": 1, "ensure_ascii": False}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_elements_of_any_split(spark, splits, tmp_path, how):
    rng = random.Random(5)
    lists = [{"t": t, "deep": [[1, [2, {"x": t}]], {}]} for t in texts(rng, 120)]
    maps = {str(i): {"col": [t, t[:5]], "full": t} for i, t in enumerate(texts(rng, 150))}
    legacy = {str(i): t for i, t in enumerate(texts(rng, 200))}
    huge = [{"t": ",".join(texts(rng, 200))}, {"t": 1}, [1, 2], "s", None, 3.5]
    books = {"lists": lists, "maps": maps, "legacy": legacy, "huge": huge, "none": [], "blank": {}, "one": [7], "a b+c%": [1, 2]}
    for name, value in books.items():
        write(tmp_path, name, value, **how)
    found = {}
    for r in R.elements(spark, f"{tmp_path}/*/*.json").collect():
        found.setdefault(r["book_id"], {})[r["seq"]] = json.loads(r["json"])
    assert R.pieces(spark, f"{tmp_path}/huge/*.json").select("split").distinct().count() > 5
    for name, value in books.items():
        rows = found.get(name, {})
        assert sorted(rows) == list(range(len(value))), name
        want = [[v] for v in value] if isinstance(value, list) else [{k: v} for k, v in value.items()]
        assert [rows[i] for i in range(len(value))] == want, name


def test_readers_over_elements_equal_readers_over_whole_files(spark, splits, tmp_path):
    rng = random.Random(6)
    strips = {str(i): ({"col": [t, "x"], "full": t} if i % 3 else t or "-") for i, t in enumerate(texts(rng, 90))}
    layout = [{"page": i % 40, "layout": "2-up", "cuts": [[0.0, 0.5 + i / 1000], [0.5, 1.0]]} for i in range(60)]
    exams = [{"start": i, "end": i + 1, "title": t, "segments": [[i, 0], [i, 1]]} for i, t in enumerate(texts(rng, 50))]
    manifest = [{"index": i + 1, "name": t, "file": f"{i}.pdf", "src_start": i} for i, t in enumerate(texts(rng, 50))]
    cases = [
        (strips, lambda d: J.read_strips(d)),
        (layout, lambda d: J.read_layout(d)),
        (exams, lambda d: J.read_exam_sets(d)[0]),
        (exams, lambda d: J.read_exam_sets(d)[1]),
        (manifest, lambda d: J.read_manifest(d)),
        ({str(i): "3-up" for i in range(300)}, lambda d: J.read_layout_overrides(d)),
        ({str(i): [t, None, "2027"] for i, t in enumerate(texts(rng, 50))}, lambda d: J.read_title_overrides(d)),
    ]
    for n, (value, read) in enumerate(cases):
        write(tmp_path, f"c{n}/book", value, ensure_ascii=n % 2 == 0, indent=n % 3 or None)
        path = f"{tmp_path}/c{n}/*/*.json"
        whole = Counter(map(str, read(J.read_json_texts(spark, path)).collect()))
        assert Counter(map(str, read(R.elements(spark, path)).collect())) == whole and whole


def test_round_trips(spark, splits, tmp_path):
    rng = random.Random(7)
    books = ["b 1", "汉/字", "x+y=%z"]
    titles = texts(rng, 30)
    exam = spark.createDataFrame(
        [(b, i, i, i + 2, None, t, "2026", t) for b in books for i, t in enumerate(titles, 1)],
        "book_id string, idx int, start int, end int, school string, branch string, year string, title string",
    )
    segments = spark.createDataFrame([(b, i, s, i + s, s % 2) for b in books for i in range(1, 31) for s in range(1, i % 4 + 1)], "book_id string, idx int, seq int, page int, col int")
    path = str(tmp_path / "exams")
    for _ in range(2):  # written again, the table is the same
        R.write_exam_sets(exam, segments, path, part_rows=8)
    got, segs = J.read_exam_sets(R.elements(spark, path))
    assert Counter(map(tuple, got.select(*exam.columns).collect())) == Counter(map(tuple, exam.collect()))
    assert Counter(map(tuple, segs.select(*segments.columns).collect())) == Counter(map(tuple, segments.collect()))
    files = spark.read.text(path, wholetext=True).collect()
    assert len(files) == 3 * 4 and all(isinstance(json.loads(f["value"]), list) for f in files)

    man = exam.selectExpr("book_id", "idx AS index", "'n' || idx AS name", "title AS file", "start AS src_start", "end AS src_end", "3 AS pdf_pages", "school", "branch", "year")
    man = man.withColumn("file", F.when(F.col("file") == "", F.lit("f")).otherwise(F.col("file")))
    R.write_manifest(man, str(tmp_path / "man"))
    again = J.read_manifest(R.elements(spark, str(tmp_path / "man")))
    assert Counter(map(tuple, again.select(*man.columns).collect())) == Counter(map(tuple, man.collect()))

    strips = spark.createDataFrame([(b, p * 7, [t, "é"], t) for b in books for p, t in enumerate(titles)], "book_id string, page int, cols array<string>, full string")
    R.write_strips(strips, str(tmp_path / "strips"), part_rows=50)
    again = J.read_strips(R.elements(spark, str(tmp_path / "strips")))
    assert Counter(map(str, again.select(*strips.columns).collect())) == Counter(map(str, strips.collect()))


def test_texts_are_stored_once(spark, tmp_path):
    """Beside the files there are neither stage tables nor shuffle files of their texts."""

    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {n: os.path.getsize(n) for n in names if "/shuffle_" in n and os.path.exists(n)}

    def stored(folder):
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)

    rng = random.Random(8)
    rows = [("b", i, i, i, None, None, None, ", ".join(rng.randbytes(30).hex() for _ in range(60))) for i in range(400)]
    exam = spark.createDataFrame(rows, "book_id string, idx int, start int, end int, school string, branch string, year string, title string")
    segments = spark.createDataFrame([("b", i, 1, i, 0) for i in range(400)], "book_id string, idx int, seq int, page int, col int")
    before, path = shuffled(), str(tmp_path / "exams")
    R.write_exam_sets(exam.repartition(2), segments, path, part_rows=100)
    for _ in range(100):  # the files are removed in the background
        if not (left := shuffled().keys() - before.keys()):
            break
        time.sleep(0.1)
    assert not left
    written = stored(path)
    assert written > 1_000_000
    stages = shared_dir(spark).removeprefix("file:")
    had = stored(stages)
    found = R.elements(spark, path).select("seq", F.get_json_object(F.expr("substring(json, 2, length(json) - 2)"), "$.title").alias("title"))
    assert {(r["seq"], r["title"]) for r in found.collect()} == {(r[1], r[-1]) for r in rows}
    assert stored(stages) - had < written / 10
    assert sum(size for name, size in shuffled().items() if name not in before) < written / 10


def test_segments_meet_the_exams_of_their_number(spark, tmp_path):
    plain = "start int, end int, school string, branch string, year string, title string"
    exam = [("b", 1, "x"), ("b", 1, "y"), (None, 1, "n"), (None, 2, "m"), ("c", 9, "z")]
    exam = spark.createDataFrame([(b, i, i, i, None, None, None, t) for b, i, t in exam], f"book_id string, idx int, {plain}")
    segments = [("b", 1, 2, 8, 1), ("b", 1, 1, 7, 0), (None, 1, 1, 5, 0), ("b", 2, 1, 6, 0), ("c", None, 1, 4, 0), ("gone", 9, 1, 3, 0)]
    segments = spark.createDataFrame(segments, "book_id string, idx int, seq int, page int, col int")
    R.write_exam_sets(exam, segments, str(tmp_path / "x"), part_rows=4)
    got = {}
    for r in R.elements(spark, str(tmp_path / "x")).collect():
        (one,) = json.loads(r["json"])
        got[r["book_id"], one["title"]] = one["segments"]
    assert got == {("b", "x"): [[7, 0], [8, 1]], ("b", "y"): [[7, 0], [8, 1]], (None, "n"): [[5, 0]], (None, "m"): [], ("c", "z"): []}


def test_no_files_with_elements(spark, tmp_path):
    write(tmp_path, "a", [])
    assert R.elements(spark, str(tmp_path)).count() == 0


def test_pieces_of_prose_are_not_searched_by_patterns(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('[{"a": "one, two [three, four\\" five", "b": [1, 2]}, "]"]')
    rows = R.pieces(spark, str(tmp_path / "b"))
    got = [(r.piece, r.quotes, r.outside, r.inside) for r in rows.orderBy("n").collect()]
    assert got == [
        ('[{"a": "one', 3, 2, 0), (" two [three", 0, 1, 0), (' four\\" five"', 1, 0, 0), (' "b": [1', 2, 1, 0), (" 2]}", 0, -2, 0), (' "]"]', 2, -1, -1),
    ]
    # The dear patterns stand behind tests of bytes.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(piece#" in plan and "(quotes#" in plan
