"""Segmentation against a plain sequential scan, with blocks small enough to cross."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirewise.operators import ordered, segments

SUB = (
    "book_id string, page int, col int, "
    "key struct<school:string,branch:string,year:string,title:string,volume:boolean>, "
    "is_answer boolean, is_toc boolean"
)


def _sequential(rows):
    """rows in order -> [(idx, seq, page, col)]"""
    out, idx, seq, open_key = [], 0, 0, None
    for page, col, key, closed in rows:
        if closed:
            open_key = None
        elif key is not None and key != open_key:
            idx, seq, open_key = idx + 1, 1, key
            out.append((idx, seq, page, col))
        elif open_key is not None:
            seq += 1
            out.append((idx, seq, page, col))
    return out


def _key(name):
    return None if name is None else (name, None, "2026", name + "t", False)


def test_matches_sequential_scan(spark):
    rng = random.Random(5)
    data, want = [], set()
    for b in range(60):
        rows = []
        for page in range(rng.choice([3, 20, 50])):
            if rng.random() < 0.2:
                continue
            for col in range(rng.choice([1, 2, 3])):
                key = rng.choice([None, None, None, "A", "B", "C"])
                closed = rng.random() < 0.12
                rows.append((page, col, key, closed))
        for page, col, key, closed in rows:
            flag = rng.random() < 0.5
            data.append((f"b{b}", page, col, _key(key), closed and flag, closed and not flag))
        want |= {(f"b{b}", *r) for r in _sequential(rows)}
    df = spark.createDataFrame(data, SUB)
    for width in (1, 4, 4096):
        got = segments.segment_columns(df, width).select("book_id", "idx", "seq", "page", "col")
        assert {tuple(r) for r in got.collect()} == want


def test_fixture_sequence(spark):
    seq = [("A", 0), (None, 0), ("A", 0), ("B", 0), (None, 0), (None, 1), (None, 0), ("B", 0), (None, 0)]
    df = spark.createDataFrame(
        [("b", i + 1, 0, _key(k), bool(c), False) for i, (k, c) in enumerate(seq)], SUB
    )
    exam, segs = segments.segment(df, width=4)
    got = {}
    for r in segs.collect():
        got.setdefault(r["idx"], []).append(r["page"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 3], 2: [4, 5], 3: [8, 9]}
    rows = {r["idx"]: (r["start"], r["end"], r["school"], r["n_columns"]) for r in exam.collect()}
    assert rows == {1: (1, 3, "A", 3), 2: (4, 5, "B", 2), 3: (8, 9, "B", 2)}
    parts = segments.nested_segments(segs, part_size=2).orderBy("idx", "part").collect()
    assert [(r["idx"], r["part"], len(r["segments"])) for r in parts] == [
        (1, 0, 2), (1, 1, 1), (2, 0, 2), (3, 0, 2)
    ]


def test_rows_shuffle_once(spark):
    """Both uses of the rows share one exchange, by (book, block)."""
    df = spark.createDataFrame([("b", 1, 0, _key("A"), False, False)], SUB)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = segments.segment_columns(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "ReusedExchange" in plan


def test_rank_matches_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), i) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "book_id string, name string, idx int")
    w = Window.partitionBy("book_id", "name").orderBy("idx")
    got = ordered.rank_in_group(df.withColumn("want", F.row_number().over(w)), ["book_id", "name"], "idx", "rn", 7)
    assert got.count() == 200
    assert got.filter("rn <> want").count() == 0
