"""Operators driven by tables: dictionaries, anchors, frequent keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirewise.catalogue import tables as t
from quirewise.operators import dictionary as D
from quirewise.operators import layout as L
from quirewise.operators import ordered as O

SF = "/root/testdata/sf0.001"


def test_words_of_a_table_against_contains(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé漢 ") for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    table = [(i, w) for i, w in enumerate(sorted(words))] + [(900, sorted(words)[0]), (901, ""), (902, None)]
    texts = ["".join(rng.choice("abé漢 ") for _ in range(n)) for n in (0, 1, 5, 80, 3000)] + [None, "zzz"]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id int, text string, `a.b` string").repartition(3)
    found = D.find_words(df, spark.createDataFrame(table, "word_no long, word string"))
    assert found.columns == ["doc_id", "a.b", "found"]
    got = {r["doc_id"]: {f["word_no"]: (f["n"], f["at"]) for f in r["found"]} for r in found.collect()}

    def count(text, w):
        return sum(text.startswith(w, i) for i in range(len(text)))

    assert got == {i: {k: (count(x, w), x.index(w)) for k, w in table if k < 900 and w in x} if x else {} for i, x in enumerate(texts)}


def test_dictionary_limits(spark):
    words = spark.range(50).selectExpr("id AS word_no", "'w' || id AS word")
    with pytest.raises(ValueError):
        D.automaton(words, max_words=49)
    with pytest.raises(ValueError):
        D.automaton(words, max_chars=50)
    df = spark.createDataFrame([(1, "w1")], "doc_id int, text string")
    assert D.find_words(df, words.limit(0)).head()["found"] == []
    assert D.find_words(df.limit(0), words).count() == 0


def test_anchors_of_books_meet_runs_without_all_pairs(spark):
    profile = t.profiles(spark, SF)
    places = [(None, "left", 0.04), (None, "edge", 1.0), ("scan0", "own", 0.62), ("scan1", "own", 0.31), ("scan0", "left", 0.04)]
    anchors = spark.createDataFrame(places, "book_id string, anchor string, at double")
    found = L.anchor_votes(profile, anchors, t.VECTOR_SCAN)
    got = {(r["book_id"], r["page"], r["anchor"]): (r["vote"], r["gutter"]) for r in found.collect()}
    w, min_w = F.col("w"), F.col("min_w")
    bands = profile.withColumn("min_w", L.min_run_width(w, t.VECTOR_SCAN)).filter(L._eligible(t.VECTOR_SCAN))
    bands = bands.withColumn("runs", L.blank_runs(F.col("ink"), min_w, t.VECTOR_SCAN))
    want = {}
    for book, anchor, at in {(b, a, x) for b, a, x in places}:
        rows = bands.select("book_id", "page", "w", L._best_centre(F.col("runs"), w, min_w, at, t.VECTOR_SCAN).alias("c")).collect()
        for key in {(r["book_id"], r["page"]) for r in rows if book in (None, r["book_id"])}:
            mine = [r for r in rows if (r["book_id"], r["page"]) == key]
            seen = sorted(r["c"] / 64 for r in mine if r["c"] is not None)
            half = len(seen) // 2
            middle = at if not seen else seen[half] if len(seen) % 2 else (seen[half - 1] + seen[half]) / 2
            want[*key, anchor] = (len(seen) / len(mine), middle)
    rounded = lambda d: {k: tuple(round(x, 9) for x in v) for k, v in d.items()}
    assert rounded(got) == rounded(want) and len(got) > 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frequent_keys_are_dealt_out_and_rare_ones_stay(spark):
    rows = [("hot", i) for i in range(4000)] + [(f"cold{i}", i) for i in range(4000)] + [(None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "book_id string, page long").repartition(4)
    hot = O.hot_keys(df, "book_id", 16)
    assert set(hot) == {"hot"} and 7 <= hot["hot"] <= 9
    lookup = spark.createDataFrame([("hot", 1)] + [(f"cold{i}", i) for i in range(0, 4000, 2)], "book_id string, v long")
    for how in ("left", "inner", "left_semi"):
        want = Counter(map(tuple, df.join(lookup, "book_id", how).collect()))
        assert Counter(map(tuple, O.balanced_lookup(df, lookup, "book_id", F.col("page"), hot, how).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = O.balanced_lookup(df, lookup, "book_id", F.col("page"), hot, "inner").filter("book_id = 'hot'")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 4 and max(sizes) <= 2000
    assert O.hot_keys(df.limit(0), "book_id", 16) == {}
    assert O.balanced_lookup(df, lookup, "book_id", F.col("page"), {}, "inner").count() == 6000
