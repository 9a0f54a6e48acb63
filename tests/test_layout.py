"""Gutter votes on hand-made profiles and rasters."""

import numpy as np
from pyspark.sql import functions as F

from quirewise.operators import layout as L
from quirewise.sources.raster import ink_profile

PROFILE = "book_id string, page int, band int, w int, ink array<double>"


def band(gaps, w=100, level=10.0):
    ink = [level] * w
    for s, e in gaps:
        ink[s:e] = [0.0] * (e - s)
    return ink


def page(n, gaps_per_band):
    return [("b", n, i, 100, band(g)) for i, g in enumerate(gaps_per_band)]


def test_fixture_pages(spark):
    blank = [("b", 5, i, 100, [0.0] * 100) for i in range(10)]
    rows = (
        page(1, [[(48, 52)]] * 12)
        + page(2, [[(31, 35), (65, 69)]] * 12)
        + page(3, [[(48, 52)]] * 4 + [[]] * 8)
        + page(4, [[(48, 52)]] * 5 + [[]] * 7)
        + blank
        + [("b", 5, i, 100, band([(48, 52)])) for i in (10, 11)]
        + [("b", 6, i, 100, [0.0] * 100) for i in range(12)]
    )
    df = spark.createDataFrame(rows, PROFILE)
    got = {r["page"]: r for r in L.classify_layout(df).collect()}
    assert {p: r["layout"] for p, r in got.items()} == {
        1: "2-up", 2: "3-up", 3: "1-up", 4: "2-up", 5: "2-up", 6: "1-up"
    }
    assert [tuple(c) for c in got[1]["cuts"]] == [(0.0, 0.506), (0.494, 1.0)]
    assert [tuple(c) for c in got[2]["cuts"]] == [(0.0, 0.336), (0.324, 0.676), (0.664, 1.0)]
    assert (got[3]["score_c"], got[4]["score_c"]) == (0.333, 0.417)
    assert [tuple(c) for c in got[6]["cuts"]] == [(0.0, 1.0)]
    for r in got.values():
        assert r["cuts"][0]["x0"] == 0.0 and r["cuts"][-1]["x1"] == 1.0


def test_runs_at_the_edges(spark):
    df = spark.createDataFrame(
        [("b", 1, 0, 100, band([(0, 5), (40, 43), (95, 100)])), ("b", 1, 1, 100, band([]))], PROFILE
    )
    got = sorted((r["s"], r["e"]) for r in L.run_table(df).collect())
    assert got == [(0, 5), (95, 100)]
    assert sorted((r["s"], r["e"]) for r in L.blank_run_rows(df).collect()) == got


def test_array_and_row_forms_agree(spark):
    rng = np.random.default_rng(3)
    rows = [("b", 1, i, 80, (rng.random(80) * (rng.random(80) < 0.4)).tolist()) for i in range(40)]
    df = spark.createDataFrame([(*r[:4], [v * 9 for v in r[4]]) for r in rows], PROFILE)
    a = {tuple(r) for r in L.run_table(df).collect()}
    b = {tuple(r) for r in L.blank_run_rows(df).collect()}
    assert a == b and len(a) > 20


def test_unknown_override_fails_on_request(spark):
    lay = spark.createDataFrame([("b", 1, "1-up")], "book_id string, page int, layout string").withColumn(
        "cuts", L.default_cuts(F.col("layout"))
    )
    ov = spark.createDataFrame([("b", 9, "2-up")], "book_id string, page int, layout string")
    assert L.apply_layout_overrides(lay, ov).head()["layout"] == "1-up"
    try:
        L.apply_layout_overrides(lay, ov, on_unknown="fail")
    except ValueError as e:
        assert "b:9" in str(e)
    else:
        raise AssertionError("unknown page accepted")


def test_raster_matches_plain_numpy(spark):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (48, 30, 3), dtype=np.uint8)
    gray = rng.integers(0, 256, (24, 20, 1), dtype=np.uint8)
    rows = [
        ("b", 1, 30, 48, 3, bytearray(rgb.tobytes())),
        ("b", 2, 20, 24, 1, bytearray(gray.tobytes())),
        ("b", 3, 20, 24, 1, bytearray(b"short")),
    ]
    df = spark.createDataFrame(rows, "book_id string, page long, w int, h int, n int, samples binary")
    got = {(r["page"], r["band"]): r for r in ink_profile(df).collect()}
    assert len(got) == 25 and got[3, None]["error"] and got[3, None]["ink"] == []
    lum = (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]).astype(np.float32)
    mask = lum < np.percentile(lum, 95) - 40
    assert np.allclose(got[1, 3]["ink"], mask[12:16].mean(axis=0) * 100)
