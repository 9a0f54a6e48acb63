"""Tiles of pages against the profile of whole pages, and skipped pages in the whole run."""

import dataclasses
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.catalogue import segment_queries, tables
from quirewise.plans import collection
from quirewise.rules import SCAN
from quirewise.sources import raster

PAGE = "book_id string, page long, w int, h int, n int, samples binary"


def pages(rng):
    rows = []
    for page, (w, h, n) in enumerate([(40, 60, 1), (33, 100, 3), (20, 13, 4), (8, 12, 2), (50, 7, 3), (1, 30, 1)]):
        image = rng.integers(0, 256, (h, w, n)).astype(np.uint8)
        image[:, : w // 2] = 240 + rng.integers(0, 8, (h, w // 2, n))
        rows.append(("b", page, w, h, n, image.tobytes()))
    rows.append(("b", 50, 30, 24, 1, bytes([255]) * 720))
    return rows


@pytest.mark.parametrize("lines", [1, 7, 500])
def test_tiles_give_the_profile_of_whole_pages(spark, lines):
    df = spark.createDataFrame(pages(np.random.default_rng(3)), PAGE).repartition(3)
    want = {(r["page"], r["band"]): list(r["ink"]) for r in raster.ink_profile(df).collect() if None not in r["ink"]}
    got = {(r["page"], r["band"]): list(r["ink"]) for r in raster.ink_profile_of_tiles(raster.tiles(df, lines).repartition(4)).collect()}
    assert got == want and len(got) > 60


def test_unreadable_and_missing_tiles(spark):
    rows = pages(np.random.default_rng(4))[:3] + [("b", 90, 10, 10, 1, b"short"), ("b", 91, 0, 0, 1, b""), ("b", 92, 5, 5, 1, None)]
    parts = raster.tiles(spark.createDataFrame(rows, PAGE), 9)
    parts = parts.filter("NOT (page = 1 AND top = 18)")
    found = raster.ink_profile_of_tiles(parts).collect()
    errors = {r["page"]: r["error"] for r in found if r["error"] is not None}
    assert set(errors) == {1, 90, 91, 92} and "pixels" in errors[1]
    assert {r["page"] for r in found if r["error"] is None} == {0, 2}
    assert raster.ink_profile_of_tiles(parts.limit(0)).count() == 0


def test_skipped_pages_take_no_part(spark):
    sf = "/root/testdata/sf0.001"
    given = segment_queries.inputs(spark, sf)
    skips = given.pages.select("book_id").distinct().withColumn("skip", F.length("book_id") * 9)
    plain = dataclasses.replace(
        given,
        page_strip=given.page_strip.filter(F.col("page") > F.length("book_id") * 9),
        pages=given.pages.filter(F.col("page") > F.length("book_id") * 9),
        layout=given.layout.filter(F.col("page") > F.length("book_id") * 9),
    )
    want = Counter(map(str, collection.split_collections(plain).manifest.collect()))
    got = Counter(map(str, collection.split_collections(dataclasses.replace(given, skip=skips)).manifest.collect()))
    assert got == want and got
    every = Counter(map(str, collection.split_collections(dataclasses.replace(given, skip=0)).manifest.collect()))
    assert every != got


def test_inputs_without_any_layout(spark):
    df = tables.page_sizes(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        collection.split_collections(collection.Inputs(page_strip=df, pages=df), scan=SCAN)
