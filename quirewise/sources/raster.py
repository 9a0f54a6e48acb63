"""A1: page rasters to ink profiles, whole pages or tiles of rows, Arrow batches into numpy.

A page of any size is a set of tiles (runs of pixel rows).  What a page needs as a
whole, the level of its paper, is a percentile: counts of the 256 whole luminances
add up over tiles and name the one or two levels that hold it, counts of the exact
values of just those give it without rounding.  Ink is counted per band and pixel
column of a tile, and counts add up too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import SCAN, LayoutProfile

PROFILE = "book_id string, page long, band int, w int, ink array<double>, error string"
TILE = ("book_id", "page", "w", "h", "n", "top", "samples")
PAGES_AT_ONCE = 64
TILE_ROWS = 256
# Luminance weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def _luminance(samples: bytes, w: int, h: int, n: int) -> np.ndarray:
    pixels = np.frombuffer(samples, dtype=np.uint8).reshape(h, w, n)
    if n < 3:
        return pixels[:, :, 0].astype(np.float32)
    return sum(weight * pixels[:, :, i] for i, weight in enumerate(LUMA)).astype(np.float32)


def tiles(raster: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Pages (book_id, page, w, h, n, samples) cut into runs of pixel rows; ``top`` is the first row of one.

    Samples that are not w * h * n bytes stay one tile, which is unreadable.
    """
    whole = F.octet_length("samples") == F.col("w").cast("long") * F.col("h") * F.col("n")
    tops = F.when(whole & (F.col("h") > 0), F.sequence(F.lit(0), F.col("h") - 1, F.lit(rows))).otherwise(F.array(F.lit(0)))
    cut = raster.select("book_id", "page", "w", "h", "n", "samples", F.explode(tops).alias("top"))
    line = F.col("w") * F.col("n")
    part = F.when(whole, F.substring("samples", F.col("top") * line + 1, line * rows)).otherwise(F.col("samples"))
    return cut.withColumn("samples", part).select(*TILE)


def _read(row) -> tuple[np.ndarray | None, str | None]:
    """Luminance of a tile, or why there is none."""
    try:
        w, n = int(row.w), int(row.n)
        lines, rest = divmod(len(row.samples), w * n)
        if rest or row.top < 0 or row.top + lines > row.h:
            raise ValueError(f"a tile of {len(row.samples)} bytes does not fit {w} x {row.h} x {n}")
        return _luminance(row.samples, w, lines, n), None
    except (ValueError, TypeError, ZeroDivisionError) as problem:
        return None, str(problem)


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first in range(0, len(batch), PAGES_AT_ONCE):
            yield batch.iloc[first : first + PAGES_AT_ONCE]


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per tile the count of every whole luminance; -1 for a tile that can't be read."""
    for some in _few(batches):
        rows = []
        for row in some.itertuples(index=False):
            lum, error = _read(row)
            if lum is None:
                rows.append((row.book_id, row.page, -1, 0, error))
                continue
            counts = np.bincount(lum.astype(np.int64).ravel(), minlength=256)
            rows += [(row.book_id, row.page, int(k), int(counts[k]), None) for k in np.flatnonzero(counts)]
        yield pd.DataFrame(rows, columns=["book_id", "page", "level", "count", "error"]).astype({"level": "int32", "count": "int64"})


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per tile the count of every exact luminance within the levels sought."""
    for some in _few(batches):
        rows = []
        for row in some.itertuples(index=False):
            lum = _read(row)[0]
            if lum is not None:
                level = lum.astype(np.int64)
                values, counts = np.unique(lum[(level == row.low) | (level == row.high)], return_counts=True)
                rows += [(row.book_id, row.page, float(v), int(c)) for v, c in zip(values, counts)]
        yield pd.DataFrame(rows, columns=["book_id", "page", "value", "count"]).astype({"value": "float64", "count": "int64"})


def paper_levels(parts: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """book_id, page, low, high, share, error: the page's percentile lies ``share`` of the way from ``low`` to ``high``.

    Both are exact luminances of the page.  ``error`` is set for pages with unreadable or missing tiles.
    """
    page = ["book_id", "page"]
    counts = parts.mapInPandas(_levels, "book_id string, page long, level int, count long, error string")
    counts = counts.groupBy(*page, "level").agg(F.sum("count").alias("count"), F.min("error").alias("error"))
    sizes = parts.groupBy(*page).agg(F.max(F.col("w").cast("long") * F.col("h")).alias("size"))
    in_page = Window.partitionBy(*page)
    below = in_page.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumns({
        "before": F.coalesce(F.sum("count").over(below), F.lit(0)), "total": F.sum("count").over(in_page), "problem": F.min("error").over(in_page)
    })
    place = F.lit(p.paper_percentile / 100.0) * (F.col("total") - 1)
    first = F.floor(place)
    second = F.least(first + 1, F.col("total") - 1)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("count"))
    sought = ranked.groupBy(*page).agg(
        F.max(F.when(holds(first), F.col("level"))).alias("low"), F.max(F.when(holds(second), F.col("level"))).alias("high"),
        F.max(F.when(holds(first), F.col("before"))).alias("before"), F.max(first).alias("first"), F.max(second).alias("second"),
        F.max(place - first).alias("share"), F.max("total").alias("total"), F.min("problem").alias("problem"),
    )
    sought = sought.join(sizes, page)
    lacking = F.concat(F.col("total").cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" pixels"))
    sought = sought.withColumn("error", F.coalesce("problem", F.when(F.col("total") != F.col("size"), lacking)))
    exact = parts.join(sought.filter("error IS NULL").select(*page, "low", "high"), page)
    exact = exact.mapInPandas(_exact, "book_id string, page long, value double, count long").groupBy(*page, "value").agg(F.sum("count").alias("count"))
    upto = Window.partitionBy(*page).orderBy("value")
    exact = exact.withColumn("upto", F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    exact = exact.join(sought.select(*page, "before", "first", "second", "share"), page)
    at = lambda rank: F.min(F.when(F.col("before") + F.col("upto") > F.col(rank), F.col("value")))
    values = exact.groupBy(*page).agg(at("first").alias("low"), at("second").alias("high"), F.first("share").alias("share"))
    return sought.select(*page, "error").join(values, page, "left")


def _ink(p: LayoutProfile):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per tile and band the rows and the inked rows of every pixel column."""
        for some in _few(batches):
            rows = []
            for row in some.itertuples(index=False):
                lum = _read(row)[0]
                paper = np.percentile(np.array([row.low, row.high], np.float32), 100 * row.share)
                inked = lum < paper - p.ink_depth
                bands = [row.h * b // p.n_bands for b in range(p.n_bands + 1)]
                for band, (begin, end) in enumerate(zip(bands, bands[1:])):
                    strip = inked[max(begin - row.top, 0) : max(end - row.top, 0)]
                    if len(strip):
                        rows.append((row.book_id, row.page, band, row.w, len(strip), strip.sum(axis=0, dtype=np.int64)))
            yield pd.DataFrame(rows, columns=["book_id", "page", "band", "w", "lines", "inked"]).astype({"band": "int32", "w": "int32", "lines": "int64"})

    return of


def ink_profile_of_tiles(parts: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """Ink percentage per pixel column for each horizontal band of each page, from its tiles (``TILE``).

    Tiles of a page come in any order and on any task; no task holds a page.  A page
    with an unreadable or missing tile gives one row with ``error`` set and no band;
    bands without a pixel row have no row.
    """
    page = ["book_id", "page"]
    known = paper_levels(parts, p)
    counts = parts.join(known.filter("error IS NULL").drop("error"), page)
    counts = counts.mapInPandas(_ink(p), "book_id string, page long, band int, w int, lines long, inked array<long>")
    # A band has as many lists as tiles, each as long as a pixel row.
    lists = counts.groupBy(*page, "band", "w").agg(F.sum("lines").alias("lines"), F.collect_list("inked").alias("lists"))
    none = F.transform(F.sequence(F.lit(1), F.col("w")), lambda _: F.lit(0).cast("long"))
    total = F.aggregate("lists", none, lambda acc, one: F.zip_with(acc, one, lambda a, b: a + b))
    lines = F.col("lines")
    ink = F.transform(total, lambda c: c / lines * 100.0)
    profile = lists.select(*page, "band", "w", ink.alias("ink"), F.lit(None).cast("string").alias("error"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("band", "int"), ("w", "int"))]
    failed = known.filter("error IS NOT NULL").select(*page, *blank, F.array().cast("array<double>").alias("ink"), "error")
    return profile.unionByName(failed)


def _bands(row, p: LayoutProfile) -> Iterator[tuple]:
    w, h = int(row.w), int(row.h)
    try:
        lum = _luminance(row.samples, w, h, int(row.n))
        inked = lum < np.percentile(lum, p.paper_percentile) - p.ink_depth
    except (ValueError, TypeError, IndexError) as problem:
        # One unreadable page never stops the rest.
        yield row.book_id, row.page, None, w, [], str(problem)
        return
    edges = [h * b // p.n_bands for b in range(p.n_bands + 1)]
    for band, (top, bottom) in enumerate(zip(edges, edges[1:])):
        strip = inked[top:bottom]
        ink = strip.mean(axis=0) * 100.0 if len(strip) else np.full(w, np.nan)
        yield row.book_id, row.page, band, w, ink.tolist(), None


def ink_profile(raster: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """Ink percentage per pixel column for each horizontal band of each page.

    Works page by page inside a task, so no shuffle, for pages that fit an Arrow
    batch; :func:`ink_profile_of_tiles` takes pages of any size.
    An unreadable page gives one row with ``error`` set and no band.
    """
    names = ["book_id", "page", "band", "w", "ink", "error"]

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A few pages at a time: wide profiles would add up over a batch.
        for some in _few(batches):
            found = [b for row in some.itertuples(index=False) for b in _bands(row, p)]
            yield pd.DataFrame(found, columns=names).astype({"band": "Int32"})

    return raster.select("book_id", "page", "w", "h", "n", "samples").mapInPandas(profile, PROFILE)
