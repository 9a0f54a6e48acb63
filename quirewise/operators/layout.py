"""Page layout from ink profiles: blank runs, gutter votes, cut windows, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..plans.storage import materialize
from ..rules import LAYOUTS, SCAN, LayoutProfile

ANCHORS = {"c": 0.5, "13": 1.0 / 3.0, "23": 2.0 / 3.0}
CUTS_TYPE = "array<struct<x0:double,x1:double>>"


def _windows(*pairs) -> Column:
    return F.array(
        *[
            F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
            for a, b in pairs
        ]
    )


def default_cuts(layout: Column) -> Column:
    """Plain windows for layout rows stored without measured cuts."""
    return (
        F.when(layout == "1-up", _windows((0, 1)))
        .when(layout == "3-up", _windows((0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1)))
        .otherwise(_windows((0, 0.5), (0.5, 1)))
    )


def ideal_cuts(layout: Column, overlap: float = SCAN.overlap) -> Column:
    """Overlapping windows given to a page whose layout was set by hand."""
    r = lambda v: round(v, 4)
    o = overlap
    return (
        F.when(layout == "2-up", _windows((0, r(0.5 + o)), (r(0.5 - o), 1)))
        .when(
            layout == "3-up",
            _windows((0, r(1 / 3 + o)), (r(1 / 3 - o), r(2 / 3 + o)), (r(2 / 3 - o), 1)),
        )
        .otherwise(_windows((0, 1)))
    )


def columns_per_layout(layout: Column) -> Column:
    """F22"""
    return F.when(layout == "1-up", 1).when(layout == "3-up", 3).otherwise(2)


# --- blank runs -------------------------------------------------------------


def min_run_width(w: Column, p: LayoutProfile = SCAN) -> Column:
    return F.greatest(F.lit(p.min_gutter_px), F.floor(w * F.lit(p.min_gutter)).cast("int"))


def blank_runs(ink: Column, min_w: Column, p: LayoutProfile = SCAN) -> Column:
    """W1, array form: maximal half-open runs of blank columns, left to right."""
    blank = lambda i: F.coalesce(F.get(ink, i) < p.blank_ink, F.lit(False))
    # GetArrayItem reads index -1 and index w as null, so both edges close a run.
    index = F.sequence(F.lit(0), F.size(ink) - 1)
    starts = F.filter(index, lambda i: blank(i) & ~blank(i - 1))
    ends = F.filter(index, lambda i: blank(i) & ~blank(i + 1))
    runs = F.zip_with(
        starts, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e"))
    )
    return F.when(F.size(ink) > 0, F.filter(runs, lambda r: r["e"] - r["s"] >= min_w)).otherwise(
        F.array().cast("array<struct<s:int,e:int>>")
    )


def blank_run_rows(profile: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """W1, row form: gaps and islands over exploded columns (the array form's twin)."""
    cells = profile.select(
        "book_id", "page", "band", "w", F.posexplode("ink").alias("x", "ink")
    ).filter(F.col("ink") < p.blank_ink)
    in_band = Window.partitionBy("book_id", "page", "band").orderBy("x")
    return (
        cells.withColumn("island", F.col("x") - F.row_number().over(in_band))
        .groupBy("book_id", "page", "band", "w", "island")
        .agg(F.min("x").cast("int").alias("s"), (F.max("x") + 1).cast("int").alias("e"))
        .filter(F.col("e") - F.col("s") >= min_run_width(F.col("w"), p))
        .select("book_id", "page", "band", "s", "e")
    )


def run_table(profile: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """Blank runs of the voting bands, one row per run."""
    runs = blank_runs(F.col("ink"), min_run_width(F.col("w"), p), p)
    voting = profile.filter(_eligible(p))
    return explode_once(voting, ["book_id", "page", "band"], runs, "n", "r").select(
        "book_id", "page", "band", F.col("r.s").alias("s"), F.col("r.e").alias("e")
    )


def _eligible(p: LayoutProfile) -> Column:
    """A2: a band with next to no ink says nothing about gutters."""
    return F.coalesce(F.array_max("ink") >= p.band_ink_min, F.lit(False))


# --- votes ------------------------------------------------------------------


def _best_centre(runs: Column, w: Column, min_w: Column, anchor: float, p: LayoutProfile) -> Column:
    """J3 + W2: centre of the run reaching furthest into the anchor's window.

    The three anchors are literals, so the interval join runs inside the row's
    own array: no join, no pairs.
    """
    lo = F.floor(w * F.lit(max(0.0, anchor - p.search_span))).cast("int")
    hi = F.floor(w * F.lit(min(1.0, anchor + p.search_span))).cast("int")
    clipped = F.transform(
        runs,
        lambda r: F.struct(
            (F.least(r["e"], hi) - F.greatest(r["s"], lo)).alias("reach"),
            (-r["s"]).alias("leftmost"),
            ((F.greatest(r["s"], lo) + F.least(r["e"], hi)) / F.lit(2.0)).alias("centre"),
        ),
    )
    return F.array_max(F.filter(clipped, lambda r: r["reach"] >= min_w * F.lit(p.reach)))["centre"]


def band_votes(profile: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """One row per band: whether it votes, and the gutter centre it sees near each
    anchor or null."""
    w, min_w = F.col("w"), F.col("min_w")
    return (
        profile.withColumn("votes", _eligible(p))
        .withColumn("min_w", min_run_width(w, p))
        .withColumn("runs", F.when(F.col("votes"), blank_runs(F.col("ink"), min_w, p)))
        .select(
            "book_id",
            "page",
            "band",
            "w",
            "votes",
            *[
                _best_centre(F.col("runs"), w, min_w, anchor, p).alias(f"centre_{name}")
                for name, anchor in ANCHORS.items()
            ],
        )
    )


#: Parts that books are dealt into to meet the anchors for all of them.
DEALS = 64
#: Width of the intervals over which runs and anchors meet, as a share of the page.
BIN = 1 / 32


def anchor_votes(profile: DataFrame, anchors: DataFrame, p: LayoutProfile = SCAN) -> DataFrame:
    """J3 with a table of anchors (book_id, anchor, at): book_id, page, anchor, vote, gutter.

    A book may expect gutters anywhere; anchors of a null book hold for all books that
    have none of that name.
    Runs and the windows around anchors are put into the intervals of the page's width
    that they touch and meet there, so nothing is compared that is not close; the
    overlap is then computed exactly, once per pair.  ``vote`` is the share of voting
    bands that see the anchor, ``gutter`` the median centre there, or the anchor.
    """
    share = lambda c: F.floor(c / F.lit(BIN)).cast("int")
    bands = profile.select("book_id", "page", "band", "w", "ink").withColumn("min_w", min_run_width(F.col("w"), p)).filter(_eligible(p))
    runs = explode_once(bands, ["book_id", "page", "band", "w", "min_w"], blank_runs(F.col("ink"), F.col("min_w"), p), "n", "r")
    first = share(F.col("r.s") / F.col("w"))
    runs = runs.select(
        "*", first.alias("first_bin"), F.explode(F.sequence(first, F.greatest(first, share((F.col("r.e") - 1) / F.col("w"))))).alias("bin")
    )
    own = anchors.filter("book_id IS NOT NULL").select("book_id", "anchor", "at")
    # The anchors for all books, listed once per deal of the books, become rows of every book.
    deals = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("deal")
    everywhere = anchors.filter("book_id IS NULL").select("anchor", "at", deals)
    books = profile.select("book_id").distinct().withColumn("deal", F.pmod(F.xxhash64("book_id"), F.lit(DEALS)))
    general = books.join(everywhere, "deal").join(own.select("book_id", "anchor"), ["book_id", "anchor"], "left_anti")
    wanted = own.unionByName(general.select("book_id", "anchor", "at")).distinct()
    lo, hi = F.greatest(F.col("at") - p.search_span, F.lit(0.0)), F.least(F.col("at") + p.search_span, F.lit(1.0))
    # A pixel edge is rounded down, so a window may begin up to a pixel lower than its share of the page says.
    low_bin = F.greatest(share(lo) - 1, F.lit(0))
    windows = wanted.select("*", lo.alias("lo"), hi.alias("hi"), low_bin.alias("low_bin"), F.explode(F.sequence(low_bin, share(hi))).alias("bin"))
    met = runs.join(windows, ["book_id", "bin"]).filter(F.col("bin") == F.greatest("first_bin", "low_bin"))
    left, right = F.floor(F.col("w") * F.col("lo")).cast("int"), F.floor(F.col("w") * F.col("hi")).cast("int")
    start, end = F.greatest(F.col("r.s"), left), F.least(F.col("r.e"), right)
    met = met.withColumns({"reach": end - start, "centre": (start + end) / 2.0, "s": F.col("r.s")}).filter(F.col("reach") >= F.col("min_w") * p.reach)
    best = met.groupBy("book_id", "page", "band", "w", "anchor").agg(F.max_by("centre", F.struct("reach", -F.col("s"))).alias("centre"))
    seen = best.groupBy("book_id", "page", "anchor").agg(F.count("centre").alias("n"), (F.median("centre") / F.first("w")).alias("gutter"))
    pages = bands.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("bands"))
    every = pages.join(wanted, "book_id").join(seen, ["book_id", "page", "anchor"], "left")
    return every.select(
        "book_id", "page", "anchor", (F.coalesce("n", F.lit(0)) / F.col("bands")).alias("vote"), F.coalesce("gutter", F.col("at")).alias("gutter")
    )


def gutter_votes(votes: DataFrame) -> DataFrame:
    """A3 + A4: share of voting bands and median centre per anchor."""
    aggs = []
    for name, anchor in ANCHORS.items():
        c = F.col(f"centre_{name}")
        voting = F.count_if("votes")
        share = F.try_divide(F.count(c).cast("double"), voting.cast("double"))
        aggs.append(F.coalesce(share, F.lit(0.0)).alias(f"vote_{name}"))
        aggs.append(
            F.coalesce(F.median(c) / F.first("w"), F.lit(anchor)).alias(f"gutter_{name}")
        )
    return votes.groupBy("book_id", "page").agg(*aggs)


def decide_layout(s_c: Column, s_13: Column, s_23: Column, p: LayoutProfile = SCAN) -> Column:
    """three columns only when the thirds beat the centre."""
    three = F.least(s_13, s_23)
    return (
        F.when((three >= p.vote_ratio) & (three > s_c), "3-up")
        .when(s_c >= p.vote_ratio, "2-up")
        .otherwise("1-up")
    )


def measured_cuts(layout: Column, g_c: Column, g_13: Column, g_23: Column, p: LayoutProfile = SCAN) -> Column:
    """F20 + K2: windows around the measured gutters, overlapping a little."""

    def at(g: Column, delta: float) -> Column:
        return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), g + F.lit(delta))), 4)

    def window(x0: Column, x1: Column) -> Column:
        return F.struct(x0.alias("x0"), x1.alias("x1"))

    left, right = F.lit(0.0), F.lit(1.0)
    a, b = F.least(g_13, g_23), F.greatest(g_13, g_23)
    o = p.overlap
    return (
        F.when(
            layout == "3-up",
            F.array(window(left, at(a, o)), window(at(a, -o), at(b, o)), window(at(b, -o), right)),
        )
        .when(layout == "2-up", F.array(window(left, at(g_c, o)), window(at(g_c, -o), right)))
        .otherwise(F.array(window(left, right)))
    )


def classify_layout(
    profile: DataFrame, pages: DataFrame | None = None, p: LayoutProfile = SCAN
) -> DataFrame:
    """Layout rows from ink profiles.

    One pass over the profiles and one aggregate of twelve small rows a page.
    A page on which no band votes scores zero everywhere and stays 1-up; give
    the page list to keep pages that have no profile at all.
    """
    rows = gutter_votes(band_votes(profile, p))
    if pages is not None:
        known = pages.select("book_id", "page").distinct()
        rows = known.join(rows, ["book_id", "page"], "left")
    score = lambda n: F.coalesce(F.col(f"vote_{n}"), F.lit(0.0))
    gutter = lambda n: F.coalesce(F.col(f"gutter_{n}"), F.lit(ANCHORS[n]))
    return (
        rows.select(
            "book_id",
            "page",
            *[score(n).alias(f"v_{n}") for n in ANCHORS],
            *[gutter(n).alias(f"g_{n}") for n in ANCHORS],
        )
        .withColumn("layout", decide_layout(F.col("v_c"), F.col("v_13"), F.col("v_23"), p))
        .select(
            "book_id",
            "page",
            "layout",
            measured_cuts(F.col("layout"), F.col("g_c"), F.col("g_13"), F.col("g_23"), p).alias("cuts"),
            *[F.bround(f"v_{n}", 3).alias(f"score_{n}") for n in ANCHORS],
            F.lit(False).alias("corrected"),
        )
    )


# --- reports and overrides ----------------------------------------------------


def layout_histogram(layout: DataFrame) -> DataFrame:
    """A5"""
    return layout.groupBy("book_id").agg(
        *[F.count_if(F.col("layout") == v).alias("n_" + v[0] + "up") for v in LAYOUTS]
    )


def suspect_pages(layout: DataFrame) -> DataFrame:
    """Pages left uncut, for a person to look at."""
    return layout.filter(F.col("layout") == "1-up").select("book_id", "page", "layout")


def split_overrides(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) layout overrides."""
    cleaned = overrides.withColumn("layout", F.trim("layout"))
    ok = F.coalesce(F.col("layout").isin(*LAYOUTS), F.lit(False))
    return cleaned.filter(ok), cleaned.filter(~ok)


#: Unknown pages that an error message names.
NAMED = 1000


def unknown_overrides(layout: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that name a page the book does not have."""
    return overrides.join(layout, ["book_id", "page"], "left_anti")


def apply_layout_overrides(
    layout: DataFrame, overrides: DataFrame, on_unknown: str = "skip"
) -> DataFrame:
    """Layout with overrides applied, plus ``old_layout`` and ``changed``.

    A later override of the same page wins by the column ``seq``; without one, two
    different overrides of a page stop the query that reads the result.
    ``on_unknown='fail'`` raises if any override names an unknown page: the error
    has their number, up to ``NAMED`` of them, and the written table with all.
    """
    valid, _ = split_overrides(overrides)
    if on_unknown == "fail":
        missing = unknown_overrides(layout, valid).select("book_id", "page").distinct()
        counted = Observation("unknown overrides")
        # One job writes the table and counts it.
        missing = materialize(missing.observe(counted, F.count(F.lit(1)).alias("n")), "unknown-overrides")
        if count := counted.get["n"]:
            some = [f"{r['book_id']}:{r['page']}" for r in missing.orderBy("book_id", "page").limit(NAMED).collect()]
            more = "" if count <= NAMED else f" and others, all in {missing.inputFiles()[0].rsplit('/', 1)[0]}"
            raise ValueError(f"{count} overrides name pages outside the collection: {', '.join(sorted(some))}{more}")
    if "seq" in overrides.columns:
        choice = F.max_by("layout", "seq")
    else:
        several = F.concat(F.lit("several layouts without seq for page "), F.first(F.col("page").cast("string")))
        choice = F.when(F.min("layout") == F.max("layout"), F.max("layout")).otherwise(F.raise_error(several))
    chosen = valid.groupBy("book_id", "page").agg(choice.alias("new_layout"))
    new = F.col("new_layout")
    if "corrected" not in layout.columns:
        layout = layout.withColumn("corrected", F.lit(False))
    return (
        layout.join(chosen, ["book_id", "page"], "left")
        .withColumn("old_layout", F.col("layout"))
        .withColumn("changed", F.coalesce(new != F.col("layout"), F.lit(False)))
        .withColumn("cuts", F.when(new.isNotNull(), ideal_cuts(new)).otherwise(F.col("cuts")))
        .withColumn("corrected", F.coalesce(F.col("corrected"), F.lit(False)) | new.isNotNull())
        .withColumn("layout", F.coalesce(new, F.col("layout")))
        .drop("new_layout")
    )


def page_layout(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """J1 + J2: every page with its layout and windows, two halves by default."""
    measured = F.when(F.size("cuts") > 0, F.col("cuts"))
    rows = layout.select(
        "book_id", "page", "layout", F.coalesce(measured, default_cuts(F.col("layout"))).alias("cuts")
    )
    return (
        pages.join(rows, ["book_id", "page"], "left")
        .withColumn("layout", F.coalesce("layout", F.lit("2-up")))
        # The always-true test ties the default to the pages' side.  Without
        # it Spark 4.1 may move a later cuts[i].x0 below the outer join, where
        # pages without a layout row have lost the default.
        .withColumn(
            "cuts", F.coalesce("cuts", F.when(F.col("page") >= 0, default_cuts(F.lit("2-up"))))
        )
    )
