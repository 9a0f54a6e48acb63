"""Layout operators over ink profiles made of the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources import raster
from . import query
from . import tables as t

P = t.VECTOR_SCAN

CELLS = (
    f"p AS ({t.PROFILE_SQL}), cells AS (SELECT book_id, page, band, "
    "generate_subscripts(embedding, 1) - 1 AS x, unnest(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) * 100)) AS ink FROM p), "
    "eligible AS (SELECT book_id, page, band FROM cells GROUP BY ALL HAVING max(ink) >= 2.0), "
    "isl AS (SELECT book_id, page, band, x, x - row_number() OVER (PARTITION BY book_id, page, band ORDER BY x) AS g "
    "FROM cells WHERE ink < 12.0), "
    "runs AS (SELECT book_id, page, band, CAST(min(x) AS INTEGER) AS s, CAST(max(x) + 1 AS INTEGER) AS e "
    "FROM isl GROUP BY book_id, page, band, g HAVING count(*) >= 4)"
)


def _anchor(name: str, anchor: float) -> str:
    lo, hi = int(64 * max(0.0, anchor - 0.045)), int(64 * min(1.0, anchor + 0.045))
    return (
        f"b_{name} AS (SELECT book_id, page, band, centre FROM (SELECT *, row_number() OVER "
        "(PARTITION BY book_id, page, band ORDER BY ov DESC, s) AS rn FROM (SELECT *, "
        f"least(e, {hi}) - greatest(s, {lo}) AS ov, (greatest(s, {lo}) + least(e, {hi})) / 2.0 AS centre FROM runs) "
        "WHERE ov >= 4 * 0.6) WHERE rn = 1), "
        f"a_{name} AS (SELECT eligible.book_id, eligible.page, count(centre) / count(*) AS vote_{name}, "
        f"coalesce(median(centre) / 64, CAST({anchor!r} AS DOUBLE)) AS gutter_{name} "
        f"FROM eligible LEFT JOIN b_{name} USING (book_id, page, band) GROUP BY ALL)"
    )


VOTES = CELLS + ", " + ", ".join(_anchor(n, a) for n, a in L.ANCHORS.items()) + (
    ", v AS (SELECT * FROM a_c JOIN a_13 USING (book_id, page) JOIN a_23 USING (book_id, page))"
)
LAYOUTS = VOTES + (
    ", lay AS (SELECT *, CASE WHEN least(vote_13, vote_23) >= 0.4 AND least(vote_13, vote_23) > vote_c "
    "THEN '3-up' WHEN vote_c >= 0.4 THEN '2-up' ELSE '1-up' END AS layout FROM v)"
)


def _at(g: str, d: float) -> str:
    return f"round_even(least(1.0, greatest(0.0, {g} + CAST({d} AS DOUBLE))), 4)"


_A, _B = "least(gutter_13, gutter_23)", "greatest(gutter_13, gutter_23)"
CUTS = LAYOUTS + (
    ", cuts AS (SELECT book_id, page, 0 AS col, 0.0 AS x0, CASE layout WHEN '3-up' THEN "
    f"{_at(_A, 0.006)} WHEN '2-up' THEN {_at('gutter_c', 0.006)} ELSE 1.0 END AS x1 FROM lay "
    f"UNION ALL SELECT book_id, page, 1, CASE layout WHEN '3-up' THEN {_at(_A, -0.006)} ELSE {_at('gutter_c', -0.006)} END, "
    f"CASE layout WHEN '3-up' THEN {_at(_B, 0.006)} ELSE 1.0 END FROM lay WHERE layout <> '1-up' "
    f"UNION ALL SELECT book_id, page, 2, {_at(_B, -0.006)}, 1.0 FROM lay WHERE layout = '3-up')"
)


def layouts(spark, sf_dir):
    profile = t.profiles(spark, sf_dir)
    return L.classify_layout(profile, p=P)


def overrides(spark, sf_dir):
    """Every page gets a layout by hand; some values are invalid, some pages unknown."""
    pages = t.table(spark, sf_dir, "embeddings").selectExpr(*PAGE_COLUMNS).distinct()
    return pages.selectExpr(*OVERRIDE_COLUMNS)


PAGE_COLUMNS = (
    "'scan' || CAST(CAST(floor(vec_id / 12) AS BIGINT) % 5 AS STRING) AS book_id",
    "CAST(floor(vec_id / 12) AS BIGINT) AS page",
)
OVERRIDE_COLUMNS = (
    "book_id",
    "CASE WHEN page % 15 = 3 THEN page + 100000 ELSE page END AS page",
    f"{t.pick('page', ('1-up', ' 2-up ', '3-up', '4-up'))} AS layout",
)
OVERRIDES = f"o AS (SELECT {', '.join(OVERRIDE_COLUMNS)} FROM (SELECT DISTINCT {', '.join(PAGE_COLUMNS)} FROM embeddings))"


@query("blank_runs", f"WITH {CELLS} SELECT runs.* FROM runs SEMI JOIN eligible USING (book_id, page, band)")
def blank_runs(spark, sf_dir):
    return L.run_table(t.profiles(spark, sf_dir), P)


@query("blank_runs_by_rows", f"WITH {CELLS} SELECT * FROM runs")
def blank_runs_by_rows(spark, sf_dir):
    return L.blank_run_rows(t.profiles(spark, sf_dir), P)


@query("band_eligibility", f"WITH {CELLS} SELECT book_id, page, count(*) AS n_bands FROM eligible GROUP BY ALL")
def band_eligibility(spark, sf_dir):
    votes = L.band_votes(t.profiles(spark, sf_dir), P).filter("votes")
    return votes.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("n_bands"))


_ROUNDED = ", ".join(f"round({k}_{n}, 9) AS {k}_{n}" for n in L.ANCHORS for k in ("vote", "gutter"))


@query("gutter_votes", f"WITH {VOTES} SELECT book_id, page, {_ROUNDED} FROM v")
def gutter_votes(spark, sf_dir):
    votes = L.gutter_votes(L.band_votes(t.profiles(spark, sf_dir), P))
    return votes.select(
        "book_id",
        "page",
        *[F.round(f"{k}_{n}", 9).alias(f"{k}_{n}") for n in L.ANCHORS for k in ("vote", "gutter")],
    )


_LONG = " UNION ALL ".join(f"SELECT book_id, page, '{n}' AS anchor, round(vote_{n}, 9) AS vote, round(gutter_{n}, 9) AS gutter FROM v" for n in L.ANCHORS)


@query("anchor_votes", f"WITH {VOTES} {_LONG}")
def anchor_votes(spark, sf_dir):
    """The usual anchors as a table: two for all books, the middle one listed book by book."""
    profile = t.profiles(spark, sf_dir)
    rest = [(None, n, a) for n, a in L.ANCHORS.items() if n != "c"]
    middle = profile.select("book_id").distinct().withColumns({"anchor": F.lit("c"), "at": F.lit(L.ANCHORS["c"])})
    anchors = spark.createDataFrame(rest, "book_id string, anchor string, at double").unionByName(middle)
    found = L.anchor_votes(profile, anchors, P)
    return found.withColumns({c: F.round(c, 9) for c in ("vote", "gutter")})


@query(
    "classify_layout",
    f"WITH {LAYOUTS} SELECT book_id, page, layout, round_even(vote_c, 3) AS score_c, "
    "round_even(vote_13, 3) AS score_13, round_even(vote_23, 3) AS score_23 FROM lay",
)
def classify_layout(spark, sf_dir):
    return layouts(spark, sf_dir).drop("cuts", "corrected")


@query("cut_windows", f"WITH {CUTS} SELECT * FROM cuts")
def cut_windows(spark, sf_dir):
    return (
        layouts(spark, sf_dir)
        .select("book_id", "page", F.posexplode("cuts").alias("col", "w"))
        .select("book_id", "page", "col", "w.x0", "w.x1")
    )


@query(
    "layout_histogram",
    f"WITH {LAYOUTS} SELECT book_id, count(*) FILTER (layout = '1-up') AS n_1up, "
    "count(*) FILTER (layout = '2-up') AS n_2up, count(*) FILTER (layout = '3-up') AS n_3up FROM lay GROUP BY book_id",
)
def layout_histogram(spark, sf_dir):
    return L.layout_histogram(layouts(spark, sf_dir))


@query("suspect_pages", f"WITH {LAYOUTS} SELECT book_id, page, layout FROM lay WHERE layout = '1-up'")
def suspect_pages(spark, sf_dir):
    return L.suspect_pages(layouts(spark, sf_dir))


@query(
    "layout_overrides",
    f"WITH {LAYOUTS}, {OVERRIDES}, ok AS (SELECT book_id, page, trim(layout) AS nl FROM o "
    "WHERE trim(layout) IN ('1-up', '2-up', '3-up')) SELECT lay.book_id, lay.page, coalesce(nl, layout) AS layout, "
    "layout AS old_layout, coalesce(nl <> layout, false) AS changed, nl IS NOT NULL AS corrected, "
    "CASE WHEN nl IS NULL THEN NULL WHEN nl = '1-up' THEN 1.0 WHEN nl = '2-up' THEN 0.506 ELSE 0.3393 END AS new_x1 "
    "FROM lay LEFT JOIN ok ON ok.book_id = lay.book_id AND ok.page = lay.page",
)
def layout_overrides(spark, sf_dir):
    patched = L.apply_layout_overrides(layouts(spark, sf_dir), overrides(spark, sf_dir))
    first = F.when(F.col("corrected"), F.get("cuts", F.lit(0))["x1"])
    return patched.select(
        "book_id", "page", "layout", "old_layout", "changed", "corrected", first.alias("new_x1")
    )


@query(
    "rejected_overrides",
    f"WITH {OVERRIDES} SELECT book_id, page, trim(layout) AS layout FROM o "
    "WHERE trim(layout) NOT IN ('1-up', '2-up', '3-up')",
)
def rejected_overrides(spark, sf_dir):
    return L.split_overrides(overrides(spark, sf_dir))[1]


@query(
    "unknown_overrides",
    f"WITH {CELLS}, {OVERRIDES} SELECT book_id, page, layout FROM o ANTI JOIN "
    "(SELECT DISTINCT book_id, page FROM cells) USING (book_id, page)",
)
def unknown_overrides(spark, sf_dir):
    return L.unknown_overrides(layouts(spark, sf_dir), overrides(spark, sf_dir))


@query(
    "columns_per_layout",
    f"WITH {LAYOUTS} SELECT book_id, page, CASE layout WHEN '1-up' THEN 1 WHEN '3-up' THEN 3 ELSE 2 END AS n_cols FROM lay",
)
def columns_per_layout(spark, sf_dir):
    return layouts(spark, sf_dir).select(
        "book_id", "page", L.columns_per_layout(F.col("layout")).alias("n_cols")
    )


@query(
    "layout_lookup",
    f"WITH s AS ({t.STRIPS_SQL}) SELECT book_id, page, coalesce(layout, '2-up') AS layout, "
    "CASE coalesce(layout, '2-up') WHEN '1-up' THEN 1.0 WHEN '3-up' THEN 1.0 / 3 ELSE 0.5 END AS first_x1 FROM s",
)
def layout_lookup(spark, sf_dir):
    lay = t.page_layouts(spark, sf_dir).withColumn("cuts", L.default_cuts(F.col("layout")))
    rows = L.page_layout(t.page_sizes(spark, sf_dir), lay)
    return rows.select("book_id", "page", "layout", F.get("cuts", F.lit(0))["x1"].alias("first_x1"))


# --- rasters --------------------------------------------------------------------

# Each vector is a page of 24 rows by 64 columns: the value sets how deep the
# ink of its pixel column reaches, the row index cuts it off.
_PIXEL = "(CASE WHEN abs(CAST({v} AS DOUBLE)) * 100 > (r % 24) THEN 40 ELSE 230 END)"


RASTER_CELLS = (
    "px AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings), "
    f"cell AS (SELECT vec_id, x, r, {_PIXEL.format(v='v')} AS lum FROM px CROSS JOIN (SELECT unnest(range(24)) AS r)), "
    "bg AS (SELECT vec_id, quantile_cont(CAST(lum AS DOUBLE), 0.95) - 40 AS cut FROM cell GROUP BY vec_id), "
    "col AS (SELECT vec_id, CAST(floor(r / 2) AS INTEGER) AS band, x, "
    "avg(CASE WHEN lum < cut THEN 100.0 ELSE 0.0 END) AS ink FROM cell JOIN bg USING (vec_id) GROUP BY ALL)"
)
RASTER_LAYOUTS = (
    f"{RASTER_CELLS}, cells AS (SELECT 'scan' || CAST(vec_id % 5 AS STRING) AS book_id, vec_id AS page, band, x, ink FROM col), "
    + LAYOUTS[LAYOUTS.index("eligible AS") :]
)
_RASTER_PROFILE = (
    f"WITH {RASTER_CELLS} SELECT 'raster' AS book_id, vec_id AS page, band, count(*) AS n_cols, sum(ink) AS total_ink, "
    "sum(ink * x) AS ink_moment FROM col GROUP BY ALL"
)


def rasters(spark, sf_dir, book="'raster'"):
    """A page per vector, 24 rows of 64 pixels."""
    vec = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    row = f"transform(embedding, v -> lpad(hex({_PIXEL.format(v='v')}), 2, '0'))"
    return vec.selectExpr(
        f"{book} AS book_id",
        "vec_id AS page",
        "64 AS w",
        "24 AS h",
        "1 AS n",
        f"unhex(array_join(transform(sequence(0, 23), r -> array_join({row}, '')), '')) AS samples",
    )


def _moments(profile):
    weighted = F.transform("ink", lambda v, x: v * x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return profile.select(
        "book_id",
        "page",
        "band",
        F.size("ink").cast("long").alias("n_cols"),
        total(F.col("ink")).alias("total_ink"),
        total(weighted).alias("ink_moment"),
    )


@query("ink_profile", _RASTER_PROFILE)
def ink_profile(spark, sf_dir):
    return _moments(raster.ink_profile(rasters(spark, sf_dir)))


@query("ink_profile_of_tiles", _RASTER_PROFILE)
def ink_profile_of_tiles(spark, sf_dir):
    """Five rows a tile, so tiles and bands cut each other."""
    return _moments(raster.ink_profile_of_tiles(raster.tiles(rasters(spark, sf_dir), 5)))
