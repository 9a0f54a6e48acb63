"""Segmentation of ordered columns, and the whole run from texts to manifest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import segments as G
from ..operators.ordered import balanced_lookup, carry_forward, hot_keys, rank_in_group
from ..operators.subpages import detect_headers
from ..plans import collection
from ..plans.storage import materialize
from ..rules import CN_EXAM
from . import layout_queries as LQ
from . import query
from . import tables as t
from .header_queries import OVERRIDES_SQL, subpages
from .header_queries import title_overrides as overrides_by_hand

TURNS = f"r AS ({t.TURNS_SQL}), {t.segment_ctes('r')}"
# A width below the page count of the larger books, so segments cross blocks.
WIDTH = 3


def turn_segments(spark, sf_dir):
    return G.segment_columns(t.turn_subpages(spark, sf_dir), WIDTH)


@query("segment_columns", f"WITH {TURNS} SELECT book_id, idx, seq, page, col FROM seg")
def segment_columns(spark, sf_dir):
    return turn_segments(spark, sf_dir).select("book_id", "idx", "seq", "page", "col")


@query(
    "exam_rollup",
    f'WITH {TURNS} SELECT book_id, idx, min(page) AS "start", max(page) AS "end", CAST(count(*) AS INTEGER) AS n_columns, '
    "min(fk) AS title FROM seg GROUP BY book_id, idx",
)
def exam_rollup(spark, sf_dir):
    return G.roll_up(turn_segments(spark, sf_dir)).select(
        "book_id", "idx", "start", "end", "n_columns", "title"
    )


@query("output_pages", f"WITH {TURNS} SELECT book_id, idx, seq AS out_page, page FROM seg")
def output_pages(spark, sf_dir):
    return turn_segments(spark, sf_dir).select("book_id", "idx", F.col("seq").alias("out_page"), "page")


@query(
    "nested_segments",
    f"WITH {TURNS} SELECT book_id, idx, CAST(floor((seq - 1) / 2) AS INTEGER) AS part, count(*) AS n, "
    "string_agg(CAST(page AS VARCHAR), ',' ORDER BY seq) AS pages FROM seg GROUP BY ALL",
)
def nested_segments(spark, sf_dir):
    parts = G.nested_segments(turn_segments(spark, sf_dir), part_size=2)
    return parts.select(
        "book_id", "idx", "part", F.size("segments").cast("long").alias("n"),
        F.array_join(F.transform("segments", lambda s: s["page"].cast("string")), ",").alias("pages"),
    )


@query(
    "interior_columns",
    f"WITH {TURNS}, n AS (SELECT book_id, idx, count(*) AS n FROM seg GROUP BY book_id, idx) "
    "SELECT book_id, idx, seq, page FROM seg JOIN n USING (book_id, idx) WHERE n > 2 AND seq > 1 AND seq < n",
)
def interior_columns(spark, sf_dir):
    segs = turn_segments(spark, sf_dir)
    return G.interior(segs, G.roll_up(segs), 2).select("book_id", "idx", "seq", "page")


@query(
    "segment_text",
    f"WITH {TURNS} SELECT seg.book_id, idx, seq, length(text) AS n FROM seg JOIN conversations c "
    "ON CAST(c.conv_id AS STRING) = seg.book_id AND c.turn = seg.page",
)
def segment_text(spark, sf_dir):
    texts = t.table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS book_id", "turn AS page", "0 AS col", "length(text) AS n"
    )
    segs = turn_segments(spark, sf_dir)
    return segs.join(texts, ["book_id", "page", "col"]).select("book_id", "idx", "seq", "n")


@query(
    "recent_carry",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recent FROM conversations",
)
def recent_carry(spark, sf_dir):
    conv = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = F.when(F.col("role") == "user", F.length("text"))
    rows = conv.select("conv_id", "turn", own.alias("own"))
    return carry_forward(rows, ["conv_id"], "turn", "own", "recent", WIDTH).drop("own")


@query(
    "rank_in_group",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS INTEGER) AS rn FROM documents",
)
def ranked(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return rank_in_group(docs, ["source", "lang"], "doc_id", "rn", width=64).select("doc_id", "rn")


@query("balanced_lookup", "SELECT doc_id, source, n FROM documents JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)")
def balanced(spark, sf_dir):
    """The size of its source for every document, frequent sources dealt out."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return balanced_lookup(docs, sizes, "source", F.col("doc_id"), hot_keys(docs, "source", 32), "inner")


# --- the whole run -------------------------------------------------------------------

IDENT = "CASE WHEN volume THEN 'V' || title ELSE school || '|' || coalesce(branch, '') || '|' || coalesce(year, '') || '|' || title END"


def run_sql(columns: str, extra: str = "", strips: str = t.STRIPS_SQL) -> str:
    """CTEs from header columns to the manifest ``man``."""
    return (
        "WITH "
        + t.expected_columns(strips)
        + extra
        + f", r AS (SELECT book_id, page, col, is_toc OR is_answer AS closed, {IDENT} AS k, school, branch, year, title FROM {columns}), "
        + t.segment_ctes("r")
        + ', exam AS (SELECT book_id, idx, min(page) AS "start", max(page) AS "end", count(*) AS n_columns, '
        "max(CASE WHEN opens = 1 THEN title END) AS title, max(CASE WHEN opens = 1 THEN school END) AS school, "
        "max(CASE WHEN opens = 1 THEN branch END) AS branch, max(CASE WHEN opens = 1 THEN year END) AS year "
        "FROM seg GROUP BY book_id, idx), "
        "named AS (SELECT *, row_number() OVER (PARTITION BY book_id, title ORDER BY idx) AS rn FROM exam), "
        "man AS (SELECT book_id, idx, n_columns, title || CASE WHEN rn > 1 THEN '(' || rn || ')' ELSE '' END AS name, "
        '"start", "end", school, branch, year FROM named)'
    )


RUN = run_sql("k")
SHOWN = (
    ' SELECT book_id, idx AS index, name, name || \'.pdf\' AS file, "start" AS src_start, "end" AS src_end, '
    "CAST(n_columns AS INTEGER) AS pdf_pages, school, branch, year FROM man"
)
MANIFEST = RUN + SHOWN
OVERRIDDEN = f", {OVERRIDES_SQL}, ko AS (SELECT k.book_id, k.page, k.col, " + ", ".join(
    f"CASE WHEN ovt.page IS NULL THEN k.{c} ELSE ovt.{c} END AS {c}" for c in ("school", "branch", "year", "title")
) + (
    ", k.volume AND ovt.page IS NULL AS volume, k.is_answer AND ovt.page IS NULL AS is_answer, "
    "k.is_toc AND ovt.page IS NULL AS is_toc FROM k LEFT JOIN ovt ON ovt.book_id = k.book_id AND ovt.page = k.page)"
)


def inputs(spark, sf_dir):
    return collection.Inputs(
        page_strip=t.page_strips(spark, sf_dir),
        pages=t.page_sizes(spark, sf_dir),
        layout=t.page_layouts(spark, sf_dir),
    )


@query("end_to_end", MANIFEST)
def end_to_end(spark, sf_dir):
    return collection.split_collections(inputs(spark, sf_dir), keep=materialize).manifest


@query("end_to_end_lazy", MANIFEST)
def end_to_end_lazy(spark, sf_dir):
    return collection.split_collections(inputs(spark, sf_dir)).manifest


@query(
    "segmented_pages",
    RUN + " SELECT book_id, idx, seq, page, col FROM seg",
)
def segmented_pages(spark, sf_dir):
    return G.segment_columns(subpages(spark, sf_dir), 64).select("book_id", "idx", "seq", "page", "col")


@query(
    "long_exam_check",
    RUN + ', long AS (SELECT * FROM exam WHERE n_columns > 4), hid AS (SELECT seg.book_id, seg.idx, count(*) AS h FROM seg '
    "JOIN long ON long.book_id = seg.book_id AND long.idx = seg.idx WHERE seq > 1 AND seq < n_columns "
    "AND seg.title IS NOT NULL AND NOT starts_with(k, 'V') GROUP BY ALL) "
    'SELECT long.book_id, long.idx, title, "start", "end", CAST(n_columns AS INTEGER) AS n_columns, '
    "CAST(coalesce(h, 0) AS INTEGER) AS n_hidden, CASE WHEN h IS NULL THEN 'verified' ELSE 'hidden' END AS verdict "
    "FROM long LEFT JOIN hid ON hid.book_id = long.book_id AND hid.idx = long.idx",
)
def long_exam_check(spark, sf_dir):
    return collection.split_collections(inputs(spark, sf_dir), keep=materialize).verify()[0]


# What the relaxed rules read from a column by itself: the year as a session, no school from the whole page.
@query(
    "hidden_headers",
    run_sql("ko", OVERRIDDEN) + ", long AS (SELECT book_id, idx, n_columns FROM exam WHERE n_columns > 2) "
    "SELECT seg.book_id, seg.idx, seg.page, seg.col, CASE kk.kind WHEN 1 THEN replace(kk.title, '级新初一', '届新初一') "
    "WHEN 2 THEN '某校' || substr(kk.title, strpos(kk.title, '初')) ELSE kk.title END AS hidden_title "
    "FROM seg JOIN long ON long.book_id = seg.book_id AND long.idx = seg.idx "
    "JOIN k AS kk ON kk.book_id = seg.book_id AND kk.page = seg.page AND kk.col = seg.col "
    "WHERE seq > 1 AND seq < n_columns AND kk.kind IN (0, 1, 2, 3) AND kk.title IS NOT NULL",
)
def hidden_headers(spark, sf_dir):
    """Headers inside documents of more than two columns, a row each; a page titled by hand may hide some."""
    by_hand = replace(inputs(spark, sf_dir), title_overrides=overrides_by_hand(spark, sf_dir))
    found = collection.split_collections(by_hand, replace(CN_EXAM, long_exam_pages=2), keep=materialize).verify()[1]
    return found.select("book_id", "idx", "page", "col", "hidden_title")


@query("override_run", run_sql("ko", OVERRIDDEN) + SHOWN)
def override_run(spark, sf_dir):
    given = inputs(spark, sf_dir)
    by_hand = collection.Inputs(
        page_strip=given.page_strip,
        pages=given.pages,
        layout=given.layout,
        title_overrides=overrides_by_hand(spark, sf_dir),
    )
    return collection.split_collections(by_hand, keep=materialize).manifest


# --- from profiles and rasters, leading pages skipped, both kinds of override ------------------

_SCAN_BOOK = "'scan' || CAST(doc_id % 5 AS STRING)"
SKIP = 2


def _scanned(votes: str, book: str) -> str:
    """Strips whose layout is what ``votes`` (CTEs up to ``lay``) finds, corrected by hand."""
    return (
        f"WITH {votes}, {LQ.OVERRIDES}, ok AS (SELECT book_id, page, trim(layout) AS nl FROM o WHERE trim(layout) IN ('1-up', '2-up', '3-up')), "
        f"base AS (SELECT {book} AS scan, * FROM ({t.STRIPS_SQL})), "
        "z AS (SELECT base.scan, base.page, c0, c1, c2, full_text, doc_id, coalesce(ok.nl, lay.layout, '1-up') AS layout FROM base "
        "LEFT JOIN lay ON lay.book_id = base.scan AND lay.page = base.page LEFT JOIN ok ON ok.book_id = base.scan AND ok.page = base.page "
        f"WHERE base.page > {SKIP}) "
        "SELECT scan AS book_id, page, c0, c1, c2, full_text, layout, CASE layout WHEN '1-up' THEN 1 WHEN '3-up' THEN 3 ELSE 2 END AS n_cols, doc_id FROM z"
    )


def _scanned_inputs(spark, sf_dir, **source):
    scan = lambda df: df.withColumn("book_id", F.expr("'scan' || CAST(page % 5 AS STRING)"))
    return collection.Inputs(
        page_strip=scan(t.page_strips(spark, sf_dir)),
        pages=scan(t.page_sizes(spark, sf_dir)),
        layout_overrides=LQ.overrides(spark, sf_dir),
        title_overrides=scan(overrides_by_hand(spark, sf_dir)),
        skip=SKIP,
        **source,
    )


_BY_HAND = OVERRIDDEN.replace("source AS book_id", f"{_SCAN_BOOK} AS book_id")


@query("end_to_end_from_profiles", run_sql("ko", _BY_HAND, _scanned(LQ.LAYOUTS, _SCAN_BOOK)) + SHOWN)
def end_to_end_from_profiles(spark, sf_dir):
    given = _scanned_inputs(spark, sf_dir, profile=t.profiles(spark, sf_dir))
    return collection.split_collections(given, scan=t.VECTOR_SCAN, keep=materialize).manifest


_RASTER_BOOK = "'scan' || CAST(vec_id % 5 AS STRING)"


@query("end_to_end_from_rasters", run_sql("ko", _BY_HAND, _scanned(LQ.RASTER_LAYOUTS, _SCAN_BOOK)) + SHOWN)
def end_to_end_from_rasters(spark, sf_dir):
    given = _scanned_inputs(spark, sf_dir, raster=LQ.rasters(spark, sf_dir, _RASTER_BOOK))
    return collection.split_collections(given, scan=t.VECTOR_SCAN, keep=materialize).manifest


# --- recompute ---------------------------------------------------------------------------


def poor_pages(spark, sf_dir):
    """Pages of poor documents are corrected to one column."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    poor = t.table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return docs.join(poor, "doc_id", "left_semi").selectExpr("source AS book_id", "doc_id AS page", "'1-up' AS layout")


def layout_corrections(spark, sf_dir):
    """Those of them that have a layout to correct; a recompute refuses others."""
    known = t.page_layouts(spark, sf_dir).select("book_id", "page")
    return poor_pages(spark, sf_dir).join(known, ["book_id", "page"], "left_semi")


_POOR = "SELECT doc_id FROM labels WHERE quality = 0"


@query(
    "touched_pages",
    f"SELECT source AS book_id, doc_id AS page, length(text) AS n FROM documents WHERE doc_id IN ({_POOR})",
)
def touched_pages(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id", "doc_id AS page", "length(text) AS n"
    )
    return collection.touched(docs, poor_pages(spark, sf_dir))


@query("recompute_book")
def recompute_book(spark, sf_dir):
    given = inputs(spark, sf_dir)
    fixes = layout_corrections(spark, sf_dir)
    again = collection.touched(given.page_strip, fixes).withColumn(
        "cols", F.array(F.concat(F.get("cols", F.lit(0)), F.lit("\n"), F.get("cols", F.lit(1))))
    )
    return collection.recompute(given, fixes, again, keep=materialize).manifest


# Touched pages are read again as one column; only their books are computed.
_HIT = f"({t.LAYOUT} IS NOT NULL AND doc_id IN ({_POOR}))"
_AGAIN = (
    "SELECT book_id, page, CASE WHEN hit THEN c0 || chr(10) || '正文内容' ELSE c0 END AS c0, CASE WHEN NOT hit THEN c1 END AS c1, "
    "CASE WHEN NOT hit THEN c2 END AS c2, full_text, CASE WHEN hit THEN '1-up' ELSE layout END AS layout, "
    f"CASE WHEN hit THEN 1 ELSE n_cols END AS n_cols, doc_id FROM (SELECT *, {_HIT} AS hit FROM ({t.STRIPS_SQL})) "
    f"WHERE book_id IN (SELECT source FROM documents WHERE {_HIT})"
)


@query("recompute_pages", run_sql("k", strips=_AGAIN) + SHOWN)
def recompute_pages(spark, sf_dir):
    """As recompute_book, the second column's header gone; only new readings are searched for headers."""
    given = inputs(spark, sf_dir)
    fixes = layout_corrections(spark, sf_dir)
    again = collection.touched(given.page_strip, fixes).withColumn(
        "cols", F.array(F.concat(F.get("cols", F.lit(0)), F.lit("\n正文内容")))
    )
    known = replace(given, detected=materialize(detect_headers(given.page_strip), "detected"))
    return collection.recompute(known, fixes, again, keep=materialize).manifest
