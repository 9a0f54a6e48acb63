"""Work lists, slice plans, names and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import output as O
from . import query
from . import tables as t
from .segment_queries import TURNS, turn_segments
from .text_queries import PAGE_TITLE

# Plain windows of the composed layouts.
_CUTS = (
    f"s AS (SELECT source AS book_id, doc_id AS page, doc_id, coalesce({t.LAYOUT}, '2-up') AS layout, "
    f"{t.PAGE_W} AS w, {t.PAGE_H} AS h FROM documents), "
    "c AS (SELECT s.*, n AS col, CASE layout WHEN '1-up' THEN 0.0 WHEN '2-up' THEN CAST(0.5 AS DOUBLE) * n "
    "ELSE CAST(n AS DOUBLE) / 3 END AS x0, CASE layout WHEN '1-up' THEN 1.0 WHEN '2-up' THEN CAST(0.5 AS DOUBLE) * (n + 1) "
    "WHEN '3-up' THEN CASE n WHEN 2 THEN 1.0 ELSE CAST(n + 1 AS DOUBLE) / 3 END END AS x1 "
    "FROM s JOIN (SELECT unnest(range(3)) AS n) ON n < CASE layout WHEN '1-up' THEN 1 WHEN '2-up' THEN 2 ELSE 3 END)"
)


def layouts(spark, sf_dir):
    return t.page_layouts(spark, sf_dir)


def _scale(w: str, h: str, dpi: int) -> str:
    base = f"(CAST({dpi} AS DOUBLE) / 72)"
    return f"CASE WHEN greatest({w}, {h}) * {base} > 10000 THEN 10000.0 / greatest({w}, {h}) ELSE {base} END"


@query(
    "read_worklist",
    f"WITH {_CUTS}, r AS (SELECT book_id, page, layout, CAST(col AS INTEGER) AS col, x0, x1, w, h FROM c UNION ALL "
    "SELECT book_id, page, layout, NULL, 0.0, 1.0, w, h FROM s WHERE layout <> '1-up'), "
    f"z AS (SELECT *, CAST({_scale('w', 'h', 250)} AS DOUBLE) AS scale FROM r), "
    "p AS (SELECT *, ceil(w * scale - 0.001) AS pw, ceil(h * scale - 0.001) AS ph FROM z) "
    "SELECT book_id, page, layout, col, scale, CAST(floor(pw * x0) AS INTEGER) AS left, CAST(floor(pw * x1) AS INTEGER) AS right, "
    "CAST(floor(ph * CAST(0.6 AS DOUBLE)) AS INTEGER) AS bottom FROM p",
)
def read_worklist(spark, sf_dir):
    return O.read_worklist(t.page_sizes(spark, sf_dir), layouts(spark, sf_dir))


@query(
    "crop_windows",
    f"WITH {_CUTS} SELECT book_id, page, col, round(x0 * w, 6) AS left_pt, round(x1 * w, 6) AS right_pt FROM c",
)
def crop_windows(spark, sf_dir):
    rows = L.page_layout(t.page_sizes(spark, sf_dir), layouts(spark, sf_dir))
    cuts = rows.select("book_id", "page", "width", F.posexplode("cuts").alias("col", "c"))
    return cuts.select(
        "book_id", "page", "col",
        F.round(F.col("c.x0") * F.col("width"), 6).alias("left_pt"),
        F.round(F.col("c.x1") * F.col("width"), 6).alias("right_pt"),
    )


# The turns of conversations as source pages of two columns, some very wide.
_TURN_W = "CAST(600 + conv_id % 7 * 1200 AS DOUBLE)"


def _turn_pages(spark, sf_dir):
    conv = t.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return conv.selectExpr(
        "CAST(conv_id AS STRING) AS book_id", "turn AS page", f"{_TURN_W} AS width", "CAST(842 AS DOUBLE) AS height"
    )


def _no_layout(spark):
    return spark.createDataFrame(
        [], "book_id string, page bigint, layout string, cuts array<struct<x0:double,x1:double>>"
    )


_SLICES = (
    f"{TURNS}, wide AS (SELECT CAST(conv_id AS STRING) AS book_id, turn AS page, {_TURN_W} AS w FROM conversations), "
    f"sl AS (SELECT seg.book_id, idx, seq AS out_page, seg.page, CAST(0.0 AS DOUBLE) AS x0, w * 0.5 AS x1, "
    f"CAST({_scale('w * 0.5', '842', 200)} AS DOUBLE) AS scale FROM seg JOIN wide ON wide.book_id = seg.book_id AND wide.page = seg.page)"
)


@query(
    "slice_plan",
    f"WITH {_SLICES} SELECT book_id, idx, out_page, page, x0, x1, scale, CAST(ceil(x1 * scale - 0.001) AS INTEGER) AS px_w, "
    "CAST(ceil(842 * scale - 0.001) AS INTEGER) AS px_h FROM sl",
)
def slice_plan(spark, sf_dir):
    plan = O.slice_plan(turn_segments(spark, sf_dir), _no_layout(spark), _turn_pages(spark, sf_dir))
    return plan.drop("col")


@query(
    "whole_page_segments",
    f"WITH {_CUTS}, x AS (SELECT doc_id AS first, doc_id + 3 AS last, source, doc_id FROM documents), "
    "p AS (SELECT x.doc_id AS idx, x.source AS book_id, unnest(range(first, last + 1)) AS page FROM x), "
    "j AS (SELECT p.book_id, p.idx, p.page, coalesce(c.col, two.n) AS col FROM p "
    "LEFT JOIN c ON c.book_id = p.book_id AND c.page = p.page "
    "LEFT JOIN (SELECT unnest(range(2)) AS n) two ON c.page IS NULL) "
    "SELECT book_id, idx, CAST(row_number() OVER (PARTITION BY book_id, idx ORDER BY page, col) AS INTEGER) AS seq, page, col FROM j",
)
def whole_page_segments(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    exam = docs.selectExpr(
        "source AS book_id", "doc_id AS idx", "CAST(doc_id AS INT) AS start", "CAST(doc_id + 3 AS INT) AS end"
    )
    return O.whole_page_segments(exam, layouts(spark, sf_dir))


# --- names ---------------------------------------------------------------------------

NAMED_COLUMNS = (
    "'site' || CAST(page_id % 3 AS STRING) AS book_id",
    "CAST(page_id + 1 AS INTEGER) AS index",
    f"CASE WHEN page_id % 4 = 0 THEN 'same' WHEN page_id % 11 = 1 THEN 'same(2)' ELSE {PAGE_TITLE} END AS name",
    "CAST(length(html) % 40 AS INTEGER) AS pdf_pages",
)
NAMED = f"m AS (SELECT {', '.join(NAMED_COLUMNS)} FROM pages)"


def named(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").selectExpr(*NAMED_COLUMNS)


DEDUPED = (
    "d AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY index) AS rn FROM m), "
    "u AS (SELECT book_id, index, pdf_pages, name || CASE WHEN rn > 1 THEN '(' || rn || ')' ELSE '' END AS name FROM d)"
)


@query("name_dedupe", f"WITH {NAMED}, {DEDUPED} SELECT book_id, index, name FROM u")
def name_dedupe(spark, sf_dir):
    return O.unique_names(named(spark, sf_dir), "name", "index").select("book_id", "index", "name")


@query(
    "name_dedupe_strict",
    f"WITH {NAMED}, {DEDUPED}, a AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY index) AS again FROM u) "
    "SELECT book_id, index, name || CASE WHEN again > 1 THEN ' #' || index ELSE '' END AS name FROM a",
)
def name_dedupe_strict(spark, sf_dir):
    return O.unique_names(named(spark, sf_dir), "name", "index", "strict").select("book_id", "index", "name")


@query(
    "manifest_totals",
    f"WITH {NAMED} SELECT book_id, count(*) AS exams, CAST(sum(pdf_pages) AS BIGINT) AS pages FROM m GROUP BY book_id",
)
def manifest_totals(spark, sf_dir):
    return O.manifest_totals(named(spark, sf_dir))


@query(
    "file_list",
    f"WITH {NAMED} SELECT book_id, name || '.pdf' AS file FROM m "
    "WHERE index % 5 <> 0 UNION ALL SELECT DISTINCT book_id, '_manifest.json' FROM m",
)
def file_list(spark, sf_dir):
    files = named(spark, sf_dir).withColumn(
        "file", F.concat("name", F.when(F.col("index") % 5 == 0, ".txt").otherwise(".pdf"))
    )
    return O.result_files(files)


@query("first_exams", f"WITH {NAMED} SELECT book_id, index, name FROM m QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY index) <= 4")
def first_exams(spark, sf_dir):
    return O.first_exams(named(spark, sf_dir)).select("book_id", "index", "name")
