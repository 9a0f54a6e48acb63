"""Title corrections over page titles, replies composed as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections as C
from ..operators import output as O
from ..sources.replies import read_replies
from . import query
from . import tables as t
from .text_queries import PAGE_TITLE

_TITLE = f"replace(replace({PAGE_TITLE}, '\"', ''), chr(92), '')"
MAN_COLUMNS = (
    "'site' || CAST(page_id % 3 AS STRING) AS book_id",
    "CAST(floor(page_id / 3) + 1 AS INTEGER) AS index",
    f"{_TITLE} || CASE WHEN page_id % 5 = 0 THEN ' 2026届' ELSE '' END AS name",
    "CAST(page_id AS INTEGER) AS src_start",
    "CAST(page_id + 1 AS INTEGER) AS src_end",
    "CAST(length(html) % 40 AS INTEGER) AS pdf_pages",
)
MAN = f"m AS (SELECT {', '.join(MAN_COLUMNS)} FROM pages)"


def manifest(spark, sf_dir):
    rows = t.table(spark, sf_dir, "pages").selectExpr(*MAN_COLUMNS)
    return rows.select(
        "*",
        F.concat("name", F.lit(".pdf")).alias("file"),
        *[F.lit(None).cast("string").alias(c) for c in ("school", "branch", "year")],
    )


# Documents of a few pages get no correction; a title can be corrected more than once.
FIX_COLUMNS = (
    "book_id",
    "name AS orig",
    "CASE WHEN index % 4 = 0 THEN 'a/b(北)初' || '2025届' WHEN index % 4 = 1 THEN '' WHEN index % 7 = 2 THEN NULL "
    "ELSE name || '2027届' END AS fixed",
    "CASE WHEN index % 5 = 0 THEN NULL ELSE 'high' END AS conf",
    "index AS seq",
)
FIXES = (
    f"f AS (SELECT {', '.join(FIX_COLUMNS)} FROM m WHERE pdf_pages >= 13), "
    "l AS (SELECT book_id, orig, fixed, conf FROM (SELECT *, row_number() OVER (PARTITION BY book_id, orig "
    "ORDER BY seq DESC) AS rn FROM f) WHERE rn = 1)"
)


def corrections(man):
    return man.filter("pdf_pages >= 13").selectExpr(*FIX_COLUMNS)


def _prefixed(x: str) -> str:
    return rf"replace(replace(regexp_replace(replace({x}, '初2', '§2'), '(\d{{4}})届', '初\1届', 'g'), '§初', '初'), '§', '初')"


PREVIEW = (
    f"{MAN}, {FIXES}, pv AS (SELECT m.book_id, m.index, m.name AS orig, {_prefixed('coalesce(l.fixed, m.name)')} AS fixed, "
    "CASE WHEN l.orig IS NULL THEN 'unchanged(missing)' ELSE coalesce(l.conf, '?') END AS conf, m.src_start, m.src_end, m.pdf_pages "
    "FROM m LEFT JOIN l ON l.book_id = m.book_id AND l.orig = m.name)"
)


@query("title_corrections", f"WITH {PREVIEW} SELECT book_id, index, orig, fixed, conf FROM pv")
def title_corrections(spark, sf_dir):
    man = manifest(spark, sf_dir)
    return C.preview(man, corrections(man))


_PARTS = r"^(.*?)(?:[(（](.*?)[)）])?\s*初\s*(\d{4})\s*届"
APPLIED = (
    PREVIEW
    + r""", b AS (SELECT *, coalesce(nullif(trim(regexp_replace(fixed, '[<>:"/\\|?*]', '_', 'g')), ''), orig) AS base FROM pv), """
    "d AS (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY index) AS rn FROM b), "
    "ap AS (SELECT *, base || CASE WHEN rn > 1 THEN '(' || rn || ')' ELSE '' END AS name FROM d)"
)


def _parsed(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{_PARTS}') THEN trim(regexp_extract({x}, '{_PARTS}', 1)) ELSE {x} END AS school, "
        f"CASE WHEN regexp_extract({x}, '{_PARTS}', 2) <> '' THEN trim(regexp_extract({x}, '{_PARTS}', 2)) END AS branch, "
        f"nullif(regexp_extract({x}, '{_PARTS}', 3), '') AS year"
    )


@query(
    "apply_corrections",
    f"WITH {APPLIED} SELECT book_id, index, name, name || '.pdf' AS file, orig || '.pdf' AS old_file, src_start, src_end, "
    f"pdf_pages, {_parsed('name')} FROM ap",
)
def apply_corrections(spark, sf_dir):
    man = manifest(spark, sf_dir)
    return C.apply_to_manifest(man, corrections(man))


@query(
    "correction_writeback",
    f"WITH {APPLIED}, ex AS (SELECT book_id, index AS idx, orig AS title FROM ap UNION ALL "
    "SELECT 'site1', CAST(100000 AS INTEGER), 'extra'), t AS (SELECT book_id, orig, any_value(fixed) AS fixed FROM pv GROUP BY ALL), "
    f"w AS (SELECT ex.book_id, ex.idx, CASE WHEN ex.book_id <> 'site1' THEN ap.name ELSE "
    rf"""trim(regexp_replace(coalesce(t.fixed, regexp_replace(ex.title, '\s+', '', 'g')), '[<>:"/\\|?*]', '_', 'g')) END AS title """
    "FROM ex LEFT JOIN ap ON ap.book_id = ex.book_id AND ap.index = ex.idx "
    r"LEFT JOIN t ON t.book_id = ex.book_id AND t.orig = regexp_replace(ex.title, '\s+', '', 'g')) "
    f"SELECT book_id, idx, title, {_parsed('title')} FROM w",
)
def correction_writeback(spark, sf_dir):
    man = manifest(spark, sf_dir)
    fixes = corrections(man)
    # A correction of a title that no manifest holds changes nothing.
    foreign = man.filter("book_id = 'site1' AND index = 1").selectExpr(
        "book_id", "'extra' AS orig", "'extra初2030届' AS fixed", "'high' AS conf", "index AS seq"
    )
    return C.write_back(_exams(man), man, fixes.unionByName(foreign))


def _exams(man):
    exam = man.select("book_id", F.col("index").alias("idx"), F.col("name").alias("title"))
    # One book has a document more than its manifest and is matched by title.
    first = exam.filter("book_id = 'site1' AND idx = 1")
    exam = exam.unionByName(
        first.select("book_id", F.lit(100000).alias("idx"), F.lit("extra").alias("title"))
    )
    return exam.select("*", *[F.lit(None).cast("string").alias(c) for c in ("school", "branch", "year")])


@query(
    "prompt_batches",
    f"WITH {MAN} SELECT book_id, CAST(floor((index - 1) / 6) AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_titles, "
    "string_agg(CAST((index - 1) % 6 + 1 AS STRING) || '. ' || name, chr(10) ORDER BY index) AS request FROM m GROUP BY ALL",
)
def prompt_batches(spark, sf_dir):
    return C.request_batches(manifest(spark, sf_dir))


# --- replies ----------------------------------------------------------------------------

_ITEM = "'{\"orig\":\"' || name || '\",\"fixed\":\"' || name || '!\",\"conf\":\"low\"}'"
_LIST = f"'[' || {_ITEM} || ',' || chr(10) || '{{\"orig\":\"x' || CAST(index AS STRING) || '\",\"fixed\":\"y [1]\",\"conf\":\"high\"}}]'"
REPLY_COLUMNS = (
    "book_id",
    "index AS batch",
    f"CASE index % 4 WHEN 0 THEN {_LIST} WHEN 1 THEN '```json' || chr(10) || {_LIST} || chr(10) || '```' "
    f"WHEN 2 THEN 'Here you are: ' || {_LIST} || ' done.' ELSE '' END AS content",
    f"CASE WHEN index % 4 = 3 THEN 'I think ' || {_LIST} END AS reasoning",
)


@query(
    "reply_flatten",
    f"WITH {MAN} SELECT book_id, index AS batch, 0 AS pos, name AS orig, name || '!' AS fixed, 'low' AS conf FROM m "
    "UNION ALL SELECT book_id, index, 1, 'x' || index, 'y [1]', 'high' FROM m",
)
def reply_flatten(spark, sf_dir):
    return read_replies(manifest(spark, sf_dir).selectExpr(*REPLY_COLUMNS))


_FROM_REPLIES = (
    f"{MAN}, b AS (SELECT book_id, index, name AS orig, {_prefixed("name || '!'")} AS fixed FROM m), "
    r"""u AS (SELECT *, trim(regexp_replace(fixed, '[<>:"/\\|?*]', '_', 'g')) AS base FROM b), """
    "d AS (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY index) AS rn FROM u), "
    "ap AS (SELECT *, base || CASE WHEN rn > 1 THEN '(' || rn || ')' ELSE '' END AS name FROM d), "
    "t AS (SELECT book_id, orig, any_value(base) AS base FROM u GROUP BY ALL), "
    "ex AS (SELECT book_id, index AS idx, orig AS title FROM b UNION ALL SELECT 'site1', CAST(100000 AS INTEGER), 'extra'), "
    "w AS (SELECT ex.book_id, ex.idx, CASE WHEN ex.book_id <> 'site1' THEN ap.name ELSE "
    # Titles that no correction names lose white space and illegal signs too.
    r"""coalesce(t.base, trim(regexp_replace(regexp_replace(ex.title, '\s+', '', 'g'), '[<>:"/\\|?*]', '_', 'g'))) END AS title """
    "FROM ex LEFT JOIN ap ON ap.book_id = ex.book_id AND ap.index = ex.idx "
    r"LEFT JOIN t ON t.book_id = ex.book_id AND t.orig = regexp_replace(ex.title, '\s+', '', 'g')) "
)


@query("titles_from_replies", f"WITH {_FROM_REPLIES} SELECT book_id, idx, title, {_parsed('title')} FROM w")
def titles_from_replies(spark, sf_dir):
    man = manifest(spark, sf_dir)
    return C.correct_titles(man.selectExpr(*REPLY_COLUMNS), man, _exams(man)).exam
