"""The given tables in the roles our operators expect.

Scalar SQL in this module is valid in Spark and in DuckDB alike, so a query
and its oracle start from the same derived rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import SCAN

# The vectors serve as ink profiles; this level leaves blank runs in them.
VECTOR_SCAN = replace(SCAN, blank_ink=12.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them.

    The braces make the path a pattern, which only this name fits: Spark takes a
    plain path of a stream for a folder, and the files of a folder have other names.
    """
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


# --- page texts out of documents ---------------------------------------------

NL = "chr(10)"
SCHOOLS = (
    "成都某嘉祥外国语学校",
    "成都某七中育才学校",
    "四川某师大一中",
    "自贡某蜀光中学",
    "成都某石室联合中学（北城）",
    "某实验学校",
)
SUBJECT_CYCLE = ("数学", "语文", "英语")
VOLUMES = ("一", "二", "三", "十四")


def pick(n: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE CAST(floor({n}) AS BIGINT) % {len(values)} {cases} END)"


def part(n: int) -> str:
    """Digit ``n`` of doc_id in base 9: which kind of header the column gets."""
    return f"(CAST(floor(doc_id / {9**n}) AS BIGINT) % 9)"


YEAR = "CAST(2024 + doc_id % 4 AS STRING)"
SUBJECT = pick("doc_id", SUBJECT_CYCLE)
VOLUME = pick("doc_id", VOLUMES)


def school(col: int) -> str:
    return pick(f"doc_id + {col}", SCHOOLS)


def full_header(col: int, year: str = YEAR) -> str:
    return f"({school(col)} || '初' || {year} || '届新初一分班真卷' || {SUBJECT})"


def header_text(col: int) -> str:
    return (
        f"(CASE {part(col)} "
        f"WHEN 0 THEN '⑫' || {full_header(col)} "
        f"WHEN 1 THEN {school(col)} || {NL} || '初' || {YEAR} || '级新初一分班（奖学金）' || {NL} || '真卷' || {SUBJECT} "
        f"WHEN 2 THEN {YEAR} || ' 届新初一分班真卷闫语' "
        f"WHEN 3 THEN {school(col)} || {NL} || '满分：120 时间：90分钟' "
        f"WHEN 4 THEN '公立名校初一新生入学(' || {NL} || '分班)考试真卷精编（' || {VOLUME} "
        f"WHEN 5 THEN '参考 答案' ELSE '' END)"
    )


IS_CONTENTS = "(doc_id % 44 = 0)"
CONTENTS = f" || {NL} || '正文正文正文' || {NL} || ".join(
    full_header(0, f"'{y}'") for y in (2024, 2025, 2026, 2027)
)
COL0 = f"((CASE WHEN {IS_CONTENTS} THEN {CONTENTS} ELSE {header_text(0)} END) || {NL} || text)"
COL1 = f"({header_text(1)} || {NL} || '正文内容')"
COL2 = f"({header_text(2)} || {NL} || '正文内容')"
LAYOUT = "(CASE doc_id % 4 WHEN 0 THEN '1-up' WHEN 1 THEN '2-up' WHEN 2 THEN '3-up' END)"
N_COLS = "(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END)"
FULL = f"(CASE WHEN doc_id % 4 = 0 THEN '' ELSE '成都 吕 西川 ' || {YEAR} || {NL} || 'x' END)"

STRIPS_SQL = (
    f"SELECT source AS book_id, doc_id AS page, {COL0} AS c0, {COL1} AS c1, {COL2} AS c2, "
    f"{FULL} AS full_text, {LAYOUT} AS layout, {N_COLS} AS n_cols, doc_id FROM documents"
)


def page_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, page, cols, full): one book per source, one page per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.selectExpr(
        "source AS book_id",
        "doc_id AS page",
        f"array({COL0}, {COL1}, {COL2}) AS cols",
        f"{FULL} AS full",
    )


def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout rows for three pages in four; the rest falls back to two columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        docs.selectExpr("source AS book_id", "doc_id AS page", f"{LAYOUT} AS layout")
        .filter("layout IS NOT NULL")
        .withColumn("cuts", F.lit(None).cast("array<struct<x0:double,x1:double>>"))
    )


PAGE_W = "CAST(600 + doc_id % 5 * 900 AS DOUBLE)"
PAGE_H = "CAST(842 AS DOUBLE)"


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.selectExpr(
        "source AS book_id", "doc_id AS page", f"{PAGE_W} AS width", f"{PAGE_H} AS height"
    )


# What the rules find in the composed headers, column by column.
def expected_columns(strips: str = STRIPS_SQL) -> str:
    """CTEs from ``s`` (the strips) to ``k``: one row per page and column with
    its header, the closing flags and the identity used for segmentation."""
    per_col = []
    for c in range(3):
        kind = part(c)
        toc = f"({IS_CONTENTS} AND {c} = 0)"
        bare = f"regexp_replace({school(c)}, '（.*$', '')"
        branch = f"nullif(regexp_extract({school(c)}, '（(.*)）', 1), '')"
        recovered = f"(CASE WHEN doc_id % 4 = 0 THEN '某校' ELSE '成都某西川中学' END)"
        per_col.append(
            f"SELECT book_id, page, {c} AS col, n_cols, layout, "
            f"(CASE WHEN {toc} THEN 0 ELSE {kind} END) AS kind, {toc} AS toc, "
            f"(CASE WHEN {toc} THEN '2024' ELSE {YEAR} END) AS y, "
            f"{bare} AS bare, {branch} AS branch, {school(c)} AS shown, {SUBJECT} AS subj, "
            f"{VOLUME} AS vol, {recovered} AS recovered FROM s"
        )
    return (
        f"s AS ({strips}), "
        + BOOK_SUBJECT_CTES
        + ", q AS ("
        + " UNION ALL ".join(per_col)
        + "), h AS (SELECT q.book_id, q.page, q.col, q.kind, q.toc, q.layout, "
        "CASE WHEN kind IN (0, 1, 3) THEN bare WHEN kind = 2 THEN recovered "
        "WHEN kind = 4 THEN '公立名校初一新生入学' END AS school, "
        "CASE WHEN kind IN (0, 1, 3) THEN branch END AS branch, "
        "CASE WHEN kind IN (0, 1, 2) THEN y WHEN kind = 4 THEN vol END AS own_year, "
        "CASE kind WHEN 0 THEN shown || '初' || y || '届新初一分班真卷' || subj "
        "WHEN 1 THEN shown || '初' || y || '级新初一分班（奖学金）真卷' || subj "
        "WHEN 2 THEN recovered || '初' || y || '届新初一分班真卷英语' "
        "WHEN 3 THEN shown || '新初一分班真卷' || coalesce(subject, '英语') "
        "WHEN 4 THEN '公立名校初一新生入学(分班)考试真卷精编(' || vol || ')' END AS title "
        "FROM q LEFT JOIN subj ON subj.book_id = q.book_id WHERE q.col < q.n_cols), "
        # W8: a missing year is the nearest to the left on the page.
        "k AS (SELECT book_id, page, col, kind, toc, layout, school, branch, title, "
        "kind = 4 AS volume, CASE WHEN title IS NOT NULL THEN coalesce(own_year, last_value(own_year IGNORE NULLS) "
        "OVER (PARTITION BY book_id, page ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS year, "
        "max(CASE WHEN kind = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page) = 1 AS is_answer, "
        "max(CASE WHEN toc AND layout = '1-up' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page) = 1 AS is_toc "
        "FROM h)"
    )


def _subject_hits() -> str:
    words = ("数学", "语文", "英语", "科学", "物理", "化学", "综合")
    return " UNION ALL ".join(
        f"SELECT book_id, page, seq, {i} AS word_no, '{w}' AS subject FROM texts WHERE contains(t, '{w}')"
        for i, w in enumerate(words)
    )


BOOK_SUBJECT_CTES = (
    "texts AS (SELECT book_id, page, 0 AS seq, c0 AS t FROM s UNION ALL SELECT book_id, page, 1, c1 FROM s "
    "UNION ALL SELECT book_id, page, 2, c2 FROM s UNION ALL SELECT book_id, page, 3, full_text FROM s), "
    f"hits AS ({_subject_hits()}), "
    "counted AS (SELECT book_id, subject, count(*) AS n, min(page * 100 + seq * 10 + word_no) AS first_at "
    "FROM hits GROUP BY book_id, subject), "
    "subj AS (SELECT book_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY book_id "
    "ORDER BY n DESC, first_at) AS rn FROM counted) WHERE rn = 1)"
)


def segment_ctes(rows: str) -> str:
    """CTEs cutting ``rows`` (book_id, page, col, closed, k) into ``seg`` by plain windows."""
    order = "PARTITION BY book_id ORDER BY page, col"
    return (
        f"e AS (SELECT *, sum(CASE WHEN closed THEN 1 ELSE 0 END) OVER ({order} "
        f"ROWS UNBOUNDED PRECEDING) AS epoch FROM {rows}), "
        "f AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY book_id, epoch ORDER BY page, col "
        "ROWS UNBOUNDED PRECEDING) AS fk FROM e WHERE NOT closed), "
        "g AS (SELECT *, CASE WHEN lag(fk) OVER (PARTITION BY book_id, epoch ORDER BY page, col) "
        "IS DISTINCT FROM fk THEN 1 ELSE 0 END AS opens FROM f WHERE fk IS NOT NULL), "
        f"i AS (SELECT *, CAST(sum(opens) OVER ({order} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS idx FROM g), "
        "seg AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id, idx ORDER BY page, col) AS INTEGER) AS seq "
        "FROM i)"
    )


# --- profiles out of embeddings ------------------------------------------------

PROFILE_SQL = (
    "SELECT 'scan' || CAST(CAST(floor(vec_id / 12) AS BIGINT) % 5 AS STRING) AS book_id, "
    "CAST(floor(vec_id / 12) AS BIGINT) AS page, CAST(vec_id % 12 AS INTEGER) AS band, embedding FROM embeddings"
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve vectors make the twelve bands of a page."""
    vec = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vec.selectExpr(
        "'scan' || CAST(CAST(floor(vec_id / 12) AS BIGINT) % 5 AS STRING) AS book_id",
        "CAST(floor(vec_id / 12) AS BIGINT) AS page",
        "CAST(vec_id % 12 AS INTEGER) AS band",
        "64 AS w",
        "transform(embedding, v -> abs(CAST(v AS DOUBLE)) * 100) AS ink",
    )


# --- segments out of conversations ----------------------------------------------

TURNS_SQL = (
    "SELECT CAST(conv_id AS STRING) AS book_id, turn AS page, 0 AS col, role = 'system' AS closed, "
    "CASE WHEN role = 'user' THEN 'k' || CAST(length(text) % 3 AS STRING) END AS k FROM conversations"
)


def turn_subpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn opens a document, a system turn closes one."""
    conv = table(spark, sf_dir, "conversations")
    return conv.selectExpr(
        "CAST(conv_id AS STRING) AS book_id",
        "turn AS page",
        "0 AS col",
        "CASE WHEN role = 'user' THEN named_struct('school', 'S', 'branch', CAST(NULL AS STRING), 'year', '2026', "
        "'title', 'k' || CAST(length(text) % 3 AS STRING), 'volume', false) END AS key",
        "false AS is_answer",
        "role = 'system' AS is_toc",
    )


# --- run logs out of events ---------------------------------------------------------

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
LOG_LINE = (
    f"(CASE event_type WHEN 'view' THEN CASE {K} % 4 WHEN 0 THEN '== Stage 1: layout ==' "
    "WHEN 1 THEN '[layout] 1-up=2  2-up=5  3-up=1' WHEN 2 THEN '== Stage 2: OCR ==' ELSE '== Stage 3: detect exams ==' END "
    f"WHEN 'click' THEN '  ocr done ' || CAST({K} AS STRING) || '/' || CAST({K} % 100 + 100 AS STRING) "
    f"WHEN 'purchase' THEN CASE {K} % 3 WHEN 0 THEN '=== TOTAL EXAMS: ' || CAST({K} AS STRING) || ' ===' "
    "WHEN 1 THEN 'saved /w/exam_sets.json' ELSE '[ocr] strips -> /w/strips.json  (7 pages)' END "
    f"WHEN 'signup' THEN CASE {K} % 3 WHEN 0 THEN '== Stage 4: split ==' "
    f"WHEN 1 THEN '[ ' || CAST({K} % 9 + 1 AS STRING) || '/20] name.pdf  (src p1-2, 3 pages)' "
    f"ELSE 'DONE. ' || CAST({K} AS STRING) || ' exam PDFs, ' || CAST({K} * 3 AS STRING) || ' total pages -> /o' END "
    "ELSE 'progress note' END)"
)
EXIT_CODE = f"(CASE WHEN event_type = 'error' AND {K} % 7 < 2 THEN {K} % 7 END)"
LOG_COLUMNS = (
    "CAST(user_id AS STRING) AS run_id",
    "event_id AS seq",
    f"{LOG_LINE} AS line",
    f"CAST({EXIT_CODE} AS INTEGER) AS exit_code",
)
LOG_SQL = f"SELECT {', '.join(LOG_COLUMNS)} FROM events"
LOG_SOURCE = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return events.selectExpr(*LOG_COLUMNS)


BATCH_COLUMNS = (
    "'batch' || CAST(user_id % 7 AS STRING) AS batch_id",
    "CAST(user_id AS STRING) AS run_id",
)


def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs grouped into batches; every batch also lists a run nobody knows."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().selectExpr(*BATCH_COLUMNS)
    ghost = users.select("batch_id", F.lit("nobody").alias("run_id")).distinct()
    return users.unionByName(ghost)
