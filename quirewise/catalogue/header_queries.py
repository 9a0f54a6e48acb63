"""Header detection on page texts composed over the documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions.arrays import explode_once
from ..operators import dictionary as D
from ..operators import headers as H
from ..operators import subpages as S
from . import query
from . import tables as t

K = "WITH " + t.expected_columns()


def strips(spark, sf_dir):
    return t.page_strips(spark, sf_dir)


def column_texts(spark, sf_dir):
    return strips(spark, sf_dir).select(
        "book_id", "page", "full", F.posexplode("cols").alias("col", "text")
    )


# Headers by kind for all three texts of a page, whatever its layout.
def _all_columns(kinds: str, title: str, extra: str = "") -> str:
    return (
        f"WITH s AS ({t.STRIPS_SQL}), q AS ("
        + " UNION ALL ".join(
            f"SELECT book_id, page, {c} AS col, {t.part(c)} AS kind, ({t.IS_CONTENTS} AND {c} = 0) AS toc, "
            f"{t.school(c)} AS shown, {t.YEAR} AS y, {t.SUBJECT} AS subj, {t.VOLUME} AS vol, "
            f"(CASE WHEN doc_id % 4 = 0 THEN '某校' ELSE '成都某西川中学' END) AS recovered FROM s"
            for c in range(3)
        )
        + f") SELECT book_id, page, col, {title}{extra} FROM q WHERE {kinds}"
    )


_SHOWN = (
    "regexp_replace(shown, '（.*$', '') AS school, nullif(regexp_extract(shown, '（(.*)）', 1), '') AS branch"
)


@query(
    "strict_headers",
    _all_columns("kind IN (0, 1) AND NOT toc", "0 AS pos", f", {_SHOWN}, y AS year, shown || '初' || y || "
    "CASE kind WHEN 0 THEN '届新初一分班真卷' ELSE '级新初一分班（奖学金）真卷' END || subj AS title")
    + " UNION ALL SELECT book_id, page, col, n AS pos, "
    + _SHOWN
    + ", CAST(2024 + n AS STRING) AS year, shown || '初' || CAST(2024 + n AS STRING) || '届新初一分班真卷' || subj AS title "
    "FROM q CROSS JOIN (SELECT unnest(range(4)) AS n) WHERE toc",
)
def strict_headers(spark, sf_dir):
    found = explode_once(
        column_texts(spark, sf_dir), ["book_id", "page", "col"], H.strict_headers(F.col("text")), "pos", "h"
    )
    return found.select("book_id", "page", "col", "pos", "h.school", "h.branch", "h.year", "h.title")


@query(
    "first_header",
    _all_columns("kind IN (0, 1) AND NOT toc", f"{_SHOWN}")
    + f" UNION ALL SELECT book_id, page, col, {_SHOWN} FROM q WHERE toc",
)
def first_header(spark, sf_dir):
    first = F.get(H.strict_headers(F.col("text")), F.lit(0))
    rows = column_texts(spark, sf_dir).select("book_id", "page", "col", first.alias("h"))
    return rows.filter("h IS NOT NULL").select("book_id", "page", "col", "h.school", "h.branch")


@query(
    "relaxed_headers",
    _all_columns(
        "kind IN (2, 3) AND NOT toc",
        "CASE kind WHEN 2 THEN recovered ELSE regexp_replace(shown, '（.*$', '') END AS school, "
        "CASE kind WHEN 2 THEN y END AS year, "
        "CASE kind WHEN 2 THEN recovered || '初' || y || '届新初一分班真卷英语' ELSE shown || '新初一分班真卷英语' END AS title",
    ),
)
def relaxed_headers(spark, sf_dir):
    # Columns with a strict header are left out, as in the cascade.
    rows = column_texts(spark, sf_dir).filter(F.size(H.strict_headers(F.col("text"))) == 0)
    found = rows.select(
        "book_id", "page", "col", H.relaxed_header(F.col("text"), F.col("full")).alias("h")
    )
    return found.filter("h IS NOT NULL").select("book_id", "page", "col", "h.school", "h.year", "h.title")


@query(
    "volume_headers",
    _all_columns(
        "kind = 4 AND NOT toc",
        "vol AS volume, CASE vol WHEN '一' THEN 1 WHEN '二' THEN 2 WHEN '三' THEN 3 ELSE 14 END AS volume_no, "
        "'公立名校初一新生入学(分班)考试真卷精编(' || vol || ')' AS title",
    ),
)
def volume_headers(spark, sf_dir):
    found = column_texts(spark, sf_dir).select(
        "book_id", "page", "col", H.volume_header(F.array("text")).alias("h")
    )
    return found.filter("h IS NOT NULL").select(
        "book_id", "page", "col", F.col("h.year").alias("volume"),
        T.cn_number(F.col("h.year")).alias("volume_no"), "h.title",
    )


@query("book_subject", f"WITH s AS ({t.STRIPS_SQL}), {t.BOOK_SUBJECT_CTES} SELECT book_id, subject FROM subj")
def book_subject(spark, sf_dir):
    return S.book_subjects(strips(spark, sf_dir))


@query("book_subject_by_table", f"WITH s AS ({t.STRIPS_SQL}), {t.BOOK_SUBJECT_CTES} SELECT book_id, subject FROM subj")
def book_subject_by_table(spark, sf_dir):
    """The same subjects out of a table of words."""
    words = [(i, w, w) for i, w in enumerate(rules.CN_EXAM.subjects)]
    words = spark.createDataFrame(words, "word_no long, word string, subject string")
    return D.subjects_by_table(S.page_texts(strips(spark, sf_dir)), words)


@query(
    "dictionary_hits",
    "WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^0-9A-Za-z]+')) AS word FROM benchmark), "
    "d AS (SELECT doc_id, text FROM documents) "
    "SELECT d.doc_id, w.word, CAST(instr(d.text, w.word) - 1 AS BIGINT) AS at FROM d JOIN w ON w.word <> '' AND contains(d.text, w.word)",
)
def dictionary_hits(spark, sf_dir):
    """Every word of the benchmark texts in every document, with its first place."""
    words = t.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^0-9A-Za-z]+")).alias("word")).distinct()
    words = words.withColumn("word_no", F.xxhash64("word"))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = D.find_words(docs, words).select("doc_id", F.explode("found").alias("f"))
    return found.join(words, F.col("f.word_no") == F.col("word_no")).select("doc_id", "word", F.col("f.at").alias("at"))


@query("text_union", f"WITH s AS ({t.STRIPS_SQL}), {t.BOOK_SUBJECT_CTES} SELECT book_id, page, seq, length(t) AS n FROM texts")
def text_union(spark, sf_dir):
    return S.page_texts(strips(spark, sf_dir)).select(
        "book_id", "page", "seq", F.length("text").alias("n")
    )


def subpages(spark, sf_dir):
    pages = strips(spark, sf_dir)
    return S.build_subpages(pages, t.page_layouts(spark, sf_dir), None, S.book_subjects(pages))


@query(
    "header_cascade",
    K + " SELECT book_id, page, col, school, branch, year, title, volume AS is_volume, is_answer, is_toc FROM k "
    "WHERE title IS NOT NULL",
)
def header_cascade(spark, sf_dir):
    rows = subpages(spark, sf_dir).filter("key IS NOT NULL")
    return rows.select(
        "book_id", "page", "col", "key.school", "key.branch", "key.year", "key.title",
        F.col("key.volume").alias("is_volume"), "is_answer", "is_toc",
    )


_FLAGS = " SELECT DISTINCT book_id, page FROM k WHERE "


@query("toc_pages", K + _FLAGS + "is_toc")
def toc_pages(spark, sf_dir):
    return _flags(spark, sf_dir).filter("is_toc").select("book_id", "page")


@query("answer_pages", K + _FLAGS + "is_answer")
def answer_pages(spark, sf_dir):
    texts = F.slice("cols", F.lit(1), F.col("n"))
    rows = strips(spark, sf_dir).join(t.page_layouts(spark, sf_dir), ["book_id", "page"], "left")
    rows = rows.withColumn("n", F.expr("CASE layout WHEN '1-up' THEN 1 WHEN '3-up' THEN 3 ELSE 2 END"))
    marked = F.exists(texts, lambda x: T.has_answer_mark(F.concat(x, F.lit("\n"), F.col("full"))))
    return rows.filter(marked).select("book_id", "page")


def _flags(spark, sf_dir):
    pages = strips(spark, sf_dir)
    return S.page_flags(S.detect_headers(pages), t.page_layouts(spark, sf_dir), S.book_subjects(pages))


@query(
    "page_keys",
    K + " SELECT book_id, page, CASE WHEN max(CASE WHEN toc THEN 1 ELSE 0 END) = 1 THEN 4 ELSE 0 END + count(DISTINCT "
    "CASE WHEN toc THEN NULL WHEN volume THEN title ELSE school || coalesce(branch, '-') || coalesce(year, '-') || title END) "
    "AS n_keys FROM k GROUP BY book_id, page",
)
def page_keys(spark, sf_dir):
    return _flags(spark, sf_dir).select("book_id", "page", F.col("n_keys").cast("long").alias("n_keys"))


@query("answer_columns", K + " SELECT book_id, page, col, kind = 5 AS is_answer FROM k")
def answer_columns(spark, sf_dir):
    """Answers close the column they stand in, not its page."""
    by_column = replace(rules.CN_EXAM, answer_scope="column")
    rows = S.build_subpages(strips(spark, sf_dir), t.page_layouts(spark, sf_dir), rules=by_column)
    return rows.select("book_id", "page", "col", "is_answer")


# A line of a question is no name of a volume; two lines of a name belong together.
_TOP = (
    "(CASE WHEN coalesce(n_chars, 0) % 2 = 0 THEN '一、公立名校选择题' ELSE '公立名校初一新生' END "
    f"|| {t.NL} || '私立名校入学考试' || {t.NL} || coalesce(text, ''))"
)


@query(
    "volume_prefix",
    "SELECT doc_id, CASE WHEN coalesce(n_chars, 0) % 2 = 0 THEN '' ELSE '公立名校初一新生' END || '私立名校入学考试' AS prefix FROM documents",
)
def volume_prefix(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return docs.select("doc_id", H.volume_prefix(F.expr(_TOP)).alias("prefix"))


# A school's name polluted by Latin letters, digits and brackets: here the source of the document.
_HALVES = (t.pick("doc_id", ("成都某嘉祥", "自贡某蜀光", "成都某西川")), t.pick("doc_id", ("外国语学校", "中学", "中学")))


@query("noisy_school", f"SELECT doc_id, {_HALVES[0]} || {_HALVES[1]} AS school FROM documents")
def noisy_school(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    line = F.expr(f"{_HALVES[0]} || ' ' || coalesce(source, '') || ' ' || {_HALVES[1]}")
    return docs.select("doc_id", T.school_in_noisy_line(line)["school"].alias("school"))


_COPIES = 3


@query(
    "distinct_candidates",
    f"SELECT source AS book_id, doc_id AS page, 1 AS n, {t.full_header(0)} AS title FROM documents",
)
def distinct_candidates(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    text = f" || {t.NL} || '正文正文正文' || {t.NL} || ".join([t.full_header(0)] * _COPIES)
    rows = docs.selectExpr("source AS book_id", "doc_id AS page", f"{text} AS text")
    found = rows.select("book_id", "page", H.strict_headers(F.col("text")).alias("hs"))
    return found.select(
        "book_id", "page", F.size("hs").alias("n"), F.get("hs", F.lit(0))["title"].alias("title")
    )


OVERRIDE_COLUMNS = (
    "source AS book_id",
    "doc_id AS page",
    "'自贡某蜀光中学' AS school",
    "CASE WHEN doc_id % 2 = 0 THEN '南校' END AS branch",
    "'2027' AS year",
    "CASE WHEN doc_id % 3 = 0 THEN 'T' || CAST(doc_id AS STRING) END AS title",
)


def title_overrides(spark, sf_dir):
    """Every page whose document is labelled toxic gets a title by hand."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = t.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return docs.join(toxic, "doc_id", "left_semi").selectExpr(*OVERRIDE_COLUMNS)


OVERRIDES_SQL = (
    f"ov AS (SELECT {', '.join(OVERRIDE_COLUMNS)} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), "
    "ovt AS (SELECT book_id, page, school, branch, year, coalesce(title, school || coalesce('(' || branch || ')', '') || "
    "'初' || year || '级新初一分班真卷数学') AS title FROM ov)"
)


@query(
    "title_override",
    K + f", {OVERRIDES_SQL} SELECT k.book_id, k.page, k.col, coalesce(ovt.title, k.title) AS title, "
    "CASE WHEN ovt.page IS NULL THEN k.branch ELSE ovt.branch END AS branch, "
    "k.is_answer AND ovt.page IS NULL AS is_answer, k.is_toc AND ovt.page IS NULL AS is_toc "
    "FROM k LEFT JOIN ovt ON ovt.book_id = k.book_id AND ovt.page = k.page",
)
def title_override(spark, sf_dir):
    rows = S.apply_title_overrides(subpages(spark, sf_dir), title_overrides(spark, sf_dir))
    return rows.select("book_id", "page", "col", "key.title", "key.branch", "is_answer", "is_toc")
