"""Listings, parameters and the JSON shapes, over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..plans import collection
from ..plans.storage import fresh_path, materialize
from ..sources import json_ranges as R
from ..sources import json_tables as J
from ..sources import listing as S
from ..streaming.arrivals import stream_books
from . import query
from . import tables as t

# Pages as submitted files: ten names, a few sizes, so copies abound.
FILE_COLUMNS = (
    "page_id AS seq",
    "'Book' || CAST(page_id % 10 AS STRING) || CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS name",
    "page_id % 6 AS size",
    "page_id % 2 AS mtime",
    "'/In/' || CASE WHEN page_id % 3 = 0 THEN 'BOOK' ELSE 'book' END || CAST(page_id % 20 AS STRING) AS path",
)
FILES = f"f AS (SELECT {', '.join(FILE_COLUMNS)} FROM pages)"


def files(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").selectExpr(*FILE_COLUMNS)


@query("accepted_files", f"WITH {FILES} SELECT seq, name FROM f WHERE lower(name) LIKE '%.pdf'")
def accepted_files(spark, sf_dir):
    return S.accept(files(spark, sf_dir)).select("seq", "name")


@query("file_dedupe", f"WITH {FILES} SELECT min(seq) AS seq, name, size, mtime FROM f GROUP BY name, size, mtime")
def file_dedupe(spark, sf_dir):
    return S.first_of_each(files(spark, sf_dir)).drop("path")


@query(
    "file_dedupe_by_path",
    f"WITH {FILES} SELECT seq, path FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY seq) AS rn FROM f) WHERE rn = 1",
)
def file_dedupe_by_path(spark, sf_dir):
    return S.first_of_each(files(spark, sf_dir), by="path").select("seq", "path")


@query(
    "param_binding",
    "SELECT page_id AS seq, CASE WHEN l.doc_id IS NULL THEN 2 ELSE l.quality END AS skip FROM pages LEFT JOIN labels l ON l.doc_id = page_id",
)
def param_binding(spark, sf_dir):
    skips = t.table(spark, sf_dir, "labels").selectExpr("doc_id AS seq", "quality AS skip")
    return S.bind_skip(files(spark, sf_dir).select("seq"), skips)


@query("file_summary", f"WITH {FILES} SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM f")
def file_summary(spark, sf_dir):
    return S.submission_summary(files(spark, sf_dir))


def pages_of(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id", "doc_id AS page", "length(text) AS n"
    )


@query("skip_pages", "SELECT source AS book_id, doc_id AS page, length(text) AS n FROM documents WHERE doc_id > 2")
def skip_pages(spark, sf_dir):
    return S.skip_pages(pages_of(spark, sf_dir))


@query(
    "skip_pages_by_book",
    "SELECT source AS book_id, doc_id AS page, length(text) AS n FROM documents WHERE doc_id > "
    "CASE WHEN source LIKE '%1' THEN 2 ELSE length(source) * 20 END",
)
def skip_pages_by_book(spark, sf_dir):
    rows = pages_of(spark, sf_dir)
    books = rows.select("book_id").distinct().filter("NOT book_id LIKE '%1'")
    return S.skip_pages(rows, books.selectExpr("book_id", "length(book_id) * 20 AS skip"))


@query("first_pages", "SELECT CAST(conv_id AS STRING) AS book_id, turn + 1 AS page FROM conversations WHERE turn + 1 <= 8")
def first_pages(spark, sf_dir):
    conv = t.table(spark, sf_dir, "conversations")
    return S.first_pages(conv.selectExpr("CAST(conv_id AS STRING) AS book_id", "turn + 1 AS page"))


# --- JSON shapes -------------------------------------------------------------------------

_BOOK = "'d' || CAST(doc_id AS STRING) AS book_id"
_P = "CAST(doc_id % 97 + 3 AS STRING)"


def _json(spark, sf_dir, text: str):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.selectExpr(_BOOK, f"{text} AS json")


@query(
    "read_layout",
    f"SELECT {_BOOK}, CAST(doc_id % 97 + 3 AS INTEGER) AS page, CASE WHEN doc_id % 2 = 0 THEN '3-up' ELSE '2-up' END AS layout, "
    "0 AS col, CASE WHEN doc_id % 2 = 0 THEN 1.0 / 3 WHEN doc_id % 3 = 0 THEN 0.512 ELSE 0.5 END AS x1 FROM documents",
)
def read_layout(spark, sf_dir):
    bare = f"'{{\"' || {_P} || '\": \"3-up\"}}'"
    cut = f"'[{{\"page\": ' || {_P} || ', \"layout\": \"2-up\", \"cuts\": [[0.0, 0.512], [0.488, 1.0]], \"score_c\": 0.5}}]'"
    plain = f"'[{{\"page\": ' || {_P} || ', \"layout\": \"2-up\"}}]'"
    docs = _json(spark, sf_dir, f"CASE WHEN doc_id % 2 = 0 THEN {bare} WHEN doc_id % 3 = 0 THEN {cut} ELSE {plain} END")
    rows = J.read_layout(docs).select("book_id", "page", "layout", F.posexplode("cuts").alias("col", "w"))
    return rows.filter("col = 0").select("book_id", "page", "layout", "col", "w.x1")


@query(
    "read_strips",
    f"SELECT {_BOOK}, CAST(doc_id % 97 + 3 AS INTEGER) AS page, 0 AS col, text, "
    "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS full FROM documents "
    f"UNION ALL SELECT {_BOOK}, CAST(doc_id % 97 + 3 AS INTEGER), 1, lang, source FROM documents WHERE doc_id % 2 = 0",
)
def read_strips(spark, sf_dir):
    page = "CAST(doc_id % 97 + 3 AS STRING)"
    nested = f"to_json(map({page}, named_struct('col', array(text, lang), 'full', source)))"
    bare = f"to_json(map({page}, text))"
    docs = _json(spark, sf_dir, f"CASE WHEN doc_id % 2 = 0 THEN {nested} ELSE {bare} END")
    return J.read_strips(docs).select("book_id", "page", F.posexplode("cols").alias("col", "text"), "full")


@query(
    "page_key_sort",
    "SELECT CAST(doc_id AS INTEGER) AS page, source FROM documents",
)
def page_key_sort(spark, sf_dir):
    keys = t.table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS key", "source")
    return keys.select(F.col("key").try_cast("int").alias("page"), "source").orderBy("page")


@query(
    "read_title_overrides",
    f"SELECT {_BOOK}, CAST(doc_id % 97 + 3 AS INTEGER) AS page, lang AS school, CASE WHEN doc_id % 2 = 0 THEN source END AS branch, "
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2027' END AS year, CASE WHEN doc_id % 6 = 5 THEN 'whole' ELSE lang || "
    "CASE WHEN doc_id % 2 = 0 THEN '(' || source || ')' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE "
    "'初2027级新初一分班真卷数学' END END AS title FROM documents",
)
def read_title_overrides(spark, sf_dir):
    branch = "CASE WHEN doc_id % 2 = 0 THEN '\"' || source || '\"' ELSE 'null' END"
    rest = "CASE WHEN doc_id % 6 = 5 THEN ', \"2027\", \"whole\"' WHEN doc_id % 3 = 0 THEN '' ELSE ', \"2027\"' END"
    text = f"'{{\"' || {_P} || '\": [\"' || lang || '\", ' || {branch} || {rest} || ']}}'"
    return J.read_title_overrides(_json(spark, sf_dir, text))


@query(
    "read_layout_overrides",
    f"SELECT {_BOOK}, CAST(doc_id % 97 + 3 AS INTEGER) AS page, '3-up' AS layout, 0 AS seq FROM documents",
)
def read_layout_overrides(spark, sf_dir):
    bare = f"'{{\"' || {_P} || '\": \"3-up\"}}'"
    listed = f"'[{{\"page\": ' || {_P} || ', \"layout\": \"3-up\"}}]'"
    return J.read_layout_overrides(_json(spark, sf_dir, f"CASE WHEN doc_id % 2 = 0 THEN {bare} ELSE {listed} END"))


@query(
    "read_exam_sets",
    f"SELECT {_BOOK}, 1 AS idx, 'T' || lang AS title, 1 AS seq, CAST(doc_id % 97 + 3 AS INTEGER) AS page, 1 AS col FROM documents "
    f"UNION ALL SELECT {_BOOK}, 2, source, 1, 8, 0 FROM documents UNION ALL SELECT {_BOOK}, 2, source, 2, 9, 2 FROM documents",
)
def read_exam_sets(spark, sf_dir):
    one = f"'{{\"start\": 3, \"end\": 4, \"school\": \"s\", \"branch\": null, \"year\": \"2026\", \"title\": \"T' || lang || '\", \"segments\": [[' || {_P} || ', 1]]}}'"
    two = "'{\"start\": 8, \"end\": 9, \"title\": \"' || source || '\", \"segments\": [[8, 0], [9, 2]]}'"
    exam, segs = J.read_exam_sets(_json(spark, sf_dir, f"'[' || {one} || ', ' || {two} || ']'"))
    return exam.select("book_id", "idx", "title").join(segs, ["book_id", "idx"])


@query(
    "read_manifest",
    f"SELECT {_BOOK}, 1 AS index, CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '.pdf' END AS name, "
    "lang || '.pdf' AS file, CAST(doc_id % 97 + 3 AS INTEGER) AS src_start FROM documents",
)
def read_manifest(spark, sf_dir):
    name = "CASE WHEN doc_id % 2 = 0 THEN '\"name\": \"' || lang || '\", ' ELSE '' END"
    text = f"'[{{' || {name} || '\"index\": 1, \"file\": \"' || lang || '.pdf\", \"src_start\": ' || {_P} || '}}]'"
    return J.read_manifest(_json(spark, sf_dir, text)).select("book_id", "index", "name", "file", "src_start")


# --- documents of any size, written and read by many tasks ------------------------------------


@query(
    "strip_ranges",
    "SELECT source AS book_id, CAST(doc_id AS INTEGER) AS page, 0 AS col, text, lang AS full FROM documents "
    "UNION ALL SELECT source, CAST(doc_id AS INTEGER), 1, source, lang FROM documents",
)
def strip_ranges(spark, sf_dir):
    """All texts as one JSON object a book, read back by byte ranges."""
    pages = t.table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id", "CAST(doc_id AS INT) AS page", "array(text, source) AS cols", "lang AS full"
    )
    path = fresh_path(spark, "strips-json")
    R.write_strips(pages, path)
    return J.read_strips(R.elements(spark, path)).select("book_id", "page", F.posexplode("cols").alias("col", "text"), "full")


_PLACE = "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER)"


@query(
    "exam_set_round_trip",
    f"WITH e AS (SELECT source AS book_id, {_PLACE} AS idx, CAST(doc_id AS INTEGER) AS doc_id, lang, text FROM documents) "
    "SELECT book_id, idx, doc_id AS start, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS school, text AS title, s AS seq, "
    "doc_id + s AS page, s % 3 AS col FROM e, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS s) WHERE s <= 1 + doc_id % 3",
)
def exam_set_round_trip(spark, sf_dir):
    """Documents as exams with one to three columns, written as nested JSON and read back."""
    docs = t.table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id", "CAST(doc_id AS INT) AS idx", "CASE WHEN lang = 'en' THEN NULL ELSE lang END AS school", "text AS title"
    )
    exam = docs.selectExpr("book_id", "idx", "idx AS start", "idx + 1 AS end", "school", "CAST(NULL AS STRING) AS branch", "'2026' AS year", "title")
    segments = docs.selectExpr("book_id", "idx", "explode(sequence(1, 1 + idx % 3)) AS seq").selectExpr("*", "idx + seq AS page", "seq % 3 AS col")
    path = fresh_path(spark, "exams-json")
    R.write_exam_sets(exam, segments, path)
    exam, segments = J.read_exam_sets(R.elements(spark, path))
    return exam.select("book_id", "idx", "start", "school", "title").join(segments, ["book_id", "idx"])


@query(
    "manifest_round_trip",
    f"SELECT source AS book_id, {_PLACE} AS index, text AS name, lang || '.pdf' AS file, CAST(doc_id AS INTEGER) AS src_start, "
    "CASE WHEN doc_id % 2 = 0 THEN source END AS branch FROM documents WHERE text <> ''",
)
def manifest_round_trip(spark, sf_dir):
    """Texts as names of a manifest, written as JSON and read back."""
    docs = t.table(spark, sf_dir, "documents").filter("text <> ''")
    ranked = O.rank_in_group(docs.selectExpr("source AS book_id", "CAST(doc_id AS INT) AS doc_id", "lang", "text"), ["book_id"], "doc_id", "index")
    man = ranked.selectExpr(
        "book_id", "index", "text AS name", "lang || '.pdf' AS file", "doc_id AS src_start", "doc_id AS src_end", "1 AS pdf_pages",
        "lang AS school", "CASE WHEN doc_id % 2 = 0 THEN book_id END AS branch", "'2026' AS year",
    )
    path = fresh_path(spark, "manifest-json")
    R.write_manifest(man, path)
    return J.read_manifest(R.elements(spark, path)).select("book_id", "index", "name", "file", "src_start", "branch")


@query(
    "replace_books",
    "SELECT source AS book_id, doc_id AS page, CASE WHEN source = 'src1' THEN 'new' ELSE lang END AS lang FROM documents "
    "WHERE source <> 'src2' AND (source <> 'src1' OR doc_id % 2 = 1)",
)
def replace_books(spark, sf_dir):
    """Write all books, then replace one of them and empty another, then read the table back."""
    path = fresh_path(spark, "books")
    docs = t.table(spark, sf_dir, "documents").selectExpr("source AS book_id", "doc_id AS page", "lang")
    J.replace_books(docs, path)
    again = docs.filter("book_id = 'src1' AND page % 2 = 1").withColumn("lang", F.lit("new"))
    J.replace_books(again, path, books=docs.filter("book_id IN ('src1', 'src2')"))
    return J.read_books(spark, path, "page bigint, lang string, book_id string")


@query(
    "stream_books",
    "SELECT source AS book_id, CAST(1 AS INTEGER) AS index, '未名' AS name, count(*) AS n FROM documents GROUP BY source",
)
def stream_books_query(spark, sf_dir):
    """Documents arriving as a file stream, one override making a book one document."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = t.arriving(spark, sf_dir, "documents", schema).selectExpr("source AS book_id", "doc_id AS page", "array(text) AS cols", "'' AS full")

    def split(batch):
        pages = batch.selectExpr("book_id", "page", "CAST(600 AS DOUBLE) AS width", "CAST(800 AS DOUBLE) AS height")
        lay = batch.selectExpr(
            "book_id", "page", "'1-up' AS layout", "CAST(NULL AS array<struct<x0:double,x1:double>>) AS cuts"
        )
        first = batch.groupBy("book_id").agg(F.min("page").alias("page"))
        titles = first.selectExpr(
            "book_id", "page", "'未名' AS school", "CAST(NULL AS STRING) AS branch", "CAST(NULL AS STRING) AS year", "'未名' AS title"
        )
        result = collection.split_collections(
            collection.Inputs(batch, pages, layout=lay, title_overrides=titles),
            infer_subject=False,
            keep=materialize,
        )
        return result.manifest

    path = fresh_path(spark, "manifests")
    stream_books(texts, split, path, fresh_path(spark, "offsets")).awaitTermination()
    found = J.read_books(spark, path, "index int, name string, pdf_pages int, book_id string")
    return found.select("book_id", "index", "name", F.col("pdf_pages").cast("long").alias("n"))
