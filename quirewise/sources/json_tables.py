"""The JSON shapes at the edges: readers, writers, replacement by book.

Readers take a frame (book_id, json), one document per row; ``read_json_texts``
makes one from files.  ``json_ranges.elements`` makes one with an element of a
document per row and its place as ``seq``, for documents too large for a row.
Between operators the tables stay in Parquet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import explode_map_once, explode_once
from ..functions.text import nonempty
from ..operators.layout import CUTS_TYPE, default_cuts
from ..operators.ordered import block_of
from ..operators.subpages import override_title
from ..plans.storage import materialize
from ..rules import CN_EXAM, RuleProfile

LAYOUT_ROWS = (
    "array<struct<page:int,layout:string,cuts:array<array<double>>,"
    "score_c:double,score_13:double,score_23:double,corrected:boolean>>"
)
STRIP_VALUE = "struct<col:array<string>,full:string>"
EXAM_ROWS = (
    "array<struct<start:int,end:int,school:string,branch:string,year:string,title:string,"
    "segments:array<array<int>>>>"
)
MANIFEST_ROWS = (
    "array<struct<index:int,name:string,file:string,src_start:int,src_end:int,"
    "pdf_pages:int,school:string,branch:string,year:string>>"
)


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (book_id, json); the book is the file's folder."""
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("book_id", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
        .select("book_id", F.col("value").alias("json"))
    )


def _listed(docs: DataFrame, rows: Column, value: str = "r") -> DataFrame:
    """book_id, pos, ``value``: the entries of the documents; ``seq`` places a document of one entry in its book."""
    if "seq" not in docs.columns:
        return explode_once(docs, ["book_id"], rows, "pos", value)
    placed = explode_once(docs, ["book_id", "seq"], rows, "pos", value)
    return placed.select("book_id", (F.col("seq") + F.col("pos")).cast("int").alias("pos"), value)


def _is_list(c: Column) -> Column:
    return F.ltrim(c).startswith("[")


def _pairs(cuts: Column) -> Column:
    """[[x0, x1], …] to windows; null when empty."""
    w = F.transform(
        cuts, lambda c: F.struct(F.get(c, F.lit(0)).alias("x0"), F.get(c, F.lit(1)).alias("x1"))
    ).cast(CUTS_TYPE)
    return F.when(F.size(cuts) > 0, w)


def read_layout(docs: DataFrame) -> DataFrame:
    """S4 + S5: both layout shapes; rows without cuts get the plain windows.

    The last entry of a page that is listed twice counts.
    """
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    bare = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].try_cast("int").alias("page"),
            e["value"].alias("layout"),
            F.lit(None).cast("array<array<double>>").alias("cuts"),
            F.lit(None).cast("double").alias("score_c"),
            F.lit(None).cast("double").alias("score_13"),
            F.lit(None).cast("double").alias("score_23"),
            F.lit(None).cast("boolean").alias("corrected"),
        ),
    ).cast(LAYOUT_ROWS)
    rows = F.when(_is_list(F.col("json")), F.from_json("json", LAYOUT_ROWS)).otherwise(bare)
    listed = _listed(docs, rows)
    return listed.groupBy("book_id", "r.page").agg(F.max_by("r", "pos").alias("r")).select(
        "book_id",
        "r.page",
        "r.layout",
        F.coalesce(_pairs(F.col("r.cuts")), default_cuts(F.col("r.layout"))).alias("cuts"),
        "r.score_c",
        "r.score_13",
        "r.score_23",
        F.coalesce("r.corrected", F.lit(False)).alias("corrected"),
    )


def read_strips(docs: DataFrame) -> DataFrame:
    """S6 + K1: page rows (book_id, page, cols, full); a bare string is one column."""
    by_page = F.from_json("json", "map<string,string>")
    pages = explode_map_once(docs, ["book_id"], by_page, "key", "value")
    rec = F.when(F.ltrim("value").startswith("{"), F.from_json("value", STRIP_VALUE))
    return pages.select("book_id", F.col("key").try_cast("int").alias("page"), "value", rec.alias("rec")).select(
        "book_id",
        "page",
        F.when(F.col("rec").isNull(), F.array("value"))
        .otherwise(F.coalesce("rec.col", F.array().cast("array<string>")))
        .alias("cols"),
        F.coalesce("rec.full", F.lit("")).alias("full"),
    )


def strip_rows(page_strip: DataFrame) -> DataFrame:
    """Page rows to column rows."""
    return page_strip.select("book_id", "page", F.posexplode("cols").alias("col", "text"))


def read_title_overrides(docs: DataFrame, rules: RuleProfile = CN_EXAM) -> DataFrame:
    """{page: [school, branch, year, title?]} with the title filled in."""
    part = lambda i: F.get("v", F.lit(i))
    by_page = F.from_json("json", "map<string,array<string>>")
    return (
        explode_map_once(docs, ["book_id"], by_page, "k", "v")
        .select(
            "book_id",
            F.col("k").try_cast("int").alias("page"),
            *[part(i).alias(n) for i, n in enumerate(("school", "branch", "year", "title"))],
        )
        .withColumn(
            "title",
            F.coalesce(
                "title", override_title(F.col("school"), F.col("branch"), F.col("year"), rules)
            ),
        )
    )


def read_layout_overrides(docs: DataFrame) -> DataFrame:
    """{page: layout} or [{page, layout}], as (book_id, page, layout, seq)."""
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    bare = F.transform(
        entries, lambda e: F.struct(e["key"].alias("page"), e["value"].alias("layout"))
    ).cast("array<struct<page:string,layout:string>>")
    listed = F.from_json("json", "array<struct<page:string,layout:string>>")
    rows = F.when(_is_list(F.col("json")), listed).otherwise(bare)
    return _listed(docs, rows).select(
        "book_id", F.col("r.page").try_cast("int").alias("page"), "r.layout", F.col("pos").alias("seq")
    )


def read_exam_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exam, exam_segment) from list documents."""
    rows = _listed(docs, F.from_json("json", EXAM_ROWS)).withColumn("idx", F.col("pos") + 1)
    exam = rows.select(
        "book_id", "idx", "r.start", "r.end", "r.school", "r.branch", "r.year", "r.title",
        F.coalesce(F.size("r.segments"), F.lit(0)).alias("n_columns"),
    )
    segs = rows.select("book_id", "idx", F.posexplode("r.segments").alias("p", "s")).select(
        "book_id",
        "idx",
        (F.col("p") + 1).alias("seq"),
        F.get("s", F.lit(0)).alias("page"),
        F.get("s", F.lit(1)).alias("col"),
    )
    return exam, segs


def read_manifest(docs: DataFrame) -> DataFrame:
    """A missing name falls back to the file and the other way round."""
    return _listed(docs, F.from_json("json", MANIFEST_ROWS)).select(
        "book_id",
        "r.index",
        F.coalesce(nonempty(F.col("r.name")), F.col("r.file"), F.lit("")).alias("name"),
        F.coalesce(nonempty(F.col("r.file")), F.col("r.name"), F.lit("")).alias("file"),
        "r.src_start",
        "r.src_end",
        "r.pdf_pages",
        "r.school",
        "r.branch",
        "r.year",
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")


def replace_books(
    df: DataFrame,
    path: str,
    order: str = "page",
    fmt: str = "parquet",
    books: DataFrame | None = None,
    buckets: int = 256,
) -> None:
    """Write a table by book; the named books are replaced whole.

    ``books`` (book_id) names the books that ``df`` is the new state of; one of
    them without rows in ``df`` is cleared.  Without it the books of ``df`` are
    meant.  The table is partitioned by a hash of the book, in ``buckets`` folders
    (the same number in every call on a path), whatever the number of books.
    Touched buckets are written anew: the rows of their other books are carried
    over, and a marker row keeps a bucket that ends empty replaceable.  Rows go to
    a file per (bucket, block of the order column), so a huge book is written by
    many tasks.  Re-running leaves the same table; one writer at a time.
    """
    spark = df.sparkSession
    named = (df if books is None else books).select("book_id").distinct().withColumn("__bucket", _bucket(buckets))
    named = materialize(named, "named-books")
    # At most ``buckets`` numbers.
    touched = [r[0] for r in named.select("__bucket").distinct().collect()]
    if not touched:
        return
    rows = df.withColumns({"__live": F.lit(True), "__bucket": _bucket(buckets)})
    try:
        old = spark.read.format(fmt).schema(rows.schema).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        old = old.filter(F.col("__bucket").isin(touched) & F.col("__live")).alias("o")
        others = old.join(named.alias("n"), F.col("o.book_id").eqNullSafe(F.col("n.book_id")), "left_anti")
        rows = rows.unionByName(materialize(others, "other-books"))
    marks = spark.createDataFrame([(b, False) for b in touched], "__bucket int, __live boolean")
    (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn("__block", block_of(order))
        .repartition("__bucket", "__block")
        .drop("__block")
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("__bucket")
        .save(path)
    )


def read_books(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table written by ``replace_books``, with its schema given."""
    rows = spark.read.format(fmt).schema(f"{schema}, __live boolean, __bucket int").load(path)
    return rows.filter("__live").drop("__live", "__bucket")
