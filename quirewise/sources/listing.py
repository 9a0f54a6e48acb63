"""Submitted files: listing, duplicates, parameters, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SKIP = 2


def list_collections(spark: SparkSession, path: str) -> DataFrame:
    """Documents below ``path``; only file metadata is read, not the bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            "path",
            F.regexp_extract("path", "([^/]+)$", 1).alias("name"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"),
        )
    )


def accept(files: DataFrame) -> DataFrame:
    """S1 on an existing listing."""
    return files.filter(F.lower("name").endswith(".pdf"))


def first_of_each(files: DataFrame, by: str = "content") -> DataFrame:
    """One row per file, the first submitted.

    ``content`` compares (name, size, mtime), ``path`` the lower-cased path.
    An aggregate rather than a window: copies of one file combine before the
    shuffle however many there are.
    """
    if by == "content":
        keys = [F.col("name"), F.col("size"), F.col("mtime")]
    elif by == "path":
        keys = [F.lower("path").alias("__path")]
    else:
        raise ValueError(f"unknown identity {by!r}")
    first = files.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in files.columns]), "seq").alias("f")
    )
    return first.select("f.*")


def bind_skip(files: DataFrame, skips: DataFrame, default: int = DEFAULT_SKIP) -> DataFrame:
    """S3: the i-th skip value belongs to the i-th file."""
    return files.join(skips.select("seq", "skip"), "seq", "left").withColumn(
        "skip", F.coalesce("skip", F.lit(default))
    )


def submission_summary(files: DataFrame) -> DataFrame:
    """A14"""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )


def skip_pages(pages: DataFrame, books: DataFrame | None = None, skip: int = DEFAULT_SKIP) -> DataFrame:
    """Content pages only, with one skip for all or one per book.

    The literal form reaches the file scan as a pushed filter.
    """
    if books is None:
        return pages.filter(F.col("page") > skip)
    from ..operators.ordered import salted_lookup

    per_book = books.select("book_id", "skip")
    return (
        salted_lookup(pages, per_book, "book_id", F.col("page"))
        .filter(F.col("page") > F.coalesce("skip", F.lit(skip)))
        .drop("skip")
    )


def first_pages(pages: DataFrame, n: int = 8) -> DataFrame:
    """K4: the first pages of every book (pages count from 1)."""
    return pages.filter(F.col("page") <= n)
