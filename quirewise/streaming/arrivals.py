"""Books arriving as files, each micro-batch split as it comes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from ..operators.ordered import block_of
from ..sources.json_tables import replace_books

BUCKETS = 1024


def bucket_of(book: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(buckets)).cast("int")


def store_arrival(batch: DataFrame, store: str, arrival: int, buckets: int = BUCKETS) -> list[int]:
    """Write a batch of page texts as one arrival; the buckets of books it went to.

    A folder per (bucket, arrival): storing an arrival again replaces what an
    earlier try left.  The row is one value, so its names meet none of ours.
    """
    rows = batch.select(F.struct("*").alias("strip"), bucket_of("book_id", buckets).alias("bucket"))
    # At most ``buckets`` numbers.
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
    (
        rows.withColumn("arrival", F.lit(arrival).cast("long"))
        .repartition("bucket", block_of("strip.page"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "arrival")
        .parquet(store)
    )
    return touched


def arrived_rows(spark: SparkSession, store: str, strip: StructType, touched: Iterable[int], arrival: int) -> DataFrame:
    """(strip, bucket, arrival) of some buckets up to an arrival; other buckets are neither listed nor read."""
    schema = StructType().add("strip", strip).add("bucket", IntegerType()).add("arrival", LongType())
    folders = [f"{store}/bucket={b}" for b in touched]
    return spark.read.schema(schema).option("basePath", store).parquet(*folders).filter(F.col("arrival") <= arrival)


def arrived_books(rows: DataFrame, arrival: int) -> tuple[DataFrame, DataFrame]:
    """(all pages of the books that an arrival names, these books); of a page that came twice the last arrival counts."""
    page = rows.select(F.col("strip.book_id").alias("book"), F.col("strip.page").alias("at"), F.col("arrival").alias("came"))
    named = page.filter(F.col("came") == arrival).select(F.col("book").alias("book_id")).distinct()
    ours = page.join(named, F.col("book").eqNullSafe(F.col("book_id")), "left_semi")
    last = ours.groupBy("book", "at").agg(F.max("came").alias("last"))
    same = F.col("strip.book_id").eqNullSafe(F.col("book")) & F.col("strip.page").eqNullSafe(F.col("at"))
    return rows.join(last, same & (F.col("arrival") == F.col("last")), "left_semi").select("strip.*"), named


def stream_books(
    page_strips: DataFrame,
    split: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    order: str = "index",
    pages: str | None = None,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Run ``split`` (page texts of books -> manifest) on the books of every micro-batch.

    A book may arrive in any number of files.  Every batch is stored under
    ``pages`` (``path`` with "_pages" where not given) by bucket of books, and the
    books it names are split anew from all their pages so far; of a page that
    arrives again the last arrival counts.  A batch lists and reads the buckets
    of its own books only, so its cost does not grow with what other books sent
    before.  ``buckets`` has to stay the same on a path.  Both sinks replace what
    an earlier try wrote, so running a batch twice leaves the same tables.
    """
    store = pages or f"{path.rstrip('/')}_pages"
    strip = page_strips.schema

    def put(batch: DataFrame, batch_id: int) -> None:
        touched = store_arrival(batch, store, batch_id, buckets)
        if not touched:
            return
        whole, named = arrived_books(arrived_rows(batch.sparkSession, store, strip, touched, batch_id), batch_id)
        replace_books(split(whole), path, order=order, books=named)

    return (
        page_strips.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
