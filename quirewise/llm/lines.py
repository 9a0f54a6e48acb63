"""Line dedup: hashes range-partitioned, sorted by document and position, streamed.

Only hashes and positions are shuffled and sorted.  The range covers (hash,
document, position), so a line that fills a third of the corpus spreads over
many partitions; what such a run holds in all is settled afterwards from two
rows per partition.  The result is a compressed keep bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.common import NULL_ID, SPACES, ascii_lower, doc_rows, freed, partitions, stage_table, text_key

RUNS = "part int, edge boolean, h1 long, h2 long, doc_id long, tkey long, pos int, n_lines int, first boolean, run_docs long, first_doc long, last_doc long"


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2 (128 bits of the key), doc_id, tkey, pos, n_lines; keys under ``min_chars`` code points stay out."""
    rows = doc_rows(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.split("text", "\n").alias("_lines"))
    rows = rows.select("doc_id", "tkey", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "tkey", "pos", "n_lines")


def _stream(min_docs: int):
    """Runs of one key in a sorted partition.

    Runs inside the partition are decided here; only lines of keys that reach
    ``min_docs`` leave it, and the rows of the first and last run, which may
    go on next door (``edge``).
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ("h1", "h2", "doc_id", "tkey", "pos", "n_lines")
        held: list[pd.DataFrame] = []
        opened = False

        def out(rows: pd.DataFrame, last: bool) -> Iterator[pa.RecordBatch]:
            """All runs of ``rows`` are whole, as far as this partition goes."""
            nonlocal opened
            if rows.empty:
                return
            new = np.ones(len(rows), bool)
            new[1:] = (rows.h1.values[1:] != rows.h1.values[:-1]) | (rows.h2.values[1:] != rows.h2.values[:-1])
            run = np.cumsum(new) - 1
            docs = rows.doc_id.values
            fresh = new.copy()
            fresh[1:] |= docs[1:] != docs[:-1]
            n = np.bincount(run, weights=fresh).astype("int64")
            start, size = np.flatnonzero(new), np.bincount(run)
            edge = np.zeros(len(n), bool)
            edge[0] = not opened
            edge[-1] |= last
            opened = True
            keep = (n >= min_docs)[run] | edge[run]
            full = pd.DataFrame({"part": np.int32(part), "edge": edge[run], **{c: rows[c].values for c in names}, "first": new, "run_docs": n[run], "first_doc": docs[start][run], "last_doc": docs[start + size - 1][run]})
            full = full[keep]
            for at in range(0, len(full), 100_000):
                yield pa.RecordBatch.from_pandas(full.iloc[at : at + 100_000], preserve_index=False)

        for batch in batches:
            rows = batch.to_pandas()
            if rows.empty:
                continue
            same = (rows.h1.values == rows.h1.values[-1]) & (rows.h2.values == rows.h2.values[-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or (held and (held[-1].h1.iloc[-1] != rows.h1.iloc[0] or held[-1].h2.iloc[-1] != rows.h2.iloc[0])):
                whole = pd.concat([*held, rows.iloc[:cut]]) if held else rows.iloc[:cut]
                yield from out(whole, False)
                held = []
            held.append(rows.iloc[cut:])
        if held:
            yield from out(pd.concat(held), True)

    return of


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, tkey, pos, n_lines of every line to drop; a null id shows as ``NULL_ID``.

    A line goes if its key is in at least ``min_docs`` documents; with
    ``keep_first`` its first occurrence in order of document and position stays.
    Rows with equal ids count as one document; a null id is a document too,
    ahead of all others.
    """
    spark = docs.sparkSession
    order = ["h1", "h2", "doc_id", "tkey", "pos"]
    hashes = line_hashes(docs, min_chars).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    runs = stage_table(hashes.mapInArrow(freed(_stream(min_docs)), RUNS), "line-runs")
    inside = runs.filter("not edge").select("doc_id", "tkey", "pos", "n_lines", "first")
    # One row per partition and edge run: at most two per partition.
    ends = runs.filter("edge").groupBy("h1", "h2", "part").agg(
        F.max("run_docs").alias("run_docs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")
    )
    by_part = Window.partitionBy("h1", "h2").orderBy("part")
    ends = ends.withColumn("again", (F.lag("last_doc").over(by_part) == F.col("first_doc")).cast("int"))
    totals = ends.groupBy("h1", "h2").agg(
        (F.sum("run_docs") - F.coalesce(F.sum("again"), F.lit(0))).alias("docs"), F.min("part").alias("first_part")
    )
    spanning = (
        runs.filter("edge")
        .join(totals.filter(F.col("docs") >= min_docs), ["h1", "h2"])
        .select("doc_id", "tkey", "pos", "n_lines", (F.col("first") & (F.col("part") == F.col("first_part"))).alias("first"))
    )
    drop = inside.union(spanning)
    return (drop.filter("not first") if keep_first else drop).drop("first")


def _bitmap(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(at, n):
        keep = np.ones(n, bool)
        keep[np.asarray(at)] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)

    return pd.Series([one(a, n) for a, n in zip(positions, n_lines)])


def keep_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """doc_id, tkey, n_lines, n_dropped, keep: zlib over little-endian bits, 1 for a line that stays.

    Documents that keep every line have no row.  ``how`` as in :func:`repeated_lines`.
    """
    drop = repeated_lines(docs, **how).groupBy("doc_id", "tkey").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("_at"))
    return drop.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "tkey", "n_lines", F.size("_at").alias("n_dropped"), F.pandas_udf(_bitmap, "binary")("_at", "n_lines").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay as text, and n_lines, n_dropped (long).

    Every row of ``docs`` comes back with all its columns, whatever their names and
    types; columns n_lines and n_dropped of its own are replaced.  A null or empty
    text is one empty line, and comes back empty.
    """
    marks = bitmaps.select(*(F.col(c).alias(f"mark_{c}") for c in ("doc_id", "tkey", "n_dropped", "keep")))
    # The row travels as one value, so no name of it can meet one of ours; its text goes beside it, once.
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    row = F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", text_key(F.col("text")))
    # Bitmaps grow with the corpus: never broadcast.
    rows = rows.join(marks.hint("merge"), F.col("id").eqNullSafe(F.col("mark_doc_id")) & (F.col("tkey") == F.col("mark_tkey")), "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        def one(t, k):
            if k is None:
                return t
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little", count=len(lines))
            return "\n".join(x for x, b in zip(lines, bits) if b)

        return pd.Series([one(t, k) for t, k in zip(text, keep)])

    whole = [F.col("row").getField(c).alias(c) for c in others]
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return rows.select(
        *whole,
        F.when(F.col("mark_keep").isNull(), F.col("text")).otherwise(kept("text", "mark_keep")).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("mark_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
