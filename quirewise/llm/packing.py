"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens.  Best fit runs over
counts, longest length first: a group of equal sequences takes a whole count at
once, so the plan's size depends on the number of lengths, not of documents.
Every piece then finds its slot by its rank within its length.  Ranks come from
counts per (length, bucket), so a length that a third of all pieces share is
ranked in many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.bpe import codec
from quirewise.llm.common import chunks, doc_rows, freed, partitions, stage_table

PIECES = "doc_id long, tkey long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, tkey, piece, start, length, ids_crc32 [, ids] of every piece of every document.

    A document is its ids and ``end_id``; only longer ones are cut.  A null or
    empty text is the single id ``end_id``.  ``ids`` are little-endian unsigned
    32-bit integers.  Equal rows stay separate; other columns are not read.
    """
    step = 4 * capacity

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec("word", path)
        last = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, 2_000_000):
            owner, piece, parts = [], [], []
            for row, ids in enumerate(bpe.encode(batch.column("text").to_pylist())):
                ids += last
                for n, at in enumerate(range(0, len(ids), step)):
                    owner.append(row)
                    piece.append(n)
                    parts.append(ids[at : at + step])
            cols = {c: batch.column(c).take(pa.array(owner, pa.int64())) for c in ("doc_id", "tkey")}
            cols |= {
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array([n * capacity for n in piece], pa.int64()),
                "length": pa.array([len(x) // 4 for x in parts], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
            }
            if keep_ids:
                cols["ids"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    rows = doc_rows(docs).withColumn("tkey", F.xxhash64("text"))
    return rows.mapInArrow(freed(of), PIECES + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """length, rank, count, sequence, per_sequence, offset: which slots the pieces of a length take.

    The ``count`` pieces of ``length`` from ``rank`` on fill the sequences from
    ``sequence`` on, ``per_sequence`` in each, the first at ``offset``.  Best fit
    decreasing: a piece goes to the fullest sequence that has room, and equal
    sequences (one group: first, number, room) are served together.
    """
    room: list[tuple[int, int, int]] = []  # (room left, first sequence, number of sequences), fullest first
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(room, (length, -1, -1))
            if at == len(room):
                each = capacity // length
                number = -(-left // each)
                room.append((capacity, opened, number))
                opened += number
                at = len(room) - 1
            free, first, number = room.pop(at)
            each = min(free // length, left)
            used = min(number, left // each)
            rows.append((length, rank, used * each, first, each, capacity - free))
            rank, left = rank + used * each, left - used * each
            if used < number:
                insort(room, (free, first + used, number - used))
            if free - each * length:
                insort(room, (free - each * length, first, used))
    return pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "per_sequence", "offset"]).astype("int64")


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, gapless) within ``key``, without one task per key.

    Rows get a bucket by hash; ranks inside (key, bucket) come from a window
    and the bucket's first rank from the counts of the buckets before it.
    """
    buckets = partitions(rows.sparkSession)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    bases = bases.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranks = rows.withColumn("_r", F.row_number().over(inside))
    return ranks.join(bases, [key, "_b"]).withColumn("rank", F.col("_base") + F.col("_r") - 1).drop("_b", "_r", "_base")


def pack(table: DataFrame, capacity: int = 4096) -> DataFrame:
    """``table`` (``length`` and what tells its rows apart) with ``sequence_id`` and ``offset``.

    ``table`` must be a written table: it is read for the histogram and for the
    ranks.  Only the histogram, at most ``capacity`` rows, reaches the driver; the
    plan that goes back to the tasks is of the order of the number of lengths.
    Lengths have to be from 1 to ``capacity``.  An empty table stays empty.
    """
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths from {min(histogram)} to {max(histogram)}, capacity {capacity}")
    slots = plan(histogram, capacity).sort_values(["length", "rank"], ignore_index=True)
    length, rank = slots["length"].to_numpy(), slots["rank"].to_numpy()
    first = np.searchsorted(length, np.arange(capacity + 2))
    sequence, each, offset = (slots[c].to_numpy() for c in ("sequence", "per_sequence", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(n), np.int64)
            for value in np.unique(n):
                mine = n == value
                lo, hi = first[value], first[value + 1]
                row[mine] = lo + np.searchsorted(rank[lo:hi], r[mine], side="right") - 1
            within = r - rank[row]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            cols["sequence_id"] = pa.array(sequence[row] + within // each[row])
            cols["offset"] = pa.array(offset[row] + within % each[row] * n)
            yield pa.RecordBatch.from_pydict(cols)

    order = [c for c in ("doc_id", "tkey", "piece") if c in table.columns] or ["length"]
    rows = ranked(table, "length", order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(freed(place), fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place."""
    table = stage_table(pieces(docs, path, capacity, end_id), "pieces")
    return pack(table, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
