"""Shared helpers: stage tables, row identity, words, bounded batches, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.plans.storage import shared_dir  # noqa: F401

#: Fixed values of the contracts: white space, and a word as a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Stands for a null id where an id has to be compared.
NULL_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# ------------------------------------------------------------ stage tables


def stage_table(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and go on from the written files.

    The lineage ends there: a lost executor costs a re-read, never a re-run.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------ documents


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and nothing else, so other columns can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Tells rows with the same id but other texts apart when decisions are joined back."""
    return F.xxhash64(text)


def chunks(batches: Iterator[pa.RecordBatch], budget: int = 6_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``budget`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # Lengths alone: as Python strings a whole batch would stay in memory beside its chunks.
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def freed(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``of``, giving memory it no longer uses back to the system at the end of its task.

    Python workers stay for later tasks, and allocators keep what was freed; so
    the idle workers of one stage would take memory from the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(texts: list[str], lower: bool, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another (uint64), and the number of words of each text.

    ``bytes.split`` and ``bytes.lower`` know just the contracts' white space and A-Z.
    """
    counts, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = (raw.lower() if lower else raw).split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position on, as if there were no document ends."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + words[j : len(words) - n + 1 + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
    return out


# ------------------------------------------------------------ places and lookups


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, from 0 on in its group (nulls are one, order ascends with nulls first), and ``size``, the group's rows.

    A range sort by (group, order) deals one group over many tasks; a row number
    splits rows that are equal throughout.  The rows of each (partition, group),
    at most partitions + groups numbers, give the offsets.
    """
    keys = [group, *order, "_tie"]
    placed = (
        rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(partitions(rows.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    placed = stage_table(placed.drop("_tie"), name)
    ends = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col("_part").alias("_p"), "_group", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("size"),
    )
    both = placed.join(ends, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "size")


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, salt: Column, salts: int) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row per ``key``, null included); any key's rows are dealt over ``salts`` parts.

    Only the (key, part) pairs that occur ask for the table's row, so a rare key
    is not copied ``salts`` times, and no task gets a hot key's rows.
    """
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    asked = salted.select(F.col(key).alias("_key"), F.col("_salt").alias("_part")).distinct()
    values = [c for c in table.columns if c != key]
    answers = asked.join(table.select(F.col(key).alias("_of"), *values), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
    both = salted.join(answers, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_part")), "left")
    return both.drop("_salt", "_key", "_part")


# ------------------------------------------------------------ components


def components(links: DataFrame, name: str) -> DataFrame:
    """``node``, ``label``: the smallest node each node of ``links`` (a, b) reaches.

    Minimum labels over neighbours with pointer jumping, so chains need about
    log(length) rounds.  Every round is aggregates and joins on nodes, written
    to the shared folder; nothing but the count of changes reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage_table(both, f"{name}-edges")
    label = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = label.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = step.join(above, "label", "left").select("node", "old", F.least("label", "above").alias("label"))
        step = stage_table(step, f"{name}-labels")
        changed = step.filter("label <> old").limit(1).count()
        label = step.select("node", "label")
        if not changed:
            return label
