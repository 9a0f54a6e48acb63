"""Vector code compression: product codes found by equal-average search.

A vector is cut into equal parts, and each part is replaced by the index of the
nearest entry of its position's codebook.  The nearest entry is searched outward
from the part's component sum in entries sorted by theirs: by Cauchy-Schwarz a
squared distance is at least the squared gap of the sums over the dimension, so a
side is left once that bound strictly exceeds the best distance.  Ties go to the
lower index, and all arithmetic is on integers, so results do not depend on how
rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import partitions, spread_lookup, stage_table

#: Components are floor(SCALE * x).  Beyond LIMIT, or SUM over the components of a part, squares may leave 64 bits.
SCALE, LIMIT, SUM = 4096, 1 << 26, 1 << 30
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, for each row of ``parts`` (int64)."""
    dim = parts.shape[1]
    sums = entries.sum(axis=1)
    order = np.lexsort((np.arange(len(entries)), sums))
    sums, own = sums[order], parts.sum(axis=1)
    best = np.full(len(parts), np.iinfo(np.int64).max)
    found = np.full(len(parts), len(entries))
    middle = np.searchsorted(sums, own)
    for step in (-1, 1):
        at = middle - 1 if step < 0 else middle.copy()
        rows = np.arange(len(parts))
        while True:
            inside = (at[rows] >= 0) & (at[rows] < len(entries))
            rows = rows[inside]
            gap = own[rows] - sums[at[rows]]
            # gap² > best · dim, with best unknown at first; neither side leaves 64 bits within LIMIT and SUM.
            known = found[rows] < len(entries)
            rows = rows[~known | (gap * gap <= np.where(known, best[rows], 0) * dim)]
            if not len(rows):
                break
            entry = order[at[rows]]
            distance = ((parts[rows] - entries[entry]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < found[rows]))
            best[rows[better]], found[rows[better]] = distance[better], entry[better]
            at[rows] += step
    return found, best


def nearest_of_all(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by trying every entry."""
    distance = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    found = distance.argmin(axis=1)
    return found, distance[np.arange(len(parts)), found]


def integers(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (array of long, null where a component is beyond ``LIMIT``); rows without a vector, or with null or non-finite components, are dropped."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) <= LIMIT)
    rows = vectors.filter(vector.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.when(small, scaled).alias("v"))


def _parts(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Row, part, component."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1, dim) if dim else np.zeros((batch.num_rows, 0, 0), np.int64)


SUMS = "part int, entry int, n long, sums array<long>"


def _sums_of(codebooks: list[np.ndarray]):
    """One round over a task's rows: how many parts went to each entry, and their sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = codebooks[0].shape[1]
        n = [np.zeros(len(b), np.int64) for b in codebooks]
        sums = [np.zeros_like(b) for b in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _parts(batch, dim)
            for k, book in enumerate(codebooks):
                entry, _ = nearest(parts[:, k], book)
                n[k] += np.bincount(entry, minlength=len(book))
                np.add.at(sums[k], entry, parts[:, k])
        rows = [(k, e, int(n[k][e]), sums[k][e].tolist()) for k in range(len(codebooks)) for e in np.flatnonzero(n[k]).tolist()]
        if rows:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "entry", "n", "sums"])

    return of


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (parts of entries x components) after ``rounds`` rounds over all ``rows`` of ``integers``.

    A round sends one row per task, part and entry; the driver gets parts x entries rows.
    """
    dim = length // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dim)
    codebooks = [start[:, k].copy() for k in range(parts)]
    for _ in range(rounds if len(first) and dim else 0):
        sums = rows.select("v").mapInArrow(_sums_of(codebooks), SUMS).groupBy("part", "entry")
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
        for r in sums.agg(F.sum("n").alias("n"), *total).collect():
            codebooks[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance) for ``rows`` of ``integers``."""
    dim = codebooks[0].shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.zeros((batch.num_rows, len(codebooks)), np.uint8), np.zeros(batch.num_rows, np.int64)
            if dim:
                parts = _parts(batch, dim)
                for k, book in enumerate(codebooks):
                    entry, distance = nearest(parts[:, k], book)
                    code[:, k] = entry
                    error += distance
            codes = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(of, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, *,
    vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row with a vector of finite components.

    Codebooks start from the rows with the smallest ids (null after all others,
    equal ids by vector; equal rows count each), fewer entries where there are
    fewer rows.  All vectors have the length that most rows have (of equally
    frequent lengths the smallest); rows of another length, and rows with a component
    whose 4096-fold exceeds 2^26 (or 2^30 over the length of a part) in size, get null
    for code and error, as 64 bits may not hold their error, and take no part in
    codebooks or sums.  ``error`` is summed
    over equal labels, nulls together.  Empty vectors have codes of zeros and no
    error; an empty table gives no rows.  Lengths that ``parts`` does not divide
    raise ValueError.  At most 256 entries.  Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    rows = stage_table(integers(vectors, vector_col, id_col, label_col), "vector-parts")
    lengths = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").head()
    length = usual["length"] if usual else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    most = SUM // max(length // parts, 1)
    fits = F.col("v").isNotNull() & (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) <= most)
    usable = rows.filter(fits)
    codebooks = train(usable, length, parts, entries, rounds)
    coded = encode(usable, codebooks).unionByName(rows.filter(~F.coalesce(fits, F.lit(False))).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = stage_table(coded, "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    found = spread_lookup(coded, by_label, "label", F.xxhash64("vec_id", "code"), partitions(spark))
    return found.withColumn("codebooks_sha256", F.lit(digest(codebooks)))


def decode(code: str, codebooks: list[np.ndarray]) -> np.ndarray:
    """The integer components that a code stands for."""
    return np.concatenate([book[e] for book, e in zip(codebooks, bytes.fromhex(code))])
