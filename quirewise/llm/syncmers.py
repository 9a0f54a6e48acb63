"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its smallest inner s-mer stands at its
first or last place.  Whether it does depends on the k-mer alone, so equal
passages give equal anchors in whatever text they stand, and every stretch of
k - s + 1 k-mers holds at least one.  A fingerprint is the bottom sketch of the
hashes of all anchors of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import chunks, doc_rows, mix, partitions

K, S, SIZE = 16, 8, 64


def _rolling(chars: np.ndarray, s: int) -> np.ndarray:
    """Hash of the s code points from every position on (s a power of two), by doubling."""
    h = mix(chars + np.uint64(0x9E3779B97F4A7C15))
    width = 1
    while width < s:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1]) if width < w else out


def anchors_of(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of ``text``; none if it is shorter than ``k``."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(chars) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = _rolling(chars, s)
    low = _window_min(inner, k - s + 1)
    n = len(low)
    at = np.flatnonzero((inner[:n] == low) | (inner[k - s : k - s + n] == low))
    # The k-mer is covered by the s-mers at 0, s, ..., k-s.
    h = np.zeros(len(at), np.uint64)
    for i in range(0, k - s + 1, s):
        h = mix(h * np.uint64(3) + inner[at + i])
    return at, h


def sketch(text: str, k: int = K, s: int = S, size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest 32-bit hashes of the anchors, sorted; of the text itself if it has no anchor."""
    h = anchors_of(text, k, s)[1]
    if not len(h) and text:
        h = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "<u8")
    h = np.unique((h >> np.uint64(32)).astype(np.uint32))
    return h[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the anchors behind two sketches; of two empty texts 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == size or len(b) == size:
        union = union[:size]
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, pos, hash of every anchor: what positional matching joins on.

    Null and short texts have none; equal ids stay separate rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2_000_000):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                at, h = anchors_of(text, k, s)
                for i in range(0, len(at), 50_000):
                    part = slice(i, i + 50_000)
                    n = len(at[part])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * n, pa.int64()), "pos": pa.array(at[part]), "hash": pa.array(h[part].view(np.int64))})

    return doc_rows(docs).mapInArrow(of, "doc_id long, pos long, hash long")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint: the sketch as hexadecimal digits, eight to an anchor; empty for a null or empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2_000_000):
            prints = [sketch(t, k, s, size).astype(">u4").tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(prints, pa.string())})

    return doc_rows(docs).mapInArrow(of, "doc_id long, fingerprint string")


# ------------------------------------------------------------ a document and the next one


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, ahead, doc_id, text: rows by descending id in buckets, each bucket ending in the row after it.

    Buckets are ranges of ids between approximate quantiles (one number per
    partition reaches the driver).  The first document of every bucket is sent
    a second time, as the last row (``ahead``) of the bucket before it; the very
    first one follows the very last.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = doc_rows(docs).withColumn("_o", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = sorted({int(x) for x in rows.approxQuantile("_o", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy()), dtype="int32")

    heads = {r["b"]: r["h"] for r in rows.select(bucket_of("_o").alias("b"), "_o").groupBy("b").agg(F.max("_o").alias("h")).collect()}
    order = sorted(heads)
    first_of = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # order[-1] before order[0]
    ids, befores = list(first_of), list(first_of.values())

    @F.pandas_udf("int")
    def ahead_of(values):
        import pandas as pd

        at = pd.Series(befores, index=ids, dtype="int64").reindex(values.to_numpy())
        return pd.Series(at.fillna(-1).to_numpy().astype("int32"))

    both = rows.select("doc_id", "text", "_o", F.array(F.struct(bucket_of("_o").alias("b"), F.lit(False).alias("a")), F.struct(ahead_of("_o").alias("b"), F.lit(True).alias("a"))).alias("_p"))
    both = both.select(F.inline("_p").alias("bucket", "ahead"), "doc_id", "text", "_o").filter("bucket >= 0")
    order = [F.col("bucket"), F.col("ahead"), F.col("_o").desc(), F.col("text").desc()]
    return both.repartition(n, "bucket").sortWithinPartitions(*order).drop("_o")


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its second half replaced by the start
    of the next document in descending order of ids.  Equal ids follow each
    other by text; a null id comes last; a single document is its own next one.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda x: x.astype(">u4").tobytes().hex()
        last = None  # (bucket, doc, text, sketch) that waits for its next document
        for batch in chunks(batches, 2_000_000):
            out = []
            for bucket, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                own = sketch(text, k, s, size)
                if last is not None and last[0] == bucket:
                    _, before, whole, mine = last
                    cut = len(whole) // 2
                    edited = whole[: len(whole) - cut] + text[:cut]
                    changed = sketch(edited, k, s, size)
                    out.append((before, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hexed(mine), hexed(changed), likeness(mine, changed, size), likeness(mine, own, size)))
                last = None if ahead else (bucket, doc, text, own)
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, zip(*out), types)})

    return neighbours(docs).mapInArrow(of, schema)
