"""Token ids in training order: a keyed permutation of all sequences, written as fixed-stride shards.

Sequences are cut and written once, each with its scan partition and place in
it; counts per partition then number them from 0 to N-1.  A Feistel network over
the next even number of bits, walked until it lands inside, sends the number to
its global slot.  Shard and byte offset follow from the slot by division: every
shard but the last holds the same number of sequences, so a reader resumes at
any slot by multiplication.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.bpe import codec
from quirewise.llm.common import chunks, doc_rows, mix, shared_dir, stage_table

#: Ids of vocabularies below 65,535 take two bytes, others four; the largest value pads.
NARROW, WIDE = "<u2", "<u4"


def pad_of(kind: str) -> int:
    return (1 << 8 * np.dtype(kind).itemsize) - 1


def permute(numbers: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """The slots (0 to size-1) of ``numbers``: a bijection that depends on ``key``.

    Balanced Feistel network on 2h bits with 4^h >= size; values at or above
    ``size`` are sent through again (cycle walking), at most 4 times on average.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x = left << half | right
        out[todo] = x
        todo = todo[x >= size]
    return out.astype(np.int64)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _sequences(path: str, length: int, end_id: int, kind: str):
    """Sequences of one partition: documents one after another, cut every ``length`` ids, the last one padded."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
        bpe = codec("word", path)
        last, step = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize * length
        rest, owners = b"", []
        for batch in chunks(batches, 2_000_000):
            ids = batch.column("doc_id").to_pylist()
            for doc, tokens in zip(ids, bpe.encode(batch.column("text").to_pylist())):
                data, at = rest + np.frombuffer(tokens, "<u4").astype(kind).tobytes() + last, 0
                owners.append(doc)
                while len(data) - at >= step:
                    yield data[at : at + step], owners
                    at += step
                    owners = [doc]
                rest = data[at:]
                if not rest:
                    owners = []
        if rest:
            yield rest, owners

    return of


def numbered(sequences: DataFrame) -> tuple[DataFrame, int]:
    """``sequences`` (part, place, ...) with ``number``, from 0 on by part and place; and how many there are.

    The window runs over one row per scan partition, never over sequences.
    """
    counts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("of"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = stage_table(bases, "sequence-bases")
    total = bases.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    both = sequences.join(bases.drop("n"), F.col("part") == F.col("of"))
    return both.withColumn("number", F.col("base") + F.col("place")).drop("of", "base", "part", "place"), total


def write_training_order(
    docs: DataFrame,
    path: str,
    key: int,
    out: str | None = None,
    length: int = 2048,
    per_shard: int = 16_384,
    end_id: int = 49407,
    kind: str = NARROW,
) -> DataFrame:
    """Writes the shards and returns one row per sequence: slot, number, shard, byte_offset, n_tokens, ids_crc32, doc_ids, file.

    A record is ``length`` little-endian unsigned ids of 16 or 32 bits
    (``kind``); short sequences (one per scan partition at most) end in the
    largest value.  ``slot`` is ``permute(number, N, key)``, a shard holds the
    ``per_shard`` slots from ``shard * per_shard`` on (the last one the rest), and
    one task writes one shard, so tasks stay of one size at any input.
    ``ids_crc32`` is over the ids as stored.  Shard files are written beside
    their name and then moved, so a repeated task leaves the same file; numbers
    are taken from written sequences, so they are the same in every read.  A null
    or empty text is the single id ``end_id``; a document of several sequences is
    in the ``doc_ids`` of each; very long texts run on over as many sequences as
    they need; rows of equal ids are documents of their own; other columns are
    not read; an empty table writes nothing.  The folder is ``out`` or a new one
    under ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    cut = _sequences(path, length, end_id, kind)
    size = np.dtype(kind).itemsize

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), 0, []

        def emit():
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(held), pa.int32()),
                    "place": pa.array(range(first, first + len(held)), pa.int64()),
                    # Records are packed one by one, as they are shuffled one by one.
                    "ids": pa.array([pa.compress(x, "zstd", asbytes=True) for x, _ in held], pa.binary()),
                    "n_tokens": pa.array([len(x) // size for x, _ in held], pa.int64()),
                    "doc_ids": pa.array([x for _, x in held], pa.list_(pa.int64())),
                }
            )

        for record in cut(batches):
            held.append(record)
            if len(held) == 512:
                yield emit()
                first, held = first + 512, []
        if held:
            yield emit()

    stored = stage_table(doc_rows(docs).mapInArrow(sequences, "part int, place long, ids binary, n_tokens long, doc_ids array<long>"), "sequences")
    rows, total = numbered(stored)
    shards = max(1, -(-total // per_shard))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("number").to_numpy(), total, key)
            yield batch.append_column("slot", pa.array(slot)).append_column("shard", pa.array((slot // per_shard).astype(np.int32)))

    stride, pad = size * length, pad_of(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _filesystem(out)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, handle, name = None, None, ""

        def close():
            if handle is not None:
                handle.close()
                store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")

        for batch in batches:
            files, crcs = [], []
            for s, packed, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "n_tokens"))):
                if s != shard:
                    close()
                    shard, name = s, f"shard-{s:08d}.bin"
                    handle = store.open_output_stream(f"{root}/.{name}.{attempt}")
                data = pa.decompress(packed, n * size, "zstd", asbytes=True)
                handle.write(data + np.full(length - n, pad, kind).tobytes())
                files.append(f"{out}/{name}")
                crcs.append(zlib.crc32(data))
            offsets = batch.column("slot").to_numpy() % per_shard * stride
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("slot", "number", "shard")},
                    "byte_offset": pa.array(offsets, pa.int64()),
                    "n_tokens": batch.column("n_tokens"),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_ids": batch.column("doc_ids"),
                    "file": pa.array(files, pa.string()),
                }
            )
        close()

    kinds = "number long, n_tokens long, doc_ids array<long>, ids binary, slot long, shard int"
    keyed = rows.select("number", "n_tokens", "doc_ids", "ids").mapInArrow(slots, kinds)
    # The shard's number is the number of its task: one contiguous range of slots each.
    dealt = keyed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    written = dealt.mapInArrow(write, "slot long, number long, shard int, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>, file string")
    return stage_table(written, "shard-manifest")


def read_slots(folder: str, start: int, stop: int, length: int = 2048, kind: str = NARROW) -> Iterator[np.ndarray]:
    """The ids of slots ``start`` to ``stop`` - 1 in training order, without padding: how a trainer resumes.

    All shards but the last are as long as the first, so slot and shard size name the file and the place in it.
    """
    store, root = _filesystem(folder)
    stride = np.dtype(kind).itemsize * length
    files = sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("shard-")), key=lambda f: f.base_name)
    if not files:
        return
    per_shard = files[0].size // stride
    for shard in range(start // per_shard, min(len(files), -(-stop // per_shard))):
        base, count = shard * per_shard, files[shard].size // stride
        lo, hi = max(start - base, 0), min(stop - base, count)
        with store.open_input_file(files[shard].path) as f:
            f.seek(lo * stride)
            for _ in range(lo, hi):
                ids = np.frombuffer(f.read(stride), kind)
                yield ids[ids != pad_of(kind)]
