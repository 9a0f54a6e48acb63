"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification a pair.

Documents with equal sets are one *set*; only sets are joined.  Shingles are
ordered rarest first by their counts over the whole corpus (counted in a table
of fixed size, so ties and collisions only cost time: any one global order gives
right prefixes).  Two sets at the threshold share a gram of their prefixes, so
sets meet in the lists of prefix grams.  Short lists give all their pairs; a
long list is linked to a few pivots first, and only what then still lies in
different components is paired with further pivots, so copies in their thousands
cost a few pairs each and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import WordHashes, chunks, components, doc_rows, freed, grams, mix, partitions, stage_table, word_hashes

#: Slots of the table of shingle counts (16 MB), and buckets of the suffix filter.
COUNT_BITS = 22
BUCKETS = 64
#: Bits of the filter over the sets to verify (4 MB, packed).
FILTER_BITS = 25
#: A list of more sets than this is first linked to pivots.
SHORT_LIST = 8
#: Ids are below this; sets that only rows without an id have get nodes from here on.
NO_ID = 1 << 62


def shingle_sets(texts: list[str], n: int, cache: WordHashes) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes.

    A-Z count as lower case.  A text with fewer words is one shingle as a whole;
    one without words has none.
    """
    words, counts = word_hashes(texts, True, cache)
    all_grams = grams(words, n)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(all_grams[at : at + count - n + 1]))
        elif count:
            out.append(mix(grams(words[at : at + count], count) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers."""
    value = xxhash.xxh3_128_intdigest(s.tobytes())
    lo, hi = value & (2**64 - 1), value >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


def overlap_needed(a, b, percent: int):
    """Least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many rarest shingles: a partner shares at least ceil(percent * n / 100) in all."""
    return n - (-(-(percent * n) // 100)) + 1


def _each(batches: Iterator[pa.RecordBatch], n: int):
    cache = WordHashes()
    for batch in chunks(batches, 3_000_000):
        yield batch, shingle_sets(batch.column("text").to_pylist(), n, cache)


def _corpus(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Per document its set's key, size and bucket counts; and the counts of all shingles.

    One pass over the texts.  Each task counts into an array of 2^22 slots, blocks
    of which add up by shuffle; 2^22 sums reach the driver, whatever the corpus.
    """
    rows = doc_rows(docs)
    schema = "doc_id long, s1 long, s2 long, n long, parts binary, block int, counts binary"
    kinds = {"doc_id": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "n": pa.int64(), "parts": pa.binary(), "block": pa.int32(), "counts": pa.binary()}

    def out(**cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_pydict({c: cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols.get(c, [None] * size), t) for c, t in kinds.items()})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch, sets in _each(batches, n):
            slots = np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)
            total += np.bincount(slots.astype(np.int64), minlength=1 << COUNT_BITS)
            keys = [set_key(s) for s in sets]
            parts = [np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 65535).astype("<u2").tobytes() for s in sets]
            yield out(doc_id=batch.column("doc_id"), s1=[k[0] for k in keys], s2=[k[1] for k in keys], n=[len(s) for s in sets], parts=parts)
        for block in range(0, 1 << COUNT_BITS, 1 << 16):
            part = total[block : block + (1 << 16)]
            if part.any():
                yield out(block=[block], counts=[zlib.compress(part.astype("<u8").tobytes(), 1)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(data), "<u8").astype(np.int64)
        for block, total in sums.items():
            packed = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([packed], pa.binary())})

    table = stage_table(rows.mapInArrow(freed(of), schema), "sets")
    blocks = table.filter("block is not null").select("block", "counts").repartition(partitions(docs.sparkSession), "block")
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    for r in blocks.mapInArrow(freed(add), "block int, counts binary").collect():
        counts[r["block"] : r["block"] + (1 << 16)] = np.frombuffer(bytes(r["counts"]), "<u4")
    return table.filter("block is null").drop("block", "counts"), counts


def _postings(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """gram, s1, s2, n, pos of the prefix of every set; a task emits equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for _, sets in _each(batches, n):
            cols: list[list] = [[], [], [], [], []]
            for s in sets:
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                keep = prefix_length(len(s), percent)
                order = np.lexsort((s, table[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[:keep]
                for col, value in zip(cols, (s[order].view(np.int64), np.full(keep, key[0]), np.full(keep, key[1]), np.full(keep, len(s)), np.arange(keep))):
                    col.append(value)
            if cols[0]:
                names = ("gram", "s1", "s2", "n", "pos")
                types = (np.int64, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v).astype(t)) for c, v, t in zip(names, cols, types)})

    return doc_rows(docs).mapInArrow(freed(of), "gram long, s1 long, s2 long, n int, pos int")


PAIR = "a1 long, a2 long, b1 long, b2 long"


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of whole runs of ``gram`` from sorted batches, about a batch at a time."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        gram = now["gram"]
        cut = int(np.searchsorted(gram, gram[-1]))  # sorted: where the last run begins
        if cut or (held and held[-1]["gram"][-1] != gram[0]):
            yield {c: np.concatenate([h[c] for h in held] + [now[c][:cut]]) for c in columns}
            held = []
        held.append({c: v[cut:] for c, v in now.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in columns}


def _distinct(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted rows without repeats of (gram, s1, s2): equal sets of other tasks."""
    keep = np.ones(len(rows["gram"]), bool)
    keep[1:] = (np.diff(rows["gram"]) != 0) | (np.diff(rows["s1"]) != 0) | (np.diff(rows["s2"]) != 0)
    return {c: v[keep] for c, v in rows.items()}


def _candidates(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of one list pass the length and positional filters."""
    a, b = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
    need = overlap_needed(a, b, percent)
    rest = 1 + np.minimum(a - rows["pos"][i] - 1, b - rows["pos"][j] - 1)
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (rest >= need)


def _pairs(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The pairs with the smaller key first, once each."""
    a1, a2, b1, b2 = rows["s1"][i], rows["s2"][i], rows["s1"][j], rows["s2"][j]
    swap = (a1 > b1) | ((a1 == b1) & (a2 > b2))
    cols = np.stack([np.where(swap, b1, a1), np.where(swap, b2, a2), np.where(swap, a1, b1), np.where(swap, a2, b2)])
    cols = np.unique(cols, axis=1)
    return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in zip(("a1", "a2", "b1", "b2"), cols)})


def _first_pairs(percent: int):
    """All pairs of short lists, pairs with the list's first set of long ones; long lists come back as rows too."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "s1", "s2", "n", "pos")
        none = pa.nulls
        for rows in _runs(batches, names):
            rows = _distinct(rows)
            start = np.flatnonzero(np.concatenate(([True], np.diff(rows["gram"]) != 0)))
            size = np.diff(np.append(start, len(rows["gram"])))
            first = np.repeat(start, size)
            place = np.arange(len(first)) - first
            length = np.repeat(size, size)
            lefts, rights = [], []
            for back in range(1, SHORT_LIST):
                right = np.flatnonzero((place >= back) & (length <= SHORT_LIST))
                lefts.append(right - back)
                rights.append(right)
            right = np.flatnonzero((place >= 1) & (length > SHORT_LIST))
            left, right = np.concatenate([*lefts, first[right]]), np.concatenate([*rights, right])
            ok = _candidates(rows, left, right, percent)
            pairs = _pairs(rows, left[ok], right[ok])
            if pairs.num_rows:
                blank = {c: none(pairs.num_rows, pa.int32() if c in ("n", "pos") else pa.int64()) for c in names}
                yield pa.RecordBatch.from_pydict({**{c: pairs.column(c) for c in pairs.schema.names}, **blank})
            long = length > SHORT_LIST
            if long.any():
                k = int(long.sum())
                yield pa.RecordBatch.from_pydict({**{c: none(k, pa.int64()) for c in ("a1", "a2", "b1", "b2")}, **{c: pa.array(rows[c][long]) for c in names}})

    return of


def _further_pairs(percent: int, begin: int, end: int):
    """Pairs of long lists between different components, with the pivots from ``begin`` to ``end``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "s1", "s2", "n", "pos", "label")
        for rows in _runs(batches, names):
            start = np.flatnonzero(np.concatenate(([True], np.diff(rows["gram"]) != 0)))
            for at, stop in zip(start.tolist(), np.append(start[1:], len(rows["gram"])).tolist()):
                label = rows["label"][at:stop]
                if (label == label[0]).all():
                    continue
                for pivot in range(at + begin, min(at + end, stop)):
                    other = np.arange(pivot + 1, stop)
                    other = other[rows["label"][other] != rows["label"][pivot]]
                    left = np.full(len(other), pivot)
                    ok = _candidates(rows, left, other, percent)
                    if ok.any():
                        yield _pairs(rows, left[ok], other[ok])

    return of


def _suffix_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lower bound of the hamming distance: sets differ at least by the differences of their bucket counts."""
    x = np.frombuffer(b"".join(a), "<u2").reshape(-1, BUCKETS).astype(np.int64)
    y = np.frombuffer(b"".join(b), "<u2").reshape(-1, BUCKETS).astype(np.int64)
    return pd.Series(np.abs(x - y).sum(axis=1))


def _verified(pairs: DataFrame, sets: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """a, b (nodes) of the pairs that reach the threshold.

    The suffix filter looks at bucket counts only: the hamming distance of two
    sets is at least the summed difference of their buckets.  What passes is
    counted exactly, once a pair.  Only sets of these pairs reach the shuffles.
    """

    def keys_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("a1").alias("s1")).union(rows.select("b1"))

    sets = _among(sets, keys_of(pairs))

    def side(x: str) -> DataFrame:
        return sets.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}"), F.col("node").alias(f"node_{x}"))

    def full(x: str) -> DataFrame:
        return contents.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("shingles").alias(f"set_{x}"))

    near = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    most = (F.col("na") + F.col("nb") - F.pandas_udf(_suffix_bound, "long")("pa", "pb")) / 2
    near = near.withColumn("most", most).filter(f"100 * most >= {percent} * (na + nb - most)").drop("pa", "pb", "most")
    near = stage_table(near, "near-pairs")
    contents = _among(contents, keys_of(near)).dropDuplicates(["s1", "s2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.select(["node_a", "node_b"]).filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_pydict({"a": kept.column("node_a"), "b": kept.column("node_b")})

    joined = near.join(full("a"), ["a1", "a2"]).join(full("b"), ["b1", "b2"])
    return joined.select("node_a", "node_b", "set_a", "set_b").mapInArrow(freed(count), "a long, b long")


def _bits_of(s1: np.ndarray) -> np.ndarray:
    """Two bits of the membership filter per key."""
    h = mix(s1.view(np.uint64))
    low = np.uint64((1 << FILTER_BITS) - 1)
    return np.concatenate([h & low, h >> np.uint64(64 - FILTER_BITS)]).astype(np.int64)


def _known(s1: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through: all it was built from, and few others while it is not full."""
    at = _bits_of(s1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).reshape(2, -1).all(axis=0)


def _membership(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over ``s1``, of a fixed size whatever the number of keys."""
    block = 1 << 16

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bits_of(batch.column("s1").to_numpy())] = True
        packed = np.packbits(bits)
        for at in np.unique(np.flatnonzero(packed) // block).tolist():
            part = zlib.compress(packed[at * block : (at + 1) * block].tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "bits": pa.array([part], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                sums[at] = sums.get(at, np.uint8(0)) | np.frombuffer(zlib.decompress(data), np.uint8)
        for at, data in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "bits": pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())})

    schema = "block int, bits binary"
    parts = keys.select("s1").mapInArrow(freed(of), schema).repartition(partitions(keys.sparkSession), "block").mapInArrow(freed(merge), schema)
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():
        packed[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return packed


def _among(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` that may have a key of ``keys``, picked before they are shuffled to a join."""
    shared = table.sparkSession.sparkContext.broadcast(_membership(keys))

    def known(s1: pd.Series) -> pd.Series:
        return pd.Series(_known(s1.to_numpy(), shared.value))

    return table.filter(F.pandas_udf(known, "boolean")("s1"))


def _contents(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """s1, s2, shingles (sorted unsigned 64 bit) of the sets whose ``s1`` is wanted.

    Sets are computed where the texts are and stay in their task: one emits equal
    sets once, another may repeat them.  A filter of fixed size keeps nearly all
    unwanted sets out; what it lets through joins with no pair.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_membership(wanted))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for _, sets in _each(batches, n):
            keys = [set_key(s) for s in sets]
            known = _known(np.array([k[0] for k in keys], np.int64), bits)
            hit = [i for i in np.flatnonzero(known).tolist() if len(sets[i]) and keys[i] not in seen and not seen.add(keys[i])]
            if hit:
                cols = {"s1": [keys[i][0] for i in hit], "s2": [keys[i][1] for i in hit]}
                yield pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.int64()) for c, v in cols.items()}, "shingles": pa.array([sets[i].astype("<u8").tobytes() for i in hit], pa.binary())})

    return doc_rows(docs).mapInArrow(freed(of), "s1 long, s2 long, shingles binary")


def link_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets
    of n-word shingles; ``component_id`` is the smallest id reachable by links.
    Documents without words link with nothing.  Rows with equal ids stay rows
    of their own; null ids take part, and a component of null ids alone has a
    null ``component_id``; rows that share an id count as one document for links.  Equal sets are linked by their key, without pairs.
    """
    spark = docs.sparkSession
    table, counts = _corpus(docs, n)
    # A node per set: its smallest id, or a number above all ids where all are null.
    sets = table.filter("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("parts").alias("parts"), F.min("doc_id").alias("rep"))
    sets = sets.withColumn("node", F.coalesce("rep", F.pmod("s1", F.lit(NO_ID)) + F.lit(NO_ID)))
    sets = stage_table(sets, "distinct-sets")

    lists = _postings(docs, n, percent, counts).repartition(partitions(spark), "gram").sortWithinPartitions("gram", "s1", "s2")
    found = stage_table(lists.mapInArrow(freed(_first_pairs(percent)), PAIR + ", gram long, s1 long, s2 long, n int, pos int"), "prefix-pairs")
    pairs = stage_table(found.filter("a1 is not null").select("a1", "a2", "b1", "b2").distinct(), "candidate-pairs")
    longer = found.filter("gram is not null").select("gram", "s1", "s2", "n", "pos")

    wanted = pairs.select(F.col("a1").alias("s1")).union(pairs.select("b1")).union(longer.select("s1"))
    contents = stage_table(_contents(docs, n, wanted), "set-contents")
    links = stage_table(_verified(pairs, sets, contents, percent), "links")
    label = components(links, "component")

    begin, end = 0, SHORT_LIST
    while True:
        nodes = sets.select("s1", "s2", "node").join(label, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
        labelled = longer.join(nodes, ["s1", "s2"])
        # Nothing is left to find in a list whose labels agree, or whose every set has been a pivot.
        ends = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
        open_lists = ends.filter((F.col("lo") != F.col("hi")) & (F.col("size") > begin)).select("gram")
        open_lists = stage_table(open_lists, "open-lists")
        if not open_lists.limit(1).count():
            break
        labelled = labelled.join(open_lists, "gram", "left_semi").repartition(partitions(spark), "gram").sortWithinPartitions("gram", "s1", "s2")
        more = stage_table(labelled.mapInArrow(freed(_further_pairs(percent, begin, end)), PAIR).distinct(), "further-pairs")
        fresh = stage_table(_verified(more, sets, contents, percent), "links")
        if fresh.limit(1).count():
            links = links.union(fresh)
            label = components(links, "component")
        begin, end = end, end * 8

    nodes = sets.select("s1", "s2", "node").join(label, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component_id"))
    out = table.select("doc_id", "s1", "s2", F.col("n").alias("n_shingles")).join(nodes, ["s1", "s2"], "left")
    # Without words there is no node, and a document is its own component.
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
