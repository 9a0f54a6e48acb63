"""Merkle dataset manifest by time-forward processing.

Every row is a leaf, every group of rows a tree of fan 8, and the subroots of all
groups are the leaves of one tree above them.  A node is labelled by its height
and place, so children come before parents.  Nodes send their digest forward in
time to their parent: the priority queue ordered by label is Spark's sorted
exchange between blocks of three levels (it spills, and lost parts are computed
again), and a heap of at most a block's nodes inside them.  A sweep in reversed
order then sends each node the siblings on its way up, one message per block,
until every leaf has its whole proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import ascii_lower, partitions, positions, stage_table

FAN = 8
#: Levels that a task climbs at once; a block has FAN ** CLIMB nodes at most.
CLIMB = 3
BLOCK = FAN**CLIMB

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "g string, pos long, size long, digest binary"
MESSAGE = "g string, pos long, payload binary"
PROOF = "g string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(data: bytes) -> bytes:
    """Lowercase hex of the sha256, as bytes."""
    return hashlib.sha256(data).hexdigest().encode()


# ------------------------------------------------------------ one block


class ForwardQueue:
    """Messages to nodes that are not yet processed, received in order of label (the smallest or, reversed, the greatest first)."""

    def __init__(self, reverse: bool = False):
        self.sign = -1 if reverse else 1
        self.heap: list = []

    def __bool__(self) -> bool:
        return bool(self.heap)

    def send(self, label: tuple[int, int], slot: int, payload) -> None:
        heapq.heappush(self.heap, (self.sign * label[0], self.sign * label[1], slot, payload))

    def receive(self) -> tuple[tuple[int, int], list]:
        """The next label and all that was sent to it, by slot."""
        height, place = self.heap[0][:2]
        got = []
        while self.heap and self.heap[0][:2] == (height, place):
            got.append(heapq.heappop(self.heap)[3])
        return (self.sign * height, self.sign * place), got


def heights(size: int) -> int:
    """Levels above a row of ``size`` nodes until one remains."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def rise(digests: list[bytes], climbs: int) -> dict[tuple[int, int], list[bytes]]:
    """The runs (digests of the children) of all inner nodes ``climbs`` levels above ``digests``, by label; its last node is the top."""
    queue, runs = ForwardQueue(), {}
    for place, digest in enumerate(digests if climbs else []):
        queue.send((1, place // FAN), place % FAN, digest)
    while queue:
        (height, place), run = queue.receive()
        runs[height, place] = run
        if height < climbs:
            queue.send((height + 1, place // FAN), place % FAN, _hash(b"".join(run)))
    return runs


def fall(runs: dict[tuple[int, int], list[bytes]], count: int, climbs: int, above: list) -> list[list]:
    """For each of ``count`` nodes its levels upwards as (siblings before, siblings after), ``above`` being the top's."""
    queue, found = ForwardQueue(reverse=True), [above] * count
    if climbs:
        queue.send((climbs, 0), 0, above)
    while queue:
        (height, place), (suffix,) = queue.receive()
        run = runs[height, place]
        for slot in range(len(run)):
            mine = [(run[:slot], run[slot + 1 :]), *suffix]
            if height > 1:
                queue.send((height - 1, place * FAN + slot), 0, mine)
            else:
                found[place * FAN + slot] = mine
    return found


def fold(digest: bytes, levels: list) -> bytes:
    """The root that a digest and its siblings give."""
    for before, after in levels:
        digest = _hash(b"".join((*before, digest, *after)))
    return digest


def _pack(root: bytes, levels: list) -> bytes:
    parts = [bytes.fromhex(root.decode())]
    for before, after in levels:
        parts.append(bytes((len(before), len(after))) + b"".join(bytes.fromhex(d.decode()) for d in before + after))
    return b"".join(parts)


def _unpack(data: bytes) -> tuple[bytes, list]:
    at, levels = 32, []
    while at < len(data):
        n, m = data[at], data[at + 1]
        end = at + 2 + 32 * (n + m)
        digests = [data[p : p + 32].hex().encode() for p in range(at + 2, end, 32)]
        levels.append((digests[:n], digests[n:]))
        at = end
    return data[:32].hex().encode(), levels


# ------------------------------------------------------------ blocks in tasks


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of one (g, block) after another; a block is all that is held."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["g"], row["block"])
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _arrow(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_NODE = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
_MESSAGE = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("payload", pa.binary())])
_PROOF = pa.schema([("g", pa.string()), ("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _climb(rows: list[dict]) -> tuple[int, dict]:
    climbs = min(CLIMB, heights(rows[0]["size"]))
    return climbs, rise([r["digest"].hex().encode() for r in rows], climbs)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tops():
        for (g, block), rows in _blocks(batches):
            climbs, runs = _climb(rows)
            digest = bytes.fromhex(_hash(b"".join(runs[climbs, 0])).decode()) if climbs else rows[0]["digest"]
            yield g, block, -(-rows[0]["size"] // BLOCK), digest

    return _arrow(tops(), _NODE)


def _met(rows: list[dict]) -> tuple[bytes, list[dict], int, list[list]]:
    """A block that its message reached (first in order): root, nodes, climbs, levels of each node."""
    root, above = _unpack(rows[0]["payload"])
    climbs, runs = _climb(rows[1:])
    return root, rows[1:], climbs, fall(runs, len(rows) - 1, climbs, above)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def messages():
        for (g, _), rows in _blocks(batches):
            root, nodes, _, levels = _met(rows)
            for node, way in zip(nodes, levels):
                yield g, node["pos"], _pack(root, way)

    return _arrow(messages(), _MESSAGE)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def proofs():
        for (g, _), rows in _blocks(batches):
            root, nodes, _, levels = _met(rows)
            own = heights(nodes[0]["size"])
            for node, way in zip(nodes, levels):
                leaf = node["digest"].hex().encode()
                proof = _hash(b"".join(d for before, after in way for d in before + after))
                shown = leaf if node["shown"] is None else node["shown"].hex().encode()
                folded = fold(shown, way)
                out = (leaf, fold(leaf, way[:own]), root, proof, folded)
                yield g, node["doc_id"], *(x.decode() for x in out), folded == root

    return _arrow(proofs(), _PROOF)


# ------------------------------------------------------------ sweeps over all blocks


def _dealt(rows: DataFrame) -> DataFrame:
    """The queue between blocks: dealt by block, in order of label; a block's message (pos -1) comes before its nodes."""
    spread = rows.repartition(partitions(rows.sparkSession), "g", "block")
    return spread.sortWithinPartitions("g", "block", "pos")


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes and, for each block of them, the message to its top."""
    nodes = nodes.withColumns({"block": F.floor(F.col("pos") / BLOCK), "payload": F.lit(None).cast("binary")})
    known = {"g": "g", "block": "pos", "payload": "payload"}
    blank = [F.lit(-1).cast("long").alias(c) if c == "pos" else F.col(known[c]).alias(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes]
    return _dealt(nodes.unionByName(messages.select(*blank)))


def sweep_up(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (g, pos, size, digest) and each block level above, as written tables; the last has one row per group."""
    rounds = [nodes]
    most = nodes.agg(F.max("size")).head()[0] or 0
    while most > 1:
        dealt = _dealt(rounds[-1].withColumn("block", F.floor(F.col("pos") / BLOCK)))
        rounds.append(stage_table(dealt.mapInArrow(_up, NODE), name))
        most = -(-most // BLOCK)
    return rounds


def sweep_down(rounds: list[DataFrame], messages: DataFrame, name: str) -> DataFrame:
    """Messages (g, pos, payload) to the tops, carried down to the blocks of the lowest round."""
    for nodes in rounds[-2:0:-1]:
        messages = stage_table(_with_messages(nodes, messages).mapInArrow(_down, MESSAGE), name)
    return messages


def canonical(columns: tuple[str, ...] = COLUMNS, replaced: dict[str, Column] | None = None) -> Column:
    """What a leaf hashes: of each column ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value."""
    parts = []
    for name in columns:
        text = (replaced or {}).get(name, F.col(f"`{name}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    Groups are the values of ``group_col`` (null is one, before all others); their
    leaves ascend by ``id_col``, null first, rows of equal ids by digest.  A group
    of one has its leaf as subroot, a single group its subroot as root.  Null and
    empty texts differ in the leaf; texts of any length are hashed as a whole,
    equal rows have equal leaves at places next to each other, and an empty table
    gives no rows.  Other columns are not read.

    ``folded_root`` is recomputed from the siblings and from the row as shown: rows
    whose id in decimals has a crc32 that 3 divides show ``text`` in lower case
    (rows without an id or a text show what they are).
    """
    text = F.col(f"`{text_col}`")
    tampered = F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 0
    plain, changed = canonical(columns), canonical(columns, {text_col: ascii_lower(text)})
    leaves = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("g"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(F.sha2(plain, 256)).alias("digest"), F.when(tampered, F.unhex(F.sha2(changed, 256))).alias("shown"),
    )
    # Written before it is ranged, so that texts are hashed once and not for the range's sample too.
    leaves = positions(stage_table(leaves, "merkle-leaves"), "g", ["doc_id", "digest"], "merkle-order")
    trees = sweep_up(leaves.select("g", "pos", "size", "digest"), "merkle-nodes")
    # The tree over the subroots has one group, and its leaves are the groups.
    tops = positions(trees[-1].select(F.lit("").alias("all"), "g", "digest"), "all", ["g"], "merkle-subroots")
    crown = sweep_up(tops.select(F.col("all").alias("g"), "pos", "size", "digest"), "merkle-crown")
    start = crown[-1].select("g", "pos", F.col("digest").alias("payload"))  # the root, with no levels above it
    below = sweep_down(crown, start, "merkle-down")
    named = _with_messages(tops.select(F.col("all").alias("g"), "pos", "size", "digest"), below).mapInArrow(_down, MESSAGE)
    named = named.join(tops.select(F.col("g").alias("group"), F.col("pos").alias("at")), F.col("pos") == F.col("at"))
    messages = named.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "payload")
    messages = sweep_down(trees, messages, "merkle-down")
    return _with_messages(leaves, messages).mapInArrow(_prove, PROOF).drop("g")
