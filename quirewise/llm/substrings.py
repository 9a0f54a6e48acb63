"""Substring dedup: word windows that also start earlier, found by FM-indexes of content shards.

Every window of 20 words has an anchor: the smallest hash among its 8-word
grams.  Windows in a row with one anchor form a segment, and equal windows have
equal anchors, so all copies of a window meet in the shard of their anchor,
whatever documents they stand in.  A first shuffle of hashes, by content, settles
segments that are equal as a whole; counts of segments by anchor then drop anchors
that stand alone; the text of what is left goes to shards.  Each shard builds a compressed FM-index of its segments
in corpus order and streams them through it: backward search from the right end
of a window, which on failure also rules out all windows over the failing
piece, gives the matching statistics above the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import NULL_ID, WordHashes, chunks, doc_rows, grams, mix, partitions, stage_table, word_hashes
from quirewise.llm.fmindex import FmIndex

WINDOW, ANCHOR = 20, 8
#: An anchor with more distinct segments than this is dealt out window by window.
HOT = 4096
#: Segments that one FM-index holds on average.
SHARD = 8192
EQUAL, OPEN, OPEN_HOT = 1, 2, 3

_CACHE = WordHashes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _span_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of words[start:stop], depending on the words alone."""
    n = len(words)
    power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))))
    back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(words) * power[:n])))
    return mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def _leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of every w neighbours."""
    at, width = np.arange(len(x)), 1

    def join(a, b):
        return np.where(x[b] < x[a], b, a)

    while width * 2 <= w:
        at = join(at[:-width], at[width:])
        width *= 2
    n = len(x) - w + 1
    return join(at[:n], at[w - width : w - width + n]) if width < w else at


def segments_of(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, k: int = ANCHOR):
    """Per segment: document (index), first window (word index in it), number of windows, anchor, content hash."""
    if len(words) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = grams(words, k)
    low = _leftmost_min(g, window - k + 1)
    begins = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    within = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0), np.maximum(counts - window + 1, 0))
    at = begins[doc] + within
    mark = low[at]
    new = np.ones(len(doc), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(doc)))
    start = at[head]
    return doc[head], within[head], count, g[mark[head]], _span_hashes(words, start, start + count + window - 1)


def _firsts(anchor, seg, doc, tkey, tkey2, start):
    """Order by content and place; which rows are the first of their content, and which repeat the row before."""
    order = np.lexsort((start, tkey2, tkey, doc, seg, anchor))
    first, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    same = [x[order][1:] == x[order][:-1] for x in (anchor, seg, doc, tkey, tkey2, start)]
    first[1:] = ~(same[0] & same[1])
    again[1:] = np.logical_and.reduce(same)
    return order, first, again


MARK = "pkey long, anchor long, seg long, doc_id long, tkey long, tkey2 long, start int, count int, kind int"
MARK_COLUMNS = ("pkey", "anchor", "seg", "doc_id", "tkey", "tkey2", "start", "count", "kind")
MARK_TYPES = (np.int64,) * 6 + (np.int32,) * 3


#: What is kept of the marks: contents are merged by then, and each open row is one of its anchor's.
SETTLED_COLUMNS = ("anchor", "doc_id", "tkey", "tkey2", "start", "count", "kind")
SETTLED = "anchor long, doc_id long, tkey long, tkey2 long, start int, count int, kind int"
#: A document: its id and 128 bits of its text, as rows may share an id or have none.
DOCUMENT = ("doc_id", "tkey", "tkey2")


def _batches(columns: dict[str, np.ndarray], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, size):
        yield pa.RecordBatch.from_pydict({c: pa.array(v[at : at + size]) for c, v in columns.items()})


def _keyed(docs: DataFrame) -> DataFrame:
    rows = doc_rows(docs)
    return rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), *text_keys(F.col("text")), "text")


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, as two numbers."""
    return F.xxhash64(text).alias("tkey"), F.xxhash64(F.lit(1), text).alias("tkey2")


def _of_document(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``spans`` has for their document."""
    spans = spans.withColumnsRenamed({c: f"_{c}" for c in DOCUMENT})
    same = [F.col(c) == F.col(f"_{c}") for c in DOCUMENT]
    return rows.join(spans.hint("merge"), same[0] & same[1] & same[2], how)


def _cut(window: int):
    """All segments of a task; those that repeat an earlier one of the task are settled here."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in chunks(batches):
            words, counts = word_hashes(batch.column("text").to_pylist(), False, _CACHE)
            doc, start, count, anchor, seg = segments_of(words, counts, window)
            place = (batch.column(c).to_numpy()[doc] for c in DOCUMENT)
            parts.append((anchor.view(np.int64), seg.view(np.int64), *place, start.astype(np.int32), count.astype(np.int32)))
        if not parts:
            return
        anchor, seg, doc, tkey, tkey2, start, count = (np.concatenate(x) for x in zip(*parts))
        order, first, again = _firsts(anchor, seg, doc, tkey, tkey2, start)
        kind = np.where(first, OPEN, EQUAL)
        keep = order[~again]
        kind = kind[~again]
        # By content, not by anchor: one anchor may own any share of the rows.
        content = mix(anchor[keep].view(np.uint64) ^ mix(seg[keep].view(np.uint64))).view(np.int64)
        pkey = np.where(kind == OPEN, content, mix((doc[keep] + start[keep]).astype(np.uint64)).view(np.int64))
        yield from _batches(dict(zip(MARK_COLUMNS, (x.astype(t) for x, t in zip((pkey, *(x[keep] for x in (anchor, seg, doc, tkey, tkey2, start, count)), kind), MARK_TYPES)))))

    return of


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one content: the first place stays open, repeats are settled.  A run has a row per task at most."""
    held: list[dict[str, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([h[c] for h in held]) for c in MARK_COLUMNS}
        settled = rows["kind"] == EQUAL
        rows["anchor"] = np.where(settled, 0, rows["anchor"])
        yield from _batches({c: rows[c][settled] for c in SETTLED_COLUMNS})
        rows = {c: v[~settled] for c, v in rows.items()}
        order, first, again = _firsts(*(rows[c] for c in ("anchor", "seg", *DOCUMENT, "start")))
        rows = {c: v[order] for c, v in rows.items()}
        rows["kind"] = np.where(first, OPEN, EQUAL).astype(np.int32)
        rows["anchor"] = np.where(first, rows["anchor"], 0)
        yield from _batches({c: rows[c][~again] for c in SETTLED_COLUMNS})

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in MARK_COLUMNS}
        cut = int(np.searchsorted(now["pkey"], now["pkey"][-1]))
        if cut or (held and held[-1]["pkey"][-1] != now["pkey"][0]):
            held.append({c: v[:cut] for c, v in now.items()})
            yield from out()
            held = []
        held.append({c: v[cut:] for c, v in now.items()})
    if held:
        yield from out()


SHARD_ROW = "shard long, doc_id long, tkey long, tkey2 long, start int, count int, words string"


def _spell(window: int, shards: int):
    """The words of open segments; of hot anchors each window by itself, once per task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for batch in chunks(batches):
            out: list[tuple] = []
            for *document, text, spans in zip(*(batch.column(c).to_pylist() for c in (*DOCUMENT, "text", "spans"))):
                words = text.encode("utf-8", "surrogatepass").split()
                for span in sorted(spans, key=lambda s: s["start"]):
                    at, count = span["start"], span["count"]
                    if span["kind"] == OPEN:
                        shard = int(mix(np.array([span["anchor"]], np.int64).view(np.uint64))[0] % np.uint64(shards))
                        out.append((shard, *document, at, count, b" ".join(words[at : at + count + window - 1]).decode("utf-8", "surrogatepass")))
                        continue
                    for p in range(at, at + count):
                        piece = b" ".join(words[p : p + window])
                        digest = hashlib.blake2b(piece, digest_size=16).digest()
                        key, place = int.from_bytes(digest, "little"), (*document, p)
                        before = seen.setdefault(key, place)
                        shard = key % shards
                        if before < place:
                            out.append(((document[0] + p) % shards, *place, 1, None))
                        else:
                            if place < before:  # the earlier one came later: the other one repeats it
                                seen[key] = place
                                out.append(((before[0] + p) % shards, *before, 1, None))
                            out.append((shard, *place, 1, piece.decode("utf-8", "surrogatepass")))
            if out:
                names = ("shard", *DOCUMENT, "start", "count", "words")
                types = (*(pa.int64(),) * 4, pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, zip(*out), types)})

    return of


def earlier_windows(pieces: list[list[bytes]], counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Per segment, which of its windows also start earlier in the list; by one FM-index over all segments."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    words = np.fromiter((_CACHE[w] for p in pieces for w in p), np.uint64, int(sizes.sum()))
    names, symbol = np.unique(words, return_inverse=True)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)  # 0 ends a segment
    text[np.repeat(begin, sizes) + np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = symbol + 1
    depth = 1 << int(max(sizes.max(), 2) - 1).bit_length()
    index = FmIndex(text, len(names) + 1, depth)
    hit = np.zeros((len(pieces), int(counts.max())), bool)
    lane, place = np.arange(len(pieces)), np.zeros(len(pieces), np.int64)
    while len(lane):
        start = begin[lane] + place
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
        matched = np.zeros(len(lane), np.int64)
        live = np.arange(len(lane))
        for step in range(window):
            a, b = index.extend(text[start[live] + window - 1 - step], lo[live], hi[live])
            more = b - a > 1  # an occurrence besides its own
            live = live[more]
            lo[live], hi[live], matched[live] = a[more], b[more], step + 1
            if not len(live):
                break
        found = live[index.first(lo[live], hi[live]) < start[live]]
        hit[lane[found], place[found]] = True
        # A piece that is nowhere else rules out every window over it.
        place = np.where(matched == window, place + 1, place + window - matched)
        left = place < counts[lane]
        lane, place = lane[left], place[left]
    return [hit[i, :n] for i, n in enumerate(counts.tolist())]


def _search(window: int):
    """Shards one after another: index, search, runs of windows found."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            known = rows.filter(pa.compute.is_null(rows["words"]))
            found = list(zip(*(known[c].to_pylist() for c in (*DOCUMENT, "start", "count"))))
            rows = rows.filter(pa.compute.is_valid(rows["words"]))
            # Equal rows are one document: of each of its pieces one copy is searched.
            place = np.stack([rows[c].to_numpy().astype(np.int64) for c in (*DOCUMENT, "start")])
            new = np.ones(rows.num_rows, bool)
            new[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0)
            rows = rows.filter(pa.array(new))
            places = list(zip(*(rows[c].to_pylist() for c in (*DOCUMENT, "start"))))
            if rows.num_rows:
                pieces = [w.encode("utf-8", "surrogatepass").split() for w in rows["words"].to_pylist()]
                for i, hit in enumerate(earlier_windows(pieces, rows["count"].to_numpy().astype(np.int64), window)):
                    if hit.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        for p, q in zip(edge[::2].tolist(), edge[1::2].tolist()):
                            *document, start = places[i]
                            found.append((*document, start + p, q - p))
            if found:
                types = (*(pa.int64(),) * 3, pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=[*DOCUMENT, "start", "count"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if held and held[-1].column("shard")[-1].as_py() != shard[a]:
                    yield from out()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    return of


def _opened(marks: DataFrame) -> tuple[DataFrame, int]:
    """The open rows of anchors with two or more distinct segments, marked where the anchor is hot; and their number.

    Segments of an anchor are counted by partial aggregates.  The counts come from
    written files, so a join too large to broadcast can still be split where an anchor is skewed.
    """
    rows = marks.filter(F.col("kind") == OPEN)
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct")).filter("distinct > 1")
    counts = stage_table(counts, "shared-anchors")
    kind = F.when(F.col("distinct") > HOT, OPEN_HOT).otherwise(OPEN)
    return rows.join(counts, "anchor").withColumn("kind", kind).drop("distinct"), counts.agg(F.sum("distinct")).head()[0] or 0


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id (``NULL_ID`` for null), tkey, tkey2, start, count: ``count`` windows from word ``start`` on also start earlier.

    Earlier is a smaller id (null before all), then an earlier place; different
    texts under one id go by the hash of the text, equal rows are one document.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = _keyed(docs)
    marks = rows.mapInArrow(_cut(window), MARK).repartition(n, "pkey").sortWithinPartitions("pkey")
    marks = stage_table(marks.mapInArrow(_settle, SETTLED), "segments")
    equal = marks.filter(F.col("kind") == EQUAL).select(*DOCUMENT, "start", "count")
    opened, shared = _opened(marks)
    shards = max(n, shared // SHARD)
    spans = opened.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("start", "count", "anchor", "kind")).alias("spans"))
    texts = _of_document(rows, spans, "inner").select(*DOCUMENT, "text", "spans")
    spelled = texts.mapInArrow(_spell(window, shards), SHARD_ROW).repartition(n, "shard").sortWithinPartitions("shard", *DOCUMENT, "start")
    return equal.union(spelled.mapInArrow(_search(window), "doc_id long, tkey long, tkey2 long, start int, count int"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space), for every row of ``docs``.

    A word goes if a window that also starts earlier covers it, judged on the
    input.  Null, empty and short texts lose nothing.  Other columns are not read.
    """
    spans = repeated_spans(docs, window).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("start", "count")).alias("gone"))
    rows = _of_document(_keyed(docs), spans, "left").select("doc_id", "text", "gone")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if gone:
                    edge = np.zeros(n + 1, np.int64)
                    for s in gone:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["count"] + window - 1] -= 1
                    stay = np.cumsum(edge)[:n] == 0
                    words = [w for w, k in zip(words, stay.tolist()) if k]
                out.append((None if doc == NULL_ID else doc, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            names, types = ("doc_id", "n_words", "n_removed", "text"), (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, zip(*out), types)})

    return rows.mapInArrow(of, "doc_id long, n_words long, n_removed long, text string")
