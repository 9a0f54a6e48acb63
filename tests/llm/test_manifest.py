"""The Merkle manifest against a plain recursive tree."""

import collections
import hashlib
import zlib

import pytest

from quirewise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, digest string, pos long, payload string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes, marks):
    """Root of a row of nodes, and per marked place its runs upwards as (siblings before, after)."""
    ways = {m: [] for m in marks}
    at = {m: m for m in marks}
    while len(nodes) > 1:
        for m in marks:
            first = at[m] // 8 * 8
            ways[m].append((nodes[first : at[m]], nodes[at[m] + 1 : first + 8]))
            at[m] //= 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def manifest_by_hand(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(*r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, ways = [], []
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, way = climb([x[1] for x in groups[g]], range(len(groups[g])))
        tops.append(top)
        ways.append(way)
    root, above = climb(tops, range(len(tops)))
    out = collections.Counter()
    for k, g in enumerate(langs):
        for place, (doc_id, digest, r) in enumerate(groups[g]):
            way = ways[k][place] + above[k]
            shown = digest
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r[1] is not None:
                shown = leaf(doc_id, lower(r[1]), *r[2:])
            for before, after in way:
                shown = H(*before, shown, *after)
            out[doc_id, digest, tops[k], root, H(*(s for b, a in way for s in b + a)), shown, shown == root] += 1
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 7, "z") for r in rows], SCHEMA).repartition(parts)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


ROWS = [(i, f"Text {i} É漢", "en", "s", 9) for i in range(1100)]
ROWS += [(i, None if i % 5 == 0 else "", "fr" if i % 2 else None, None, None) for i in range(2000, 2030)]
ROWS += [(None, "No id", "en", "s", 5), (None, None, None, None, None), (7, "Text 7 twice", "en", "s", 1)]
ROWS += [(8, "Text 8 É漢", "en", "s", 9)] * 3 + [(3000, "x" * 300_000, "é", "s", 300_000), (3001, "Alone", "", "s", 5)]


def test_manifest_of_awkward_rows(spark):
    assert rows_of(merkle.manifest(frame(spark, ROWS))) == manifest_by_hand(ROWS)


def test_many_groups_and_a_single_one(spark):
    many = [(i, f"T{i}", f"l{i % 70}", "s", 1) for i in range(300)]
    assert rows_of(merkle.manifest(frame(spark, many))) == manifest_by_hand(many)
    one = [(4, "Only", "en", "s", 4)]
    found = merkle.manifest(frame(spark, one)).head()
    assert (found["leaf"], found["leaf"], H()) == (found["subroot"], found["root"], found["proof_sha256"])


def test_equal_rows_and_an_empty_table(spark):
    same = [(5, "Same", "en", "s", 4)] * 90
    assert rows_of(merkle.manifest(frame(spark, same))) == manifest_by_hand(same)
    assert merkle.manifest(frame(spark, same).limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 511, 512])
def test_sweeps_of_a_block(count):
    digests = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(count)]
    climbs = merkle.heights(count)
    levels = merkle.fall(merkle.rise(digests, climbs), count, climbs, [])
    root, ways = climb([d.decode() for d in digests], range(count))
    assert {merkle.fold(d, w) for d, w in zip(digests, levels)} == {root.encode()}
    shown = [[([x.decode() for x in b], [x.decode() for x in a]) for b, a in w] for w in levels]
    assert shown == [ways[i] for i in range(count)]
    packed = [merkle._unpack(merkle._pack(root.encode(), w)) for w in levels]
    assert packed == [(root.encode(), w) for w in levels]


def test_queue_in_both_directions():
    for reverse in (False, True):
        queue = merkle.ForwardQueue(reverse)
        for label, slot in (((2, 0), 1), ((1, 5), 0), ((2, 0), 0), ((1, 2), 3)):
            queue.send(label, slot, (label, slot))
        got = []
        while queue:
            got.append(queue.receive())
        assert [label for label, _ in got] == sorted({(2, 0), (1, 5), (1, 2)}, reverse=reverse)
        assert dict(got)[2, 0] == [((2, 0), 0), ((2, 0), 1)]
