"""Vector codes against a plain loop over all entries."""

import collections
import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirewise.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def compress_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(4096 * float(np.float32(x))) for x in v]
            kept.append((i, label, ints))
    length = collections.Counter(len(k[2]) for k in kept if max(map(abs, k[2]), default=0) <= 1 << 26).most_common(1)[0][0]
    usable = [k for k in kept if len(k[2]) == length and max(map(abs, k[2]), default=0) <= 1 << 26]
    dim = length // parts
    cut = [[k[2][p * dim : (p + 1) * dim] for p in range(parts)] for k in usable]
    first = sorted(range(len(usable)), key=lambda i: (usable[i][0] is None, usable[i][0] or 0, usable[i][2]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for j, members in groups.items():
                books[p][j] = [sum(x) // len(members) for x in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, errors = [], collections.Counter()
    done = {id(k): c for k, c in zip(usable, cut)}
    for k in kept:
        code = error = None
        if id(k) in done:
            found = [near(c, b) for c, b in zip(done[id(k)], books)]
            code, error = "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)
            errors[k[1]] += error
        out.append((k[0], k[1], code, error))
    return collections.Counter((i, label, code, error, errors[label] if label in errors else None, sha) for i, label, code, error in out)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, 1, 64).astype("f4")], int(rng.integers(0, 4))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", "v") for r in rows], SCHEMA).repartition(3)


def test_awkward_vectors(spark):
    rows = vectors(120)
    hot = rows[5][1]
    rows += [(500 + i, hot, 2) for i in range(80)] + [(7, vectors(1, 9)[0][1], None), (7, rows[7][1], None), (7, rows[7][1], None), (None, rows[9][1], None)]
    rows += [(900, None, 1), (901, [1.0, None] * 32, 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] + [0.0] * 63, 1)]
    rows += [(904, [1.0] * 8, 1), (905, [], 3), (906, [1e30] * 64, 77), (907, [-0.0] * 64, 1)]
    found = vectorcodes.compress(frame(spark, rows))
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == compress_by_hand(rows)


def test_fewer_rows_than_entries_empty_vectors_and_tables(spark):
    rows = vectors(3)
    assert collections.Counter(map(tuple, vectorcodes.compress(frame(spark, rows)).collect())) == compress_by_hand(rows)
    assert [r["code"] for r in vectorcodes.compress(frame(spark, [(1, [], 0)])).collect()] == ["00" * 8]
    assert vectorcodes.compress(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectorcodes.compress(frame(spark, [(1, [1.0] * 9, 0)]))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.integers(1, 6), st.integers(0, 2**31), st.sampled_from([2, 50, 1 << 26]))
def test_equal_average_search_finds_the_nearest(entries, dim, seed, size):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-size, size, (entries, dim)), rng.integers(-size, size, (60, dim))
    for got, want in zip(vectorcodes.nearest(parts, book), vectorcodes.nearest_of_all(parts, book)):
        assert (got == want).all()


def test_decoding(spark):
    rows = vectors(40)
    ints = vectorcodes.integers(frame(spark, rows))
    books = vectorcodes.train(ints, 64)
    for r in vectorcodes.encode(ints, books).collect():
        gap = vectorcodes.decode(r["code"], books) - np.floor(4096 * np.array(rows[r["vec_id"]][1])).astype(int)
        assert int((gap**2).sum()) == r["error"]
