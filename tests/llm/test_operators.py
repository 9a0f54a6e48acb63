"""The numbered operators against brute force, on small and awkward tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.llm import binary, bpe, jaccard, lines, packing, pii, quality, substrings, syncmers, toxicity
from quirewise.llm.fmindex import FmIndex

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, keep string, n_lines string, rank int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("word" + str(x) for x in rng.integers(0, 900, n))


def awkward():
    shared, long = prose(1, 60), prose(2, 4000)
    texts = ["", "   \n\n ", "one", shared, shared + " tail", "head " + shared, long, "x " * 300, "a\nb\na\n\n b \nA", "é ß 漢字 \x1c z"]
    texts += [f"boiler plate line\n{prose(100 + i, 30)}\nCommon END " for i in range(12)]
    texts += [prose(3, 200).replace("word7", f"q{i}") for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(400, None), (3, shared), (None, prose(5, 40)), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "n", 1) for i, t in awkward()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark):
    """The same texts with one row per id."""
    rows = {i: t for i, t in awkward() if i is not None}
    return spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows.items()], SCHEMA), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def test_substrings(unique, docs, empty):
    df, rows = unique
    seen, want = set(), {}
    for i in sorted(rows):
        w, gone = words_of(rows[i]), set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone.update(range(p, p + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    assert {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(df).collect()} == want
    assert substrings.remove_repeats(docs).count() == docs.count()
    assert substrings.remove_repeats(empty).count() == 0


def substrings_by_hand(rows):
    """Rows (id, text) with equal rows as one document; ids with one text each, null before all."""
    seen, gone_of = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if words_of(t)}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = words_of(t), set()
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                gone.update(range(p, p + 20))
            seen.add(tuple(w[p : p + 20]))
        gone_of[i, t] = (i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return collections.Counter(gone_of.get((i, t or ""), (i, 0, 0, "")) for i, t in rows)


def test_substrings_of_repeated_rows(spark):
    rows = awkward() + [(500, "other start " + prose(1, 60)), (4, prose(1, 60) + " tail"), (None, prose(5, 40)), (500, "other start " + prose(1, 60))]
    df = spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows], SCHEMA).repartition(3)
    assert collections.Counter(map(tuple, substrings.remove_repeats(df).collect())) == substrings_by_hand(rows)


def test_substrings_where_text_keys_collide(spark, monkeypatch):
    """64 equal bits of two texts under one id, or none, are no document: 128 decide."""
    real = substrings.text_keys
    monkeypatch.setattr(substrings, "text_keys", lambda text: (F.lit(0).cast("long").alias("tkey"), real(text)[1]))
    x, y = prose(31, 24), " ".join(f"other{i}" for i in range(24))
    rows = [(1, x), (5, x), (5, y), (5, "short"), (None, x), (None, y), (None, prose(33, 50)), (None, None)]
    df = spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows], SCHEMA).repartition(3)
    out = collections.Counter(map(tuple, substrings.remove_repeats(df).collect()))
    # Null ids come first, and of different texts there those of y and x are apart.
    want = [(None, 24, 0, x), (None, 24, 0, y), (None, 50, 0, prose(33, 50)), (None, 0, 0, ""), (1, 24, 24, ""), (5, 24, 24, ""), (5, 24, 24, ""), (5, 1, 0, "short")]
    assert out == collections.Counter(want)
    rows = [(1, x), (5, x), (5, y)]
    df = spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows], SCHEMA).repartition(3)
    assert collections.Counter(map(tuple, substrings.remove_repeats(df).collect())) == collections.Counter([(1, 24, 0, x), (5, 24, 24, ""), (5, 24, 0, y)])


def test_toxicity_fits_on_a_bounded_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "k", "n", 1) for i in range(3000)] + [(2, "é" * 5000, "k", "n", 1), (3, None, "k", "n", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, (i or 0) % 2) for i in (1, 2, 3, 3, 4, None)], "doc_id long, quality int, toxic int")
    texts, table = toxicity.labelled_rows(docs, labels, toxicity.CATEGORIES, 100)
    assert len(texts) == 3 and table.tolist() == [[0, 1], [0, 0], [0, 1]] and texts[1:] == ["é" * 5000, ""] and texts[0].startswith("text ")
    few, _ = toxicity.labelled_rows(docs, labels, toxicity.CATEGORIES, 100, max_chars=100)
    assert "é" * 5000 not in few and len(few) <= 2
    assert toxicity.labelled_rows(docs.limit(0), labels, toxicity.CATEGORIES, 100)[0] == []


def test_clashing_names_and_odd_types(spark):
    rows = [(i, f"a\nshared\n{i}", {"k": i}, i, -i, "v") for i in range(12)] + [(None, None, None, 50, -50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>, _t_key int, `mark.keep` int, tkey string")
    out = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs.select("doc_id", "text"), min_docs=10, min_chars=1))
    got = {r["_t_key"]: r.asDict() for r in out.collect()}
    assert len(got) == 13 and out.columns == ["doc_id", "row", "_t_key", "mark.keep", "tkey", "text", "n_lines", "n_dropped"]
    assert all(got[i] == {"doc_id": i, "row": {"k": i}, "_t_key": i, "mark.keep": -i, "tkey": "v", "text": str(i), "n_lines": 3, "n_dropped": 2} for i in range(12))
    assert (got[50]["text"], got[50]["n_lines"], got[50]["n_dropped"]) == ("", 1, 0)


def test_substrings_spread_a_hot_anchor(spark, monkeypatch):
    """One passage with other text around it in each document: its segments are dealt out by content."""
    passage = prose(20, 30)
    rows = [(5000 + i, f"{prose(1000 + i, 25)} {passage} {prose(2000 + i, 25)}") for i in range(60)] + awkward()
    df = spark.createDataFrame([(i, t, "k", "n", 1) for i, t in rows], SCHEMA).repartition(3)
    marks = substrings._keyed(df).mapInArrow(substrings._cut(20), substrings.MARK).filter(f"kind = {substrings.OPEN}").collect()
    contents = collections.defaultdict(set)
    for r in marks:
        contents[r["pkey"]].add((r["anchor"], r["seg"]))
    assert max(collections.Counter(r["anchor"] for r in marks).values()) > 40
    assert max(map(len, contents.values())) == 1
    monkeypatch.setattr(substrings, "HOT", 8)
    assert collections.Counter(map(tuple, substrings.remove_repeats(df).collect())) == substrings_by_hand(rows)


def test_substrings_of_hot_anchors(unique, monkeypatch):
    df, _ = unique
    usual = sorted(map(tuple, substrings.remove_repeats(df).collect()))
    rows = [{"start": 0, "count": 2, "anchor": 5, "kind": substrings.OPEN_HOT}]
    import pyarrow as pa

    text = " ".join(f"t{i}" for i in range(21))
    span = pa.struct([("start", pa.int32()), ("count", pa.int32()), ("anchor", pa.int64()), ("kind", pa.int32())])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([2, 1], pa.int64()), "tkey": pa.array([1, 1], pa.int64()), "tkey2": pa.array([1, 1], pa.int64()), "text": [text, text], "spans": pa.array([rows, rows], pa.list_(span))})
    out = pa.Table.from_batches(list(substrings._spell(20, 4)(iter([batch])))).to_pylist()
    # Both windows stay open for the earlier document; the later one's are settled.
    assert {(r["doc_id"], r["start"]) for r in out if r["words"] is None} == {(2, 0), (2, 1)}
    assert usual


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=8), min_size=1, max_size=12))
def test_fm_windows(segments):
    pieces = [[b"%d" % x for x in s] for s in segments]
    counts = np.array([len(s) - 3 for s in segments])
    seen, want = set(), []
    for s in segments:
        row = []
        for p in range(len(s) - 3):
            row.append(tuple(s[p : p + 4]) in seen)
            seen.add(tuple(s[p : p + 4]))
        want.append(row)
    assert [h.tolist() for h in substrings.earlier_windows(pieces, counts, 4)] == want


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(1, 5), min_size=2, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=6))
def test_fm_counts(text, pattern):
    index = FmIndex(np.array([*text, 0]), 6, 8)
    lo, hi = np.array([0]), np.array([index.size])
    for c in reversed(pattern):
        lo, hi = index.extend(np.array([c]), lo, hi)
    n = len(pattern)
    assert (hi - lo)[0] == sum(text[i : i + n] == pattern for i in range(len(text) - n + 1))


def lines_by_hand(rows, min_docs, keep_first=False):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs_of = collections.defaultdict(set)
    for i, t in rows.items():
        for s in (t or "").split("\n"):
            docs_of[key(s)].add(i)
    bad = {k for k, v in docs_of.items() if k and len(v) >= min_docs}
    first, out = set(), {}
    for i in sorted(rows):
        kept, all_lines = [], (rows[i] or "").split("\n")
        for s in all_lines:
            k = key(s)
            if k not in bad or (keep_first and k not in first):
                kept.append(s)
            first.add(k)
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(unique, empty, keep_first):
    df, rows = unique
    kept = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=10, keep_first=keep_first))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in kept.collect()} == lines_by_hand(rows, 10, keep_first)
    assert lines.apply_bitmaps(empty, lines.keep_bitmaps(empty)).count() == 0


def test_lines_hot_key_over_partitions(spark):
    rows = {i: f"same\n{i}\nsame" if i % 3 else f"u{i}" for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        kept = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=10, keep_first=True))
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in kept.collect()} == lines_by_hand(rows, 10, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def components_by_hand(rows, n, percent):
    sets, parent = {}, {i: i for i in rows}
    for i, t in rows.items():
        w = words_of((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in rows}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(unique, docs, empty, n, percent):
    df, rows = unique
    assert {r[0]: (r[1], r[2]) for r in jaccard.link_components(df, n, percent).collect()} == components_by_hand(rows, n, percent)
    assert jaccard.link_components(docs, n, percent).count() == docs.count()
    assert jaccard.link_components(empty).count() == 0


def test_jaccard_long_lists(spark):
    """Far more near copies than a short list holds, some of them linked only through others."""
    base, rows = prose(9, 120).split(), {}
    for i in range(60):
        w = list(base)
        for p in range(i % 12):
            w[p] = f"new{p}" if i < 40 else f"odd{i}-{p}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    assert {r[0]: (r[1], r[2]) for r in jaccard.link_components(df, 4, 85).collect()} == components_by_hand(rows, 4, 85)


def test_chain_held_out(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(600):
        w = prose(1000 + i, 80).split()
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            w[rng.integers(80)] = str(rng.choice(["idiot", "stupid"]))
        texts.append(" ".join(w))
        labels.append((float(bad), float(toxic)))
    labels = np.array(labels)
    chain = toxicity.Chain.fit(texts[:450], labels[:450], ("low_quality", "toxic"))
    p = chain.predict(texts[450:])
    assert ((p >= chain.thresholds) == labels[450:]).mean(axis=0).min() > 0.97
    assert chain.models[1].dense.shape == (1,) and not np.isnan(chain.held_out).any()
    schema = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:80])] + [(None, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1 - int(labels[i, 0]), int(labels[i, 1])) for i in range(80)] + [(None, 1, None)], schema)
    assert toxicity.score(docs, toxicity.fit_chain(docs, known)).count() == 81
    assert toxicity.score(docs, toxicity.fit_chain(docs, known.limit(0))).count() == 81


def test_pii_base():
    text = "a.b@c.de, x@y 1.2.3.4 256.1.1.1 c 4111 1111-1111 1111, 4111111111111112, +49 (30) 123456 +1 +5"
    spans = {k: [text[a:b] for a, b in v] for k, v in pii.base_spans(text).items()}
    assert spans == {"email": ["a.b@c.de"], "ip": ["1.2.3.4"], "card": ["4111 1111-1111 1111"], "phone": ["+49 (30) 123456"]}


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="a.@-1203+ ()%", max_size=40))
def test_pii_base_equals_plain_patterns(text):
    plain = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15],
    }
    found = pii.base_spans(text)
    assert all(found[k] == v for k, v in plain.items())


def test_pii_field(docs, empty):
    field = pii.trained_field()
    new = {"please call (212) 555-7788 at noon": "(212) 555-7788", "write to anna at firma dot de now": "anna at firma dot de"}
    for text, span in new.items():
        _, found = pii.find_spans([text], field)[0]
        assert [text[a:b] for v in found.values() for a, b in v] == [span]
    for clean in ("order 2390409500648960 of 2001-2002, version 3.2.1", prose(4, 50), "", "9" * 3000):
        assert not any(pii.find_spans([clean], field)[0][1].values())
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(empty).count() == 0
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.filter("text is null").count() == docs.filter("text is null").count()
    assert pii.mask_text("to a@b.cd!", {"email": [(3, 9)], "ip": [], "card": [], "phone": []}) == "to <EMAIL>!"


def test_pii_spans_in_long_areas():
    """Spans at 150 places in a row around token 400, so over every end of a block; and spelled signs in capitals."""
    field = pii.trained_field()
    for value, kind in (("call (212) 555 0147 now", "phone"), ("mail jane at example dot com please", "email")):
        inner = value.split(" ", 1)[1].rsplit(" ", 1)[0]
        texts = ["it rained 20 mm " * 45 + "." * k + " " + value + " it rained 20 mm" * 20 for k in range(150)]
        for text, found in zip(texts, pii.field_spans(texts, field)):
            assert [text[a:b] for a, b in found[kind]] == [inner]
    for text, inner in {"mail JANE AT EXAMPLE DOT COM please": "JANE AT EXAMPLE DOT COM", "write to Ann (AT) firma (Dot) de now": "Ann (AT) firma (Dot) de"}.items():
        assert [text[a:b] for a, b in pii.field_spans([text], field)[0]["email"]] == [inner]


def test_field_blocks_equal_one_window(monkeypatch):
    field, rng = pii.trained_field(), np.random.default_rng(11)
    shapes = [*field.ids, "none of them"]
    windows = [[shapes[i] for i in rng.integers(0, len(shapes), n)] for n in (1, 400, 401, 511, 512, 513, 1700)]
    blocks = field.decode(windows)
    monkeypatch.setattr(pii, "LONGEST", 10_000)
    assert all((a == b).all() for a, b in zip(blocks, field.decode(windows)))


def test_field_decode_is_the_best_path():
    """Viterbi against all label paths of short windows."""
    import itertools

    field = pii.trained_field()
    window = [pii.shape(t) for t in ("call", " ", "555", "-")]
    ids = field._places([field.ids.get(s, 1) for s in window], len(window))
    e, t = field.scores(ids), field.move + field.allowed
    value = lambda p: field.start[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(window)), key=value)
    assert tuple(field.decode([window])[0]) == best


def test_packing(docs, empty):
    out = packing.pack_documents(docs, WORDS, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in out)
    assert len(by) <= -(-total // 64) * 11 / 9 + 1
    assert {r["doc_id"] for r in out} == {i for i, _ in awkward()}
    assert packing.pack_documents(empty, WORDS).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), min_size=1, max_size=8))
def test_plan_equals_best_fit_decreasing(histogram):
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            i = min(fits)[1] if fits else len(room)
            room[i:] = room[i:] or [20]
            room[i] -= length
    slots, ends = packing.plan(histogram, 20), collections.Counter()
    for r in slots.itertuples():
        for k in range(r.count):
            ends[r.sequence + k // r.per_sequence] += r.length
    assert len(ends) == len(room) and max(ends.values()) <= 20
    assert sum(ends.values()) == sum(k * v for k, v in histogram.items())


def test_syncmers(unique, docs, empty):
    df, rows = unique
    ids = sorted(rows, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    out = {r["doc_id"]: r for r in syncmers.edited_fingerprints(df).collect()}
    assert set(out) == set(rows)
    for i, r in out.items():
        text, nxt = rows[i] or "", rows[following[i]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == syncmers.sketch(text).astype(">u4").tobytes().hex()
        assert 0 <= r["near_edited"] <= 1
    assert syncmers.edited_fingerprints(docs).count() == docs.count()
    assert syncmers.edited_fingerprints(empty).count() == 0


@settings(deadline=None, max_examples=50)
@given(st.text(alphabet="abc", min_size=16, max_size=60), st.text(alphabet="abcd", max_size=20))
def test_anchors_are_context_free(text, before):
    at, h = syncmers.anchors_of(text)
    moved_at, moved = syncmers.anchors_of(before + text)
    inside = moved_at >= len(before)
    assert (moved_at[inside] - len(before)).tolist() == at.tolist() and (moved[inside] == h).all()


@settings(deadline=None, max_examples=50)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_permutation(size, key):
    assert sorted(binary.permute(np.arange(size), size, key)) == list(range(size))


def test_training_order(spark, unique, empty, tmp_path):
    df, rows = unique
    table = str(tmp_path / "docs")
    df.repartition(3).write.parquet(table)
    docs = spark.read.parquet(table)
    out = binary.write_training_order(docs, WORDS, key=7, out=str(tmp_path / "out"), length=32, per_shard=6).collect()
    by, total = {r["slot"]: r for r in out}, len(out)
    assert sorted(by) == list(range(total)) and total > 12
    # Every partition's documents one after another, cut every 32 ids: the numbers; the permutation of the numbers: the slots.
    codec, want = bpe.WordBpe(WORDS), []
    for part in docs.select("doc_id", "text").rdd.glom().collect():
        ids, owners = [], []
        for r in part:
            new = [e for e in np.frombuffer(codec.encode([r["text"] or ""])[0], "<u4").tolist()] + [49407]
            ids += new
            owners += [r["doc_id"]] * len(new)
        want += [(ids[i : i + 32], list(dict.fromkeys(owners[i : i + 32]))) for i in range(0, len(ids), 32)]
    assert total == len(want)
    slots = binary.permute(np.arange(total), total, 7).tolist()
    found = list(binary.read_slots(str(tmp_path / "out"), 0, total, 32))
    for number, (slot, (ids, owners)) in enumerate(zip(slots, want)):
        row = by[slot]
        assert found[slot].tolist() == ids and row["n_tokens"] == len(ids) and list(dict.fromkeys(row["doc_ids"])) == owners
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u2").tobytes())
        assert (row["number"], row["shard"], row["byte_offset"]) == (number, slot // 6, slot % 6 * 64)
    sizes = sorted((tmp_path / "out").glob("shard-*.bin"))
    assert {f.stat().st_size for f in sizes[:-1]} == {6 * 64} and len(sizes) == -(-total // 6)
    for start, stop in ((3, 9), (0, 1), (5, 6), (6, 6), (total - 1, total + 50), (total, total + 3)):
        assert [x.tolist() for x in binary.read_slots(str(tmp_path / "out"), start, stop, 32)] == [x.tolist() for x in found[start:stop]]
    assert set(d for r in out for d in r["doc_ids"]) == set(rows)
    assert binary.write_training_order(empty, WORDS, key=7, out=str(tmp_path / "none")).count() == 0


def test_training_order_of_rows_without_names(spark, tmp_path):
    """Null ids, repeated rows, columns named like ours: all are documents, each once."""
    rows = [(None, "a b c", 1), (None, "a b c", 1), (4, None, 2), (4, "", 3), (5, "word " * 300, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").withColumnRenamed("part", "slot")
    out = binary.write_training_order(df, WORDS, key=1, out=str(tmp_path / "out"), length=16, per_shard=4).collect()
    codec = bpe.WordBpe(WORDS)
    want = sum(len(x) // 4 + 1 for x in codec.encode([t or "" for _, t, _ in rows]))
    assert sum(r["n_tokens"] for r in out) == want
    assert sorted(r["slot"] for r in out) == list(range(len(out)))


def test_word_ids_equal_the_library():
    codec = bpe.WordBpe(WORDS)
    texts = [t or "" for _, t in awkward()] + ["It's I'LL Äöü ΣΑΣ don't<|endoftext|> 12a0", "a" * 500]
    want = [np.array(e.ids, "<u4").tobytes() for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want


def test_byte_ids_equal_the_library(docs, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for _, t in awkward()] + ["  a  b\n\n c", "▁a ▁<unk>", " " * 50, "🎉🎉\x00\x7f", "a" * 900]
    ids = codec.encode(texts)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [codec.decode(x).decode() for x in ids] == texts
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, back.collect()), key=key) == sorted([(i, t or "") for i, t in awkward()], key=key)
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_quality(docs, empty):
    table = quality.ledger(docs)
    assert table.count() == docs.count()
    for r, (_, text) in zip(sorted(table.collect(), key=str), sorted(awkward(), key=str)):
        assert r is not None
    by = {r["doc_id"]: r for r in table.collect() if r["doc_id"] is not None}
    for i, text in dict(x for x in awkward() if x[0] is not None).items():
        w, t = words_of(text), text or ""
        groups = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        covered = {q for p in range(len(w) - 7) if groups[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
        filled = [s for s in t.split("\n") if words_of(s)]
        got = by[i]
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)), i
        assert got["n_dup_lines"] == len(filled) - len(set(filled)) and got["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
    kept = quality.kept_documents(docs, "web-1")
    assert kept.columns == docs.columns and kept.count() == quality.apply_policy(table, "web-1").filter("kept").count()
    report = {r["rule"]: r for r in quality.ablations(table, "web-1").collect()}
    assert report["too_few_words"]["n_failing"] == table.filter("n_words < 20").count()
    assert quality.ablations(quality.ledger(empty), "web-1").count() == len(quality.POLICIES["web-1"])
