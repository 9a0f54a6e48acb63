"""The pipeline stage by stage against plain Python, and its entry."""

import collections

import pytest

import corpus_pipeline
from test_operators import components_by_hand, lines_by_hand, prose

from quirewise.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, f"shared footer line\n{prose(50 + i, 60)} mail x{i}@mail.example.com") for i in range(15)]
    near = prose(7, 100)
    rows += [(20, near), (21, near + " end"), (22, near), (30, "too short"), (31, None), (32, "### " * 200)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    return str(folder), dict(rows)


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(d.columns == columns for d in seen[:-1])
    want = {i: t for i, t in rows.items() if i not in (30, 31, 32)}
    assert {r[0] for r in seen[0].collect()} == set(want)
    want = {i: x[2] for i, x in lines_by_hand(want, 10, True).items()}
    assert {r[0]: r[1] for r in seen[1].collect()} == want
    found = components_by_hand(want, 5, 80)
    want = {i: t for i, t in want.items() if found[i][1] == i}
    assert {r[0]: r[1] for r in seen[2].collect()} == want
    masked = {i: pii.mask_text(t, pii.base_spans(t)) for i, t in want.items()}
    assert {r[0]: r[1] for r in seen[3].collect()} == masked
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    assert {r[0] for r in seen[4].collect()} == set(want)


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    near, other, alone, a, b = prose(7, 100), prose(8, 100), prose(9, 100), prose(10, 100), prose(11, 100)
    rows = [(1, near), (1, near), (None, near), (5, near + " end"), (None, other), (None, other), (None, alone), (2, a), (2, b), (3, b), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, near), (None, other), (None, alone), (2, a), (2, b), (None, None)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(want)


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark):
    near = prose(7, 100)
    rows = [(i, f"{near} {i}", "en", "s", 1, i, {"k": i}, -i) for i in range(4)] + [(9, prose(9, 100), "en", "s", 1, 9, None, -9)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _row int, number map<string,int>, `a.b` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) == ({0, 9} if stage is corpus_pipeline.near_duplicates else {0, 1, 2, 3, 9})
        assert all((r["_row"], r["a.b"], r["number"]) == (i, -i, None if i == 9 else {"k": i}) for i, r in got.items())
    empty = docs.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    ends = collections.Counter()
    for r in out:
        ends[r["sequence_id"]] += r["length"]
    assert out and max(ends.values()) <= 4096


def test_registered():
    import __spark_entry__ as entry_point

    names = entry_point.queries()
    assert "pipeline" in names and sum(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) == 13
