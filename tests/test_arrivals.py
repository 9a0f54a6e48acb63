"""The store of arrivals, runs without a log line, and headers inside long documents."""

from pyspark.sql import functions as F

from quirewise.catalogue import tables as t
from quirewise.operators import runs as R
from quirewise.plans import collection
from quirewise.plans.storage import materialize
from quirewise.streaming import arrivals as A

STRIP = "book_id string, page int, cols array<string>, full string, bucket string, arrival string"


def _pages(spark, *rows):
    return spark.createDataFrame([(b, p, [text], "", "mine", None) for b, p, text in rows], STRIP)


def test_an_arrival_reads_its_own_buckets_only(spark, tmp_path):
    store = str(tmp_path / "pages")
    for k in range(4):
        A.store_arrival(_pages(spark, *[(f"old{k}-{i}", 1, "t") for i in range(20)]), store, k, 4096)
    batch = _pages(spark, ("new", 1, "t"), ("new", 2, "t"))
    touched = A.store_arrival(batch, store, 4, 4096)
    rows = A.arrived_rows(spark, store, batch.schema, touched, 4)
    assert len(touched) == 1
    assert all(f"/bucket={touched[0]}/" in f for f in rows.inputFiles())
    whole, named = A.arrived_books(rows, 4)
    assert whole.columns == batch.columns
    assert [r.book_id for r in named.collect()] == ["new"]
    assert sorted((r.page, r.bucket) for r in whole.collect()) == [(1, "mine"), (2, "mine")]


def test_last_arrival_of_a_page_counts_and_a_retry_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "pages")
    first = _pages(spark, ("a", 1, "old"), ("a", 2, "kept"), (None, 1, "old"))
    second = _pages(spark, ("a", 1, "new"), (None, 1, "new"))
    A.store_arrival(first, store, 0, 8)
    for _ in range(2):
        touched = A.store_arrival(second, store, 1, 8)
    whole, _ = A.arrived_books(A.arrived_rows(spark, store, first.schema, touched, 1), 1)
    got = sorted((str(r.book_id), r.page, r.cols[0]) for r in whole.collect())
    assert got == [("None", 1, "new"), ("a", 1, "new"), ("a", 2, "kept")]
    # A batch that is run again sees what it saw the first time.
    again, _ = A.arrived_books(A.arrived_rows(spark, store, first.schema, touched, 0), 0)
    assert sorted(r.cols[0] for r in again.collect()) == ["kept", "old", "old"]
    assert A.store_arrival(first.limit(0), store, 2, 8) == []


def test_queued_runs_are_at_nothing(spark):
    log = spark.createDataFrame([("r", 1, "== Stage 1: layout ==", None)], "run_id string, seq long, line string, exit_code int")
    batch = spark.createDataFrame([("b", r) for r in ("r", "q", "nobody")], "batch_id string, run_id string")
    submitted = spark.createDataFrame([("q",)], "run_id string")
    rows = {r.run_id: (r.status, r.stage, r.progress) for r in R.batch_rows(batch, R.run_states(log), submitted).collect()}
    assert rows == {"r": ("running", R.STAGE_LAYOUT, 8.0), "q": ("queued", R.STAGE_QUEUED, 0.0)}


def test_long_documents_are_verified_without_their_texts(spark):
    head = "成都某嘉祥外国语学校初2026届新初一分班真卷数学"
    texts = [head, "1.题", head, "2.题", "3.题", "4.题"]
    strips = spark.createDataFrame([("b", i, [x], "") for i, x in enumerate(texts, 1)], "book_id string, page int, cols array<string>, full string")
    pages = strips.select("book_id", "page", F.lit(500.0).alias("width"), F.lit(800.0).alias("height"))
    lay = strips.select("book_id", "page", F.lit("1-up").alias("layout"), F.lit(None).cast("array<struct<x0:double,x1:double>>").alias("cuts"))
    result = collection.split_collections(collection.Inputs(strips, pages, layout=lay), keep=materialize)
    verdict, hidden = result.verify()
    assert [(r.n_columns, r.n_hidden, r.verdict) for r in verdict.collect()] == [(6, 1, "hidden")]
    assert [(r.page, r.col, r.hidden_title) for r in hidden.collect()] == [(3, 0, head)]
    # Findings are read from the written table; no scan asks for a text.
    plan = hidden._jdf.queryExecution().optimizedPlan().toString()
    assert "cols#" not in plan and "full#" not in plan


def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    for name, parts in (("file", 1), ("folder", 3)):
        spark.range(30).repartition(parts).write.parquet(str(tmp_path / name / "ids.parquet"))
    part = next((tmp_path / "file" / "ids.parquet").glob("*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "ids.parquet").write_bytes(part.read_bytes())
    (tmp_path / "folder" / "other.parquet").write_bytes(part.read_bytes())
    for name in ("one", "folder"):
        rows = t.arriving(spark, str(tmp_path / name), "ids", "id long")
        out, offsets = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-offsets")
        rows.writeStream.format("parquet").option("checkpointLocation", offsets).trigger(availableNow=True).start(out).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))
