"""Streamed log tails whose state ends."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirewise.operators.runs import log_tail
from quirewise.streaming import progress

LOG = "run_id string, seq long, line string, exit_code int"


@pytest.fixture
def stores(spark):
    before = {k: spark.conf.get(k, None) for k in progress.STATE_STORE}
    for k, v in progress.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_state_ends_with_its_run(spark, stores, tmp_path):
    src, out, place = (str(tmp_path / x) for x in ("log", "tails", "ck"))

    def arrive(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)

    first = [("a", i, f"line {i}", None) for i in range(20)] + [("a", 20, "last", 0), ("b", 0, "open", None), (None, 1, None, None)]
    second = [("b", i, f"line {i}", None) for i in range(1, 4)] + [("b", 3, "line 3", None)]
    late = [("a", 21, "late", None)]
    arrive(first)
    tails = progress.stream_tail_ending(spark.readStream.schema(LOG).parquet(src), 6, 2, after_exit_ms=8_000)

    def put(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = tails.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", place).trigger(processingTime="1 second").start()

    def until(fits):
        """The rows of the store, batch by batch, once they fit."""
        end = time.time() + 60
        while time.time() < end and q.isActive:
            held = [(p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in q.recentProgress if p["stateOperators"]]
            if fits(held):
                return held
            time.sleep(0.5)
        raise AssertionError((q.exception(), [p.json for p in q.recentProgress[-3:]]))

    try:
        # Ended run a leaves the store; b, still open, and the null run stay.
        held = until(lambda h: sum(n for n, _ in h) >= len(first) and h[-1][1] < max(s for _, s in h))
        least = held[-1][1]
        assert least > 0
        arrive(second)
        until(lambda h: sum(n for n, _ in h) >= len(first) + len(second))
        arrive(late)
        until(lambda h: sum(n for n, _ in h) >= len(first) + len(second) + len(late))
    finally:
        q.stop()
    # What was emitted, merged, is what the whole log's tails are, the late line included.
    rows = [(str(r) if r else r, s, line) for r, s, line, _ in first + second + late if line is not None]
    log = spark.createDataFrame(sorted(set(rows), key=str), "run_id string, seq long, line string")
    got = progress.newest_lines(spark.read.parquet(out).drop("batch").withColumn("line", F.col("line")), 6)
    cols = ["run_id", "seq", "line"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in log_tail(log, 6).select(cols).collect()}


def test_a_key_of_a_tail_is_kept_without_frames(spark, monkeypatch):
    class Captured:
        """Stands for the frames up to the stateful operator and gives its function."""

        select = groupBy = lambda self, *a: self
        applyInPandasWithState = lambda self, fn, *a: fn

    class State:
        exists, get = True, ([4, 6], ["d", None])

        def update(self, value):
            self.value = value

    def refuse(*a, **k):
        raise AssertionError("a frame was put together for one key")

    keep, state = progress.stream_tail(Captured(), 3), State()
    batches = [pd.DataFrame({"seq": s, "line": x}) for s, x in (([7, 1], ["g", "a"]), ([5], ["e"]))]
    monkeypatch.setattr(pd, "concat", refuse)
    (out,) = keep(("r", 0), iter(batches), state)
    assert state.value == ([5, 6, 7], ["e", None, "g"])
    assert out.to_dict("list") == {"run_id": ["r"] * 3, "seq": [5, 6, 7], "line": ["e", None, "g"]}
