"""Run progress and log tails over a stream of log rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.runs import log_tail, run_states


def write_states(run_log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """R1 + R2 on a stream: changed states, appended batch by batch.

    Each micro-batch owns the partition ``batch=<id>`` and replaces it when
    retried, so a restart neither loses nor doubles a state.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        run_states(run_log)
        .writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Newest state of every run from the batches written so far."""
    states = spark.read.parquet(path)
    cols = [c for c in states.columns if c != "batch"]
    newest = states.groupBy("run_id").agg(F.max_by(F.struct(*cols), "batch").alias("s"))
    return newest.select("s.*")


TAIL = "run_id string, seq long, line string"
TAIL_STATE = "seqs array<long>, lines array<string>"


def stream_tail(run_log: DataFrame, n: int = 500, salts: int = 16) -> DataFrame:
    """The newest lines per run as a stateful stream (update mode).

    The state of one key is a list of at most ``n`` lines.  A run is spread
    over ``salts`` keys by line number, so a run writing most lines keeps
    ``salts`` tasks busy; ``newest_lines`` trims the union to ``n``.
    """

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Plain lists: most keys have a few rows, and a frame costs more than they do.
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += zip(batch["seq"].tolist(), batch["line"].tolist())
            held = sorted(held, key=lambda row: row[0])[-n:]
        seqs, lines = [seq for seq, _ in held], [line for _, line in held]
        state.update((seqs, lines))
        yield pd.DataFrame({"run_id": key[0], "seq": seqs, "line": lines})

    return (
        run_log.select(
            F.col("run_id").cast("string").alias("run_id"),
            F.pmod("seq", F.lit(salts)).alias("salt"),
            F.col("seq").cast("long").alias("seq"),
            "line",
        )
        .groupBy("run_id", "salt")
        .applyInPandasWithState(keep, TAIL, TAIL_STATE, "update", "NoTimeout")
    )


def newest_lines(tail: DataFrame, n: int = 500) -> DataFrame:
    """Batch view of what ``stream_tail`` emitted."""
    return log_tail(tail.distinct(), n)


# ------------------------------------------------------------ runs that end

#: ``transformWithState`` keeps its state in this store; the session has to name it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Tail(StatefulProcessor):
    """The newest ``n`` lines of one key, until its run has been over or silent for some time."""

    def __init__(self, n: int, after_exit_ms: int, silent_ms: int):
        self.n, self.after_exit_ms, self.silent_ms = n, after_exit_ms, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "seq long, line string")
        self.ended = handle.getValueState("ended", "exit_code int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, fresh = list(self.lines.get()), False
        for batch in rows:
            code = batch["exit_code"].dropna()
            if len(code):
                self.ended.update((int(code.iloc[-1]),))
            said = batch[batch["line"].notna()]
            fresh |= len(said) > 0
            held = sorted(set(map(tuple, held)) | set(zip(said["seq"].tolist(), said["line"].tolist())))[-self.n :]
        if fresh:
            self.lines.put(held)
        # One timer a key: what comes in puts the end off.
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        wait = self.after_exit_ms if self.ended.exists() else self.silent_ms
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)
        if fresh:
            yield pd.DataFrame({"run_id": key[0], "seq": [s for s, _ in held], "line": [x for _, x in held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.lines.clear()
        self.ended.clear()
        yield pd.DataFrame({"run_id": pd.Series([], dtype="object"), "seq": pd.Series([], dtype="int64"), "line": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def stream_tail_ending(
    run_log: DataFrame, n: int = 500, salts: int = 16, after_exit_ms: int = 600_000, silent_ms: int = 86_400_000
) -> DataFrame:
    """R3 with state that ends: as ``stream_tail``, but a run's lines leave the store.

    A run is spread over ``salts`` keys by line number; its exit row goes to all of
    them, so each knows the end.  ``after_exit_ms`` after the last row of an ended
    run, or ``silent_ms`` after the last one of any run, its state is dropped.  A row
    that comes later starts a tail of its own, which ends by the same rule;
    ``newest_lines`` merges it with what was emitted before, so no line is lost.  A
    null run is a run, a null line is no line; rows repeated are one.  Timers run by
    the clock, so the query needs a trigger that goes on, not ``availableNow``.
    """
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    own = F.pmod(F.coalesce("seq", F.lit(0)), F.lit(salts)).cast("int")
    rows = run_log.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("seq").cast("long").alias("seq"),
        "line",
        F.col("exit_code").cast("int").alias("exit_code"),
        own.alias("own"),
        F.explode(F.when(F.col("exit_code").isNull(), F.array(own)).otherwise(every)).alias("salt"),
    )
    rows = rows.withColumn("line", F.when(F.col("own") == F.col("salt"), F.col("line"))).drop("own")
    return rows.groupBy("run_id", "salt").transformWithStateInPandas(
        _Tail(n, after_exit_ms, silent_ms), outputStructType=TAIL, outputMode="Update", timeMode="ProcessingTime"
    )
