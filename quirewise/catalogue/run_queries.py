"""Run states, log tails and batches over the events, static and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..plans.storage import fresh_path
from ..streaming import progress
from . import query
from . import tables as t

_N = r"CAST(nullif(regexp_extract(line, '{0}', {1}), '') AS {2})"
EFFECTS = (
    f"g AS ({t.LOG_SQL}), fx AS (SELECT *, CASE "
    "WHEN contains(line, 'Stage 1') THEN 1 WHEN contains(line, '2-up') AND contains(line, '3-up') THEN 2 "
    "WHEN contains(line, 'Stage 2') THEN 3 WHEN contains(line, 'ocr done') THEN 4 WHEN contains(line, 'strips ->') THEN 5 "
    "WHEN contains(line, 'Stage 3') THEN 6 WHEN contains(line, 'TOTAL EXAMS') THEN 7 "
    "WHEN contains(line, 'saved') AND contains(line, 'exam_sets') THEN 8 WHEN contains(line, 'Stage 4') THEN 9 "
    "WHEN starts_with(line, '[') AND contains(line, '.pdf') AND contains(line, '/') THEN 10 WHEN contains(line, 'DONE.') THEN 11 "
    "ELSE 0 END AS rule FROM g), "
    "ev AS (SELECT run_id, seq, exit_code, "
    "CASE rule WHEN 1 THEN '① 布局分类（双栏/三栏）' WHEN 3 THEN '② 高分 OCR（分栏识别校名/届次）' "
    "WHEN 6 THEN '③ 检测试卷套数 / 起止页' WHEN 9 THEN '④ 拆分成单栏 PDF' WHEN 11 THEN '完成' END AS stage, "
    "CASE rule WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 15 WHEN 4 THEN 15 + 55 * "
    + _N.format(r"ocr done (\d+)/(\d+)", 1, "DOUBLE") + " / " + _N.format(r"ocr done (\d+)/(\d+)", 2, "DOUBLE")
    + " WHEN 5 THEN 72 WHEN 6 THEN 75 WHEN 8 THEN 82 WHEN 9 THEN 85 WHEN 10 THEN 85 + 13 * "
    + _N.format(r"\[\s*(\d+)/(\d+)\]", 1, "DOUBLE") + " / " + _N.format(r"\[\s*(\d+)/(\d+)\]", 2, "DOUBLE")
    + " WHEN 11 THEN 100 END AS progress, CASE rule WHEN 7 THEN " + _N.format(r"TOTAL EXAMS:\s*(\d+)", 1, "INTEGER")
    + " END AS exams, CASE rule WHEN 11 THEN " + _N.format(r"(\d+) exam PDFs,\s*(\d+) total pages", 1, "INTEGER")
    + " END AS s_exams, CASE rule WHEN 11 THEN " + _N.format(r"(\d+) exam PDFs,\s*(\d+) total pages", 2, "INTEGER")
    + " END AS s_pages FROM fx), "
    "st AS (SELECT run_id, arg_max(stage, seq) AS stage, arg_max(progress, seq) AS progress, arg_max(exams, seq) AS exams, "
    "arg_max(s_exams, seq) AS s_exams, arg_max(s_pages, seq) AS s_pages, arg_max(exit_code, seq) AS exit_code, max(seq) AS last_seq "
    "FROM ev GROUP BY run_id), "
    "states AS (SELECT run_id, CASE WHEN exit_code IS NULL THEN 'running' WHEN exit_code = 0 THEN 'done' ELSE 'error' END AS status, "
    "coalesce(stage, '排队中') AS stage, CAST(coalesce(progress, 0) AS DOUBLE) AS progress, exams, "
    "CASE WHEN s_exams IS NULL AND exit_code = 0 THEN exams ELSE s_exams END AS summary_exams, s_pages AS summary_pages, "
    "CASE WHEN exit_code <> 0 THEN '流水线返回非零退出码（' || exit_code || '）。请查看日志。' END AS error, last_seq FROM st)"
)
STATES = (
    f"WITH {EFFECTS} SELECT run_id, status, stage, round(progress, 6) AS progress, exams, summary_exams, summary_pages, "
    "error, last_seq FROM states"
)


def _rounded(states):
    return states.withColumn("progress", F.round("progress", 6))


@query("run_progress", STATES)
def run_progress(spark, sf_dir):
    return _rounded(R.run_states(t.run_log(spark, sf_dir)))


def _log_stream(spark, sf_dir):
    return t.arriving(spark, sf_dir, "events", t.LOG_SOURCE).selectExpr(*t.LOG_COLUMNS)


@query("run_progress_stream", STATES)
def run_progress_stream(spark, sf_dir):
    out = fresh_path(spark, "states")
    progress.write_states(_log_stream(spark, sf_dir), out, fresh_path(spark, "offsets")).awaitTermination()
    return _rounded(progress.current_states(spark, out))


@query(
    "coarse_stage",
    f"WITH g AS ({t.LOG_SQL}), l AS (SELECT run_id, seq, lower(line) AS low FROM g), c AS (SELECT run_id, seq, CASE "
    "WHEN regexp_matches(low, 'stage 1|layout') THEN '版式识别' WHEN regexp_matches(low, 'stage 2|ocr') THEN '文字识别' "
    "WHEN regexp_matches(low, 'stage 3|extract') THEN '试卷抽取' WHEN regexp_matches(low, 'stage 4|split') THEN '生成拆分结果' "
    "WHEN regexp_matches(low, 'done|completed|完成') THEN '处理完成' END AS stage FROM l) "
    "SELECT run_id, stage, CASE stage WHEN '版式识别' THEN 20 WHEN '文字识别' THEN 45 WHEN '试卷抽取' THEN 70 "
    "WHEN '生成拆分结果' THEN 90 WHEN '处理完成' THEN 100 END AS progress, count(*) AS n FROM c GROUP BY ALL",
)
def coarse_stage(spark, sf_dir):
    rows = t.run_log(spark, sf_dir).select("run_id", R.coarse_stage(F.col("line")).alias("c"))
    return rows.groupBy("run_id", F.col("c.stage").alias("stage"), F.col("c.progress").alias("progress")).agg(
        F.count(F.lit(1)).alias("n")
    )


_TAIL = (
    f"WITH g AS ({t.LOG_SQL}), rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM g) "
    "SELECT run_id, seq, line FROM rk WHERE rn <= 20"
)


@query("log_tail", _TAIL)
def log_tail(spark, sf_dir):
    return R.log_tail(t.run_log(spark, sf_dir), 20).select("run_id", "seq", "line")


@query("log_tail_stream", _TAIL)
def log_tail_stream(spark, sf_dir):
    out = fresh_path(spark, "tail")

    def put(changed, batch):
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    (
        progress.stream_tail(_log_stream(spark, sf_dir), 20, salts=4)
        .writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", fresh_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return progress.newest_lines(spark.read.parquet(out).drop("batch"), 20)


_BATCH = (
    f"{EFFECTS}, br AS (SELECT DISTINCT {', '.join(t.BATCH_COLUMNS)} FROM events), "
    "j AS (SELECT * FROM br JOIN states USING (run_id))"
)


@query("batch_lookup", f"WITH {_BATCH} SELECT batch_id, run_id, status, stage FROM j")
def batch_lookup(spark, sf_dir):
    states = R.run_states(t.run_log(spark, sf_dir))
    return R.batch_rows(t.batch_runs(spark, sf_dir), states).select("batch_id", "run_id", "status", "stage")


@query(
    "batch_rollup",
    f"WITH {_BATCH} SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS completed, "
    "count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, "
    "CAST(floor(sum(progress) / count(*) + 0.5) AS BIGINT) AS percent, "
    "CAST(sum(CASE WHEN status = 'done' THEN coalesce(summary_exams, 0) ELSE 0 END) AS BIGINT) AS exams, "
    "CAST(sum(CASE WHEN status = 'done' THEN coalesce(summary_pages, 0) ELSE 0 END) AS BIGINT) AS pages FROM j GROUP BY batch_id",
)
def batch_rollup(spark, sf_dir):
    states = R.run_states(t.run_log(spark, sf_dir))
    return R.batch_rollup(t.batch_runs(spark, sf_dir), states)


# Customers as the runs of a batch per nation; one in debt was never submitted, and counts only if it logged all the same.
SUBMITTED_COLUMNS = (
    "'nation' || CAST(c_nationkey AS STRING) AS batch_id",
    "CAST(c_custkey AS STRING) AS run_id",
    "c_acctbal >= 0 AS submitted",
)
_QUEUE = (
    f"{EFFECTS}, sr AS (SELECT {', '.join(SUBMITTED_COLUMNS)} FROM customer), "
    "q AS (SELECT sr.batch_id, sr.run_id, coalesce(status, 'queued') AS status, coalesce(stage, '排队中') AS stage, "
    "coalesce(progress, 0.0) AS progress, summary_exams, summary_pages FROM sr LEFT JOIN states ON states.run_id = sr.run_id "
    "WHERE submitted OR states.run_id IS NOT NULL)"
)


def _queue(spark, sf_dir):
    runs = t.table(spark, sf_dir, "customer").selectExpr(*SUBMITTED_COLUMNS)
    return runs.drop("submitted"), R.run_states(t.run_log(spark, sf_dir)), runs.filter("submitted")


@query("batch_lookup_queued", f"WITH {_QUEUE} SELECT batch_id, run_id, status, stage, round(progress, 6) AS progress FROM q")
def batch_lookup_queued(spark, sf_dir):
    """States of submitted runs, with those that have not logged yet."""
    rows = _rounded(R.batch_rows(*_queue(spark, sf_dir)))
    return rows.select("batch_id", "run_id", "status", "stage", "progress")


@query(
    "batch_rollup_queued",
    f"WITH {_QUEUE} SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS completed, "
    "count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued, "
    "CAST(floor(sum(progress) / count(*) + 0.5) AS BIGINT) AS percent, "
    "CAST(sum(CASE WHEN status = 'done' THEN coalesce(summary_exams, 0) ELSE 0 END) AS BIGINT) AS exams, "
    "CAST(sum(CASE WHEN status = 'done' THEN coalesce(summary_pages, 0) ELSE 0 END) AS BIGINT) AS pages FROM q GROUP BY batch_id",
)
def batch_rollup_queued(spark, sf_dir):
    return R.batch_rollup(*_queue(spark, sf_dir))
