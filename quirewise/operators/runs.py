"""Run logs to progress states, log tails and batch roll-ups.

``run_log`` is (run_id, seq, line, exit_code); a row with an exit code ends
the run.  Everything is built from aggregates that combine before the shuffle,
so the same expressions serve batch tables and streams, and a run that writes
a third of all lines still arrives as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The labels shown for each stage.
STAGE_LAYOUT = "① 布局分类（双栏/三栏）"
STAGE_READ = "② 高分 OCR（分栏识别校名/届次）"
STAGE_DETECT = "③ 检测试卷套数 / 起止页"
STAGE_SPLIT = "④ 拆分成单栏 PDF"
STAGE_DONE = "完成"
STAGE_QUEUED = "排队中"
EXIT_MESSAGE = ("流水线返回非零退出码（", "）。请查看日志。")
COARSE_STAGES = (
    ("stage 1|layout", "版式识别", 20),
    ("stage 2|ocr", "文字识别", 45),
    ("stage 3|extract", "试卷抽取", 70),
    ("stage 4|split", "生成拆分结果", 90),
    ("done|completed|完成", "处理完成", 100),
)
# End of fixed values.


def _share(line: Column, pattern: str, base: int, span: int) -> Column:
    """base + span * x / n for a matching "x/n"; base alone when n is 0."""
    x = F.regexp_extract(line, pattern, 1).try_cast("double")
    n = F.regexp_extract(line, pattern, 2).try_cast("double")
    return F.when(n == 0, float(base)).otherwise(base + span * x / F.nullif(n, F.lit(0.0)))


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("int")


def line_effects(line: Column) -> Column:
    """What a log line assigns; the first rule that fits is the only one."""
    has = lambda s: F.contains(line, F.lit(s))
    null = F.lit(None)
    share_read = _share(line, r"ocr done (\d+)/(\d+)", 15, 55)
    share_split = _share(line, r"\[\s*(\d+)/(\d+)\]", 85, 13)
    done = r"(\d+) exam PDFs,\s*(\d+) total pages"

    def effect(stage=null, progress=null, exams=null, s_exams=null, s_pages=null) -> Column:
        as_col = lambda v: F.lit(v) if not isinstance(v, Column) else v
        return F.struct(
            as_col(stage).cast("string").alias("stage"),
            as_col(progress).cast("double").alias("progress"),
            as_col(exams).cast("int").alias("exams"),
            as_col(s_exams).cast("int").alias("summary_exams"),
            as_col(s_pages).cast("int").alias("summary_pages"),
        )

    return (
        F.when(has("Stage 1"), effect(STAGE_LAYOUT, 8))
        .when(has("2-up") & has("3-up"), effect(progress=12))
        .when(has("Stage 2"), effect(STAGE_READ, 15))
        .when(has("ocr done"), effect(progress=share_read))
        .when(has("strips ->"), effect(progress=72))
        .when(has("Stage 3"), effect(STAGE_DETECT, 75))
        .when(has("TOTAL EXAMS"), effect(exams=_number(line, r"TOTAL EXAMS:\s*(\d+)")))
        .when(has("saved") & has("exam_sets"), effect(progress=82))
        .when(has("Stage 4"), effect(STAGE_SPLIT, 85))
        .when(line.startswith("[") & has(".pdf") & has("/"), effect(progress=share_split))
        .when(
            has("DONE."),
            effect(STAGE_DONE, 100, null, _number(line, done, 1), _number(line, done, 2)),
        )
    )


def run_states(run_log: DataFrame) -> DataFrame:
    """R1 + R2: latest state per run; works on a static or a streaming frame."""
    fx = run_log.select("run_id", "seq", "exit_code", line_effects(F.col("line")).alias("e"))

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))

    e = F.col("e")
    state = fx.groupBy("run_id").agg(
        latest(e["stage"]).alias("stage"),
        latest(e["progress"]).alias("progress"),
        latest(e["exams"]).alias("exams"),
        F.max_by(
            F.struct(e["summary_exams"].alias("exams"), e["summary_pages"].alias("pages")),
            F.when(e["summary_exams"].isNotNull(), F.col("seq")),
        ).alias("summary"),
        latest(F.col("exit_code")).alias("exit_code"),
        F.count(F.col("e")).alias("n_effects"),
        F.max("seq").alias("last_seq"),
    )
    done = F.col("exit_code") == 0
    return state.select(
        "run_id",
        F.when(F.col("exit_code").isNull(), "running").when(done, "done").otherwise("error").alias("status"),
        F.coalesce("stage", F.lit(STAGE_QUEUED)).alias("stage"),
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
        "exams",
        # A finished run that printed no summary reports its document count.
        F.when(F.col("summary").isNull() & done, F.col("exams"))
        .otherwise(F.col("summary.exams"))
        .alias("summary_exams"),
        F.col("summary.pages").alias("summary_pages"),
        F.when(
            F.col("exit_code") != 0,
            F.concat(F.lit(EXIT_MESSAGE[0]), F.col("exit_code").cast("string"), F.lit(EXIT_MESSAGE[1])),
        ).alias("error"),
        "last_seq",
    )


def coarse_stage(line: Column) -> Column:
    """struct<stage, progress> by the first marker in the lower-cased line."""
    low = F.lower(line)
    out = None
    for markers, stage, progress in COARSE_STAGES:
        s = F.struct(F.lit(stage).alias("stage"), F.lit(progress).alias("progress"))
        hit = low.rlike(markers)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def log_tail(run_log: DataFrame, n: int = 500) -> DataFrame:
    """K3: the last ``n`` lines of every run.

    Two steps, at any ``n``: the last n of every part of a run, then of the run,
    so no task sorts a whole long run.
    """
    parts = int(run_log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = run_log.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)))
    for keys in (("run_id", "part"), ("run_id",)):
        latest = Window.partitionBy(*keys).orderBy(F.desc("seq"))
        rows = rows.withColumn("rn", F.row_number().over(latest)).filter(F.col("rn") <= n)
    return rows.drop("rn", "part")


def batch_rows(batch_run: DataFrame, states: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """States of the runs of each batch.

    ``registry`` (run_id) names the submitted runs: one that has not logged yet is
    queued, at nothing.  Runs that neither it nor the states know drop out.
    """
    if registry is None:
        return batch_run.join(states, "run_id")
    submitted = registry.select("run_id").union(states.select("run_id")).distinct()
    rows = batch_run.join(submitted, "run_id").join(states, "run_id", "left")
    at_first = {"status": "queued", "stage": STAGE_QUEUED, "progress": 0.0}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in at_first.items() if c in rows.columns})


def batch_rollup(batch_run: DataFrame, states: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Queued runs of ``registry`` count in the totals."""
    status = F.col("status")
    done = status == "done"
    total = lambda c: F.sum(F.when(done, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    return (
        batch_rows(batch_run, states, registry)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status.isin("done", "error")).alias("completed"),
            F.count_if(status == "running").alias("running"),
            F.count_if(status == "queued").alias("queued"),
            F.floor(
                F.sum(F.coalesce("progress", F.lit(0.0))) / F.count(F.lit(1)) + F.lit(0.5)
            ).alias("percent"),
            total("summary_exams").alias("exams"),
            total("summary_pages").alias("pages"),
        )
    )
