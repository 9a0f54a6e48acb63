"""Ordered operators that stay parallel inside one huge group.

A window partitioned by book alone puts a whole book on one task.  Here the
order column is cut into blocks of a fixed width: rows are windowed per
(group, block), one summary row per block is combined across the group, and
the result is joined back on (group, block).  Row work therefore spreads over
blocks however large a group is, and only the block summaries meet on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 4096


#: Block of the rows without an order; it comes before all others.
FIRST_BLOCK = -(1 << 62)


def block_of(order: str, width: int = BLOCK_WIDTH):
    return F.coalesce(F.floor(F.col(order) / F.lit(width)).cast("long"), F.lit(FIRST_BLOCK))


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: str, out: str, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Row number (from 1) within ``group`` by the integer column ``order``.

    Equal to ``row_number()`` for an ``order`` that is never null and unique
    within the group.
    """
    group = list(group)
    # Groups compare null-safe, as partitionBy does.
    keys = [f"__g{i}" for i in range(len(group))]
    rows = df.withColumns(
        {**{k: F.struct(F.col(g).alias("v")) for k, g in zip(keys, group)}, "__block": block_of(order, width)}
    )
    sizes = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inner = Window.partitionBy(*keys, "__block").orderBy(order)
    return (
        rows.withColumn("__rn", F.row_number().over(inner))
        .join(offsets, [*keys, "__block"])
        .withColumn(out, (F.col("__rn") + F.col("__before")).cast("int"))
        .drop(*keys, "__block", "__rn", "__before")
    )


def carry_forward(
    df: DataFrame, group: Sequence[str], order: str, value: str, out: str, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Latest non-null ``value`` strictly before each row of its group.

    Equal to ``last(value, ignorenulls)`` over all preceding rows.
    """
    group = list(group)
    # Groups compare null-safe, as partitionBy does.
    keys = [f"__g{i}" for i in range(len(group))]
    rows = df.withColumns(
        {**{k: F.struct(F.col(g).alias("v")) for k, g in zip(keys, group)}, "__block": block_of(order, width)}
    )
    tails = rows.groupBy(*keys, "__block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.coalesce(F.col(order), F.lit(FIRST_BLOCK)))).alias("__tail")
    )
    past = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    entry = tails.select(*keys, "__block", F.last("__tail", ignorenulls=True).over(past).alias("__entry"))
    inner = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__near", F.last(value, ignorenulls=True).over(inner))
        .join(entry, [*keys, "__block"])
        .withColumn(out, F.coalesce("__near", "__entry"))
        .drop(*keys, "__block", "__near", "__entry")
    )


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, keys: str | Sequence[str], spread, salts: int = 16, how: str = "left"
) -> DataFrame:
    """Join to a one-row-per-key table when one key may own most rows.

    ``spread`` is an integer expression over ``rows``.  The lookup side is
    repeated once per salt, so a hot key lands on ``salts`` tasks.  Spark
    still turns it into a broadcast join when the lookup measures small.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    salted = lookup.withColumn(
        "__salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))
    )
    return (
        rows.withColumn("__salt", F.pmod(spread.cast("long"), F.lit(salts).cast("long")))
        .join(salted, [*keys, "__salt"], how)
        .drop("__salt")
    )


#: Keys that the sketch tracks, and how many of the most frequent are read from it.
TRACKED, HOT_KEYS = 8192, 256


def hot_keys(rows: DataFrame, key: str, parts: int) -> dict:
    """Keys with more than a ``parts``-th of the rows, and over how many tasks each has to go.

    One pass with Spark's mergeable sketch of frequent items, which finds every key of
    more than a ``TRACKED``-th of the rows; the driver gets ``HOT_KEYS`` counts at most.
    Counts are upper bounds, so a key is split too finely rather than too coarsely.
    ``parts`` is at most ``HOT_KEYS``, as no more keys than that can have such a share.
    """
    parts = min(parts, HOT_KEYS)
    seen = rows.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).head()
    return {r["item"]: -(-r["count"] * parts // seen["n"]) for r in seen["top"] or [] if r["count"] * parts > seen["n"]}


def balanced_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread, hot: dict, how: str = "left") -> DataFrame:
    """Join to a one-row-per-key table, the rows of every key in ``hot`` dealt over as many tasks as it says.

    ``spread`` is an integer expression over ``rows``.  Only the lookup rows of hot keys
    are copied; all others stay single.
    """
    width = F.lit(1)
    if hot:
        kind = dict(rows.dtypes)[key]
        widths = F.create_map(*[F.lit(v).cast(kind) if i % 2 == 0 else F.lit(v) for item in hot.items() for i, v in enumerate(item)])
        width = F.coalesce(F.try_element_at(widths, F.col(key)), F.lit(1))
    salt = F.pmod(spread.cast("long"), width.cast("long"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1)))
    return rows.withColumn("__salt", F.when(F.col(key).isNotNull(), F.coalesce(salt, F.lit(0)))).join(copies, [key, "__salt"], how).drop("__salt")
