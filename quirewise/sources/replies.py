"""Correction tables inside free reply texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import bind, strip

ROW = "orig string, fixed string, conf string"


def unfence(c: Column) -> Column:
    """Drop a code fence around the text."""
    opened = F.regexp_replace(strip(c), "^```(?:[^\n]*\n)?", "")
    return F.when(strip(c).startswith("```"), strip(F.regexp_replace(opened, "```$", ""))).otherwise(strip(c))


#: Strings, brackets, and runs of anything else, after the first opening bracket.
_TOKENS = r'(?s)"(?:[^"\\]|\\.)*"|[\[\]]|[^"\[\]]+|"'
STATE = "struct<depth:int,at:int,end:int>"


def balanced_array(c: Column) -> Column:
    """From the first opening bracket to the one that closes it; brackets inside strings are text.  Null without one.

    One fold over the tokens that carries three numbers, so it stays inside Spark's
    generated code and costs the same whatever the list holds.
    """
    tokens = F.regexp_extract_all(F.substring(c, F.greatest(F.instr(c, "["), F.lit(1)), F.length(c)), F.lit(_TOKENS), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "[", 1).when(token == "]", -1).otherwise(0)
        at = s["at"] + 1
        done = (s["end"] == 0) & (token == "]") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(done, at).otherwise(s["end"]).alias("end")).cast(STATE)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")).cast(STATE)
    return bind(
        tokens,
        lambda t: bind(F.aggregate(t, start, step)["end"], lambda n: F.when(n > 0, F.array_join(F.slice(t, F.lit(1), n), ""))),
    )


def first_array(c: Column) -> Column:
    """The first JSON array of a text as rows, with what was not readable in them; null when there is none.

    A text that is an array is taken whole, else the first balanced array in it.
    """
    return bind(
        unfence(c),
        lambda s: F.coalesce(F.when(s.startswith("["), _rows(s)), F.when(s.contains("["), bind(balanced_array(s), _rows))),
    )


def _rows(c: Column) -> Column:
    """The entries of an array; null if it is none or can't be read."""
    items = F.from_json(c, "array<string>")
    return F.transform(
        items,
        lambda item: bind(
            F.when(item.startswith("{"), F.from_json(item, ROW)),
            lambda r: F.struct(r["orig"].alias("orig"), r["fixed"].alias("fixed"), r["conf"].alias("conf"), item.alias("item")),
        ),
    )


def _entries(replies: DataFrame) -> DataFrame:
    """All entries in order; the second text is the fallback where the first has no array."""
    rows = F.coalesce(first_array(F.col("content")), first_array(F.col("reasoning")))
    keep = [c for c in replies.columns if c not in ("content", "reasoning")]
    return explode_once(replies, keep, rows, "pos", "r").select(*keep, "pos", "r.orig", "r.fixed", "r.conf", "r.item")


def read_replies(replies: DataFrame) -> DataFrame:
    """(batch, content, reasoning) to correction rows; ``pos`` is the place in the array."""
    return _entries(replies).filter(F.col("orig").isNotNull()).drop("item")


def rejected_entries(replies: DataFrame) -> DataFrame:
    """The entries that name no title, with their text (null for a null entry): what ``read_replies`` has no row for."""
    rows = _entries(replies).filter(F.col("orig").isNull())
    return rows.drop("orig", "fixed", "conf")


def unreadable_replies(replies: DataFrame) -> DataFrame:
    """The replies in which neither text holds an array."""
    rows = F.coalesce(first_array(F.col("content")), first_array(F.col("reasoning")))
    return replies.filter(rows.isNull())
