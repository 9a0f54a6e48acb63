"""Quality rules as a ledger: every rule is evaluated once and leaves one bit.

``ledger`` stores measurements and failure bits; a policy is a named, versioned
mask over the bits, applied later without touching a text again; ablations are
bitwise aggregates over the stored bits.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import SPACES, let

#: Symbols that count, words of a repetition window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit never changes its meaning."""

    bit: int
    name: str
    fails: Callable[[], Column]


def _per_word(column: str) -> Column:
    return F.col(column) / F.greatest(F.col("n_words"), F.lit(1))


#: Bits are append-only: a changed threshold gets a new bit and a new policy.
RULES = (
    Rule(0, "too_few_words", lambda: F.col("n_words") < 20),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule(2, "symbol_rich", lambda: _per_word("n_symbols") > 0.3),
    Rule(3, "words_too_short", lambda: _per_word("word_chars") < 2),
    Rule(4, "words_too_long", lambda: _per_word("word_chars") > 25),
    Rule(5, "duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.greatest(F.col("n_lines"), F.lit(1))),
    Rule(6, "no_letters", lambda: 100 * F.col("n_alpha") < 30 * F.col("word_chars")),
    Rule(7, "symbol_some", lambda: _per_word("n_symbols") > 0.1),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "web-1": ("too_few_words", "repeated_windows", "symbol_rich", "words_too_short", "words_too_long", "duplicate_lines", "no_letters"),
    "strict-1": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the same array of words.

    Windows are compared by a 64-bit hash over the hashes of their words.  Most
    texts repeat none, which one hash set tells; the others sort their windows
    and sum the union of the repeated ones, so the work is n log n at any length.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda e, k: F.when(
                    (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]
                ),
            )
            starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                starts,
                start,
                lambda a, i: F.struct(
                    (a["n"] + (i + window) - F.greatest(a["end"], i)).cast("long").alias("n"),
                    (i + window).cast("int").alias("end"),
                ),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(pairs, twice)
        )

    def windows(ids: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ids) - (window - 1))
        return F.when(F.size(ids) < window, F.lit(0).cast("long")).otherwise(
            let(F.transform(starts, lambda i: F.xxhash64(F.slice(ids, i, window))), covered)
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document with what the rules look at; with ``carry`` also the whole row as struct ``_row``.

    A null text has no words, lines or characters (all measurements 0); rows
    with equal ids stay separate rows; other columns of ``docs`` are not read.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *row)
    words = F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda s: F.length(F.btrim(s, F.lit(SPACES))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))

    def of_lines(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))

    packed = F.translate("_text", SPACES, "")
    measured = F.struct(
        let(words, of_words).alias("_w"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(packed, "[^\\p{L}]+", "")).cast("long").alias("n_alpha"),
        let(lines, of_lines).alias("_l"),
    )
    # A generator of one row: no later filter or projection can make Spark measure a text twice.
    rows = base.select("doc_id", *(["_row"] if carry else []), F.inline(F.array(measured)))
    fields = ("_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_alpha")
    return rows.select("doc_id", *fields, *(["_row"] if carry else []))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements and ``failed_bits``: bit b is set where rule b fails."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, id_col, text_col, carry).withColumn("failed_bits", bits)


def kept_documents(docs: DataFrame, policy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns; no join, no shuffle."""
    return apply_policy(ledger(docs, id_col, text_col, carry=True), policy).filter("kept").select("_row.*")


def apply_policy(table: DataFrame, policy: str) -> DataFrame:
    """Adds ``policy`` and ``kept`` to a ledger; reads the bits only."""
    return table.withColumns({"policy": F.lit(policy), "kept": F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0})


def ablations(table: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted per bit pattern (at most 2^rules rows), so the
    rest runs over that small table.  An empty ledger gives zeros.
    """
    mask = mask_of(policy)
    patterns = table.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = set(POLICIES[policy])
    rules = [r for r in RULES if r.name in names]
    sums = []
    for r in rules:
        bit = 1 << r.bit
        for kind, hit in (
            ("failing", F.col("bits").bitwiseAND(F.lit(bit)) != 0),
            ("only", F.col("bits") == bit),
            ("without", F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0),
        ):
            sums.append(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias(f"{kind}_{r.bit}"))
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col(f"failing_{r.bit}").alias("n_failing"),
            F.col(f"only_{r.bit}").alias("n_only_this"),
            F.col(f"without_{r.bit}").alias("n_kept_without"),
        )
        for r in rules
    ]
    return patterns.agg(*sums).select(F.inline(F.array(*rows)))
