"""Cutting the ordered columns of a book into documents.

State machine per book in (page, col) order: a closed column (contents or
answer page) ends the open document, a column with a new header starts one, a
column without a header continues the open one, and columns before any header
belong to nothing.

The scan is written as block-local windows plus one summary row per block of
pages (see ``ordered``): a book of any size is spread over its blocks, the row
data is shuffled once, and only summaries are combined per book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import CN_EXAM, RuleProfile
from .headers import settle_subject
from .ordered import BLOCK_WIDTH, block_of, salted_lookup
from .subpages import identity

# Segments per row in the nested form; one document is as many rows as it needs.
PART_SIZE = 4096


def _differs(a: Column, b: Column) -> Column:
    return ~identity(a["key"]).eqNullSafe(identity(b["key"]))


def segment_columns(subpages: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """(book_id, idx, seq, page, col, key, starts) for the kept columns.

    ``idx`` numbers the documents of a book from 1, ``seq`` the columns of a
    document from 1.
    """
    closed = F.col("is_toc") | F.col("is_answer")
    signal = F.when(
        closed | F.col("key").isNotNull(), F.struct(closed.alias("closed"), F.col("key").alias("key"))
    )
    # The filter says what the join below would infer anyway.  Said here, both
    # uses of the rows get the same plan and share one exchange.
    # The book stands in a struct, which compares null-safe: pages without a book are one.
    rows = subpages.select(
        F.struct(F.col("book_id").alias("v")).alias("book_id"),
        "page", "col", signal.alias("signal"), block_of("page", width).alias("block"),
    ).filter("book_id IS NOT NULL AND block IS NOT NULL")
    ordered = Window.partitionBy("book_id", "block").orderBy("page", "col")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    sig, prev = F.col("signal"), F.col("prev")
    opens = sig.isNotNull() & ~sig["closed"]
    # What depends on the block's past only is left open here: the columns
    # before its first signal, and whether that signal starts a document.
    local = (
        rows.withColumn("prev", F.last("signal", ignorenulls=True).over(before))
        .withColumns(
            {
                "state": F.coalesce(sig, prev),
                "first_open": F.coalesce(opens & prev.isNull(), F.lit(False)),
                "starts_in": F.coalesce(
                    opens & prev.isNotNull() & (prev["closed"] | _differs(prev, sig)), F.lit(False)
                ),
            }
        )
        .withColumns(
            {
                "kept_in": F.coalesce(~F.col("state")["closed"], F.lit(False)),
                "in_head": F.col("state").isNull(),
            }
        )
        .withColumns(
            {
                "n_starts": F.count_if(F.col("starts_in")).over(so_far),
                "n_kept": F.count_if(F.col("kept_in")).over(so_far),
                "n_head": F.count_if(F.col("in_head")).over(so_far),
            }
        )
    )
    place = F.struct("page", "col")
    blocks = local.groupBy("book_id", "block").agg(
        F.min_by("signal", F.when(sig.isNotNull(), place)).alias("first_signal"),
        F.max_by("signal", F.when(sig.isNotNull(), place)).alias("last_signal"),
        F.max("n_head").alias("head"),
        F.max("n_kept").alias("kept"),
        F.max("n_starts").alias("starts"),
        # Kept columns up to the last start inside the block.
        F.max(F.when(F.col("starts_in"), F.col("n_kept"))).alias("last_start"),
    )
    book = Window.partitionBy("book_id").orderBy("block")
    past = book.rowsBetween(Window.unboundedPreceding, -1)
    first, carry = F.col("first_signal"), F.col("carry")
    carried_open = F.coalesce(~carry["closed"], F.lit(False))
    opened_at = F.coalesce(F.col("last_start"), F.when(F.col("first_starts"), F.lit(1)))
    entry = (
        blocks.withColumn("carry", F.last("last_signal", ignorenulls=True).over(past))
        .withColumns(
            {
                "enters": carried_open,
                "first_starts": F.coalesce(~first["closed"], F.lit(False))
                & (~carried_open | _differs(carry, first)),
                "head_kept": F.when(carried_open, F.col("head")).otherwise(F.lit(0)),
            }
        )
        .withColumns(
            {
                "all_kept": F.col("head_kept") + F.col("kept"),
                "all_starts": F.col("starts") + F.col("first_starts").cast("long"),
            }
        )
        .withColumns(
            {
                "kept_before": F.coalesce(F.sum("all_kept").over(past), F.lit(0)),
                "starts_before": F.coalesce(F.sum("all_starts").over(past), F.lit(0)),
            }
        )
        # Book-wide rank of the kept column that opened the latest document.
        .withColumn("opened_at", F.col("kept_before") + F.col("head_kept") + opened_at)
        .select(
            "book_id",
            "block",
            "enters",
            "first_starts",
            "head_kept",
            "kept_before",
            "starts_before",
            F.last("opened_at", ignorenulls=True).over(past).alias("opened_before"),
        )
    )
    in_head = F.col("in_head")
    opened_here = F.last(F.when(F.col("starts"), F.col("rank")), ignorenulls=True).over(so_far)
    joined = (
        local.join(entry, ["book_id", "block"])
        .withColumns(
            {
                "kept_row": F.when(in_head, F.col("enters")).otherwise(F.col("kept_in")),
                "starts": F.col("starts_in") | (F.col("first_open") & F.col("first_starts")),
                "idx": F.col("starts_before")
                + F.col("n_starts")
                + (~in_head & F.col("first_starts")).cast("long"),
                "rank": F.col("kept_before")
                + F.when(in_head, F.col("n_head")).otherwise(F.col("head_kept") + F.col("n_kept")),
            }
        )
        .withColumn("opened", F.coalesce(opened_here, F.col("opened_before")))
    )
    return joined.filter("kept_row").select(
        F.col("book_id.v").alias("book_id"),
        F.col("idx").cast("int").alias("idx"),
        (F.col("rank") - F.col("opened") + 1).cast("int").alias("seq"),
        "page",
        "col",
        F.col("signal")["key"].alias("key"),
        "starts",
    )


def roll_up(segments: DataFrame) -> DataFrame:
    """A10: one row per document, attributes from the column that opened it."""
    exam = segments.groupBy("book_id", "idx").agg(
        F.min("page").alias("start"),
        F.max("page").alias("end"),
        F.count(F.lit(1)).cast("int").alias("n_columns"),
        F.max_by("key", F.when(F.col("starts"), F.lit(1))).alias("key"),
    )
    return exam.select(
        "book_id",
        "idx",
        "start",
        "end",
        F.col("key.school").alias("school"),
        F.col("key.branch").alias("branch"),
        F.col("key.year").alias("year"),
        F.col("key.title").alias("title"),
        F.when(F.col("key.volume"), F.col("key.year")).alias("volume"),
        "n_columns",
    )


def segment(subpages: DataFrame, width: int = BLOCK_WIDTH) -> tuple[DataFrame, DataFrame]:
    """(exam, exam_segment)."""
    segments = segment_columns(subpages, width)
    return roll_up(segments), segments.select("book_id", "idx", "seq", "page", "col")


def nested_segments(segments: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """The list form, in parts of ``part_size`` columns so no row grows without bound."""
    return (
        segments.withColumn("part", F.floor((F.col("seq") - 1) / F.lit(part_size)).cast("int"))
        .groupBy("book_id", "idx", "part")
        .agg(F.array_sort(F.collect_list(F.struct("page", "col"))).alias("segments"))
    )


def interior(segments: DataFrame, exam: DataFrame, longer_than: int) -> DataFrame:
    """Columns strictly inside documents of more than ``longer_than`` columns."""
    sizes = exam.filter(F.col("n_columns") > longer_than).select("book_id", "idx", "n_columns")
    return salted_lookup(segments, sizes, ["book_id", "idx"], F.col("seq"), how="inner").filter(
        (F.col("seq") > 1) & (F.col("seq") < F.col("n_columns"))
    )


def verify_long(
    exam: DataFrame,
    segments: DataFrame,
    detected: DataFrame,
    subjects: DataFrame | None = None,
    rules: RuleProfile = CN_EXAM,
) -> tuple[DataFrame, DataFrame]:
    """(verdict per long document, hidden headers inside).

    What the relaxed rules alone read from interior columns is among the findings
    of ``detect_headers``, so no text is read or moved.  Only a column that has a
    key (repeated or overridden) can show a header: those few rows look it up.
    """
    keyed = interior(segments.filter("key IS NOT NULL"), exam, rules.long_exam_pages)
    inside = keyed.select("book_id", "idx", "page", "col").join(
        detected.select("book_id", "page", "alone"), ["book_id", "page"]
    )
    hidden = inside.select("book_id", "idx", "page", "col", F.get("alone", F.col("col")).alias("hidden_title"))
    hidden = hidden.filter("hidden_title IS NOT NULL")
    if subjects is None:
        hidden = hidden.withColumn("subject", F.lit(None).cast("string"))
    else:
        hidden = salted_lookup(hidden, subjects, "book_id", F.col("page"))
    hidden = hidden.withColumn(
        "hidden_title", settle_subject(F.col("hidden_title"), F.col("subject"), rules)
    ).drop("subject")
    counts = hidden.groupBy("book_id", "idx").agg(F.count(F.lit(1)).alias("n_hidden"))
    verdict = (
        exam.filter(F.col("n_columns") > rules.long_exam_pages)
        .join(counts, ["book_id", "idx"], "left")
        .select(
            "book_id",
            "idx",
            "title",
            "start",
            "end",
            "n_columns",
            F.coalesce("n_hidden", F.lit(0)).cast("int").alias("n_hidden"),
            F.when(F.col("n_hidden").isNull(), "verified").otherwise("hidden").alias("verdict"),
        )
    )
    return verdict, hidden
