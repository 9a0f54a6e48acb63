"""Title corrections: request batches, mapping, renaming, write-back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ILLEGAL_NAME_CHARS, drop_space, nonempty, parse_title, prefix_year, strip
from ..rules import CN_EXAM, RuleProfile
from ..sources.replies import read_replies
from .ordered import salted_lookup
from .output import unique_names

BATCH = 6


def request_batches(man: DataFrame, size: int = BATCH) -> DataFrame:
    """Titles packed in index order, ``size`` to a numbered request text."""
    return (
        man.withColumn("batch", F.floor((F.col("index") - 1) / F.lit(size)).cast("int"))
        .groupBy("book_id", "batch")
        .agg(F.array_sort(F.collect_list(F.struct("index", "name"))).alias("titles"))
        .select(
            "book_id",
            "batch",
            F.size("titles").alias("n_titles"),
            F.array_join(
                F.transform(
                    "titles", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["name"])
                ),
                "\n",
            ).alias("request"),
        )
    )


def correction_map(corrections: DataFrame) -> DataFrame:
    """One row per (book, original title); of duplicates the last wins."""
    return corrections.groupBy("book_id", "orig").agg(
        F.max_by(F.struct("fixed", "conf"), "seq").alias("c")
    )


def _mapped(man: DataFrame, corrections: DataFrame, rules: RuleProfile) -> DataFrame:
    """The manifest with the corrected title ``fixed`` and its ``conf`` on every row."""
    found = correction_map(corrections).withColumnRenamed("orig", "name").withColumn("hit", F.lit(True))
    return (
        salted_lookup(man, found, ["book_id", "name"], F.col("index"))
        .withColumn("fixed", prefix_year(F.coalesce("c.fixed", "name"), rules))
        .withColumn("conf", F.when(F.col("hit"), F.coalesce("c.conf", F.lit("?"))).otherwise("unchanged(missing)"))
        .drop("c", "hit")
    )


def preview(man: DataFrame, corrections: DataFrame, rules: RuleProfile = CN_EXAM) -> DataFrame:
    """(book_id, index, orig, fixed, conf) for every manifest row."""
    return _mapped(man, corrections, rules).select("book_id", "index", F.col("name").alias("orig"), "fixed", "conf")


def _legal(c: Column) -> Column:
    return strip(F.regexp_replace(c, ILLEGAL_NAME_CHARS, "_"))


def _renamed(man: DataFrame, corrections: DataFrame, rules: RuleProfile, mode: str) -> DataFrame:
    """``_mapped`` with the old title as ``orig`` and the new, unique one as ``name``."""
    rows = _mapped(man, corrections, rules).withColumn("orig", F.col("name"))
    rows = rows.withColumn("name", F.coalesce(nonempty(_legal(F.col("fixed"))), F.col("orig")))
    return unique_names(rows, "name", "index", mode)


def apply_to_manifest(
    man: DataFrame, corrections: DataFrame, rules: RuleProfile = CN_EXAM, mode: str = "simple"
) -> DataFrame:
    """T9 on the manifest; ``old_file`` keeps the name to rename from."""
    return (
        _renamed(man, corrections, rules, mode)
        .withColumn("p", parse_title(F.col("name")))
        .select(
            "book_id",
            "index",
            "name",
            F.concat("name", F.lit(".pdf")).alias("file"),
            F.col("file").alias("old_file"),
            "src_start",
            "src_end",
            "pdf_pages",
            "p.school",
            "p.branch",
            "p.year",
        )
    )


def write_back(
    exam: DataFrame,
    man: DataFrame,
    corrections: DataFrame,
    rules: RuleProfile = CN_EXAM,
    mode: str = "simple",
) -> DataFrame:
    """New titles and attributes for the documents.

    ``man`` is the manifest before it is renamed.  A book with as many documents
    as manifest rows is matched by index.  Any other book is matched by title, all
    blanks removed, among the titles of its manifest: a corrected or merely
    normalised title is taken over, a correction of a title that the manifest
    does not hold is not.
    """
    renamed = _renamed(man, corrections, rules, mode)
    sizes = exam.select("book_id", F.lit(1).alias("n")).unionAll(man.select("book_id", F.lit(-1).alias("n")))
    aligned = (
        sizes.groupBy("book_id").agg(F.sum("n").alias("n")).filter("n = 0").select("book_id", F.lit(True).alias("aligned"))
    )
    by_index = renamed.select("book_id", F.col("index").alias("idx"), F.col("name").alias("by_index"))
    # Equal titles of a book have equal corrections.
    by_title = renamed.groupBy("book_id", F.col("orig").alias("bare")).agg(F.first("fixed").alias("by_title"))
    new = F.when(F.col("aligned"), F.col("by_index")).otherwise(_legal(F.coalesce("by_title", "bare")))
    keep = [c for c in exam.columns if c not in ("title", "school", "branch", "year")]
    rows = exam.withColumn("bare", drop_space(F.coalesce("title", F.lit(""))))
    rows = salted_lookup(rows, aligned, "book_id", F.col("idx")).join(by_index, ["book_id", "idx"], "left")
    return (
        salted_lookup(rows, by_title, ["book_id", "bare"], F.col("idx"))
        .withColumn("title", new)
        .withColumn("p", parse_title(F.col("title")))
        .select(*keep, "title", "p.school", "p.branch", "p.year")
    )


@dataclass(frozen=True)
class Corrected:
    preview: DataFrame
    manifest: DataFrame
    exam: DataFrame


def correct_titles(
    replies: DataFrame, man: DataFrame, exam: DataFrame, rules: RuleProfile = CN_EXAM, mode: str = "simple"
) -> Corrected:
    """T9 in one call: reply texts (book_id, batch, content, reasoning) to preview, manifest and documents.

    Of several corrections of a title the last in order of batch and position
    counts.  Nothing runs until a table is used, so reading ``preview`` alone
    applies nothing; ``sources.replies.unreadable_replies`` lists what had no answer.
    """
    found = read_replies(replies).withColumn("seq", F.struct("batch", "pos"))
    return Corrected(
        preview(man, found, rules), apply_to_manifest(man, found, rules, mode), write_back(exam, man, found, rules, mode)
    )
