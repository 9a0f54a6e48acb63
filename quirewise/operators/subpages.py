"""From page text to subpages: one row per column with its header and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_once
from ..rules import CN_EXAM, RuleProfile
from .headers import HEADER, HEADERS, settle_subject, titles_alone, with_column_headers
from .layout import columns_per_layout
from .ordered import salted_lookup


def nest_strips(strip: DataFrame, page_full: DataFrame | None = None) -> DataFrame:
    """Column rows to page rows (book_id, page, cols, full).

    A page has at most a handful of columns, so the list is bounded.
    """
    pages = strip.groupBy("book_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cols")
    )
    if page_full is None:
        return pages.withColumn("full", F.lit(""))
    full = page_full.select("book_id", "page", F.col("text").alias("full"))
    return pages.join(full, ["book_id", "page"], "full_outer").select(
        "book_id",
        "page",
        F.coalesce("cols", F.array().cast("array<string>")).alias("cols"),
        F.coalesce("full", F.lit("")).alias("full"),
    )


def page_texts(page_strip: DataFrame) -> DataFrame:
    """All texts of a page, columns first and the full text last."""
    return page_strip.select(
        "book_id", "page", F.posexplode(F.array_append("cols", F.col("full"))).alias("seq", "text")
    )


def _subject_hits(texts: Column, rules: RuleProfile) -> Column:
    """(subject, text number, word number) for every subject a text holds."""
    words = T.constant([(w,) for w in rules.subjects], "subject")

    def in_text(t: Column, seq: Column) -> Column:
        numbered = F.transform(
            words, lambda w, i: F.struct(w["subject"].alias("subject"), seq.alias("seq"), i.alias("word_no"))
        )
        return F.filter(numbered, lambda w: F.contains(t, w["subject"]))

    return F.flatten(F.transform(texts, in_text))


def detect_headers(page_strip: DataFrame, rules: RuleProfile = CN_EXAM) -> DataFrame:
    """The one pass over the texts: headers, answer marks and subject words.

    One small row per page and no shuffle: whatever needs other tables (layout,
    subjects, overrides) is joined to these rows, never to the texts.  ``alone``
    is, for a column that shows a header, the title the relaxed rules read from
    it by itself (T8 asks for it).
    """
    full = F.coalesce("full", F.lit(""))
    cols = F.transform(F.col("cols"), lambda t: F.coalesce(t, F.lit("")))
    pages = page_strip.select("book_id", "page", cols.alias("cols"), full.alias("full"))
    pages = with_column_headers(pages, rules)
    return pages.select(
        "book_id",
        "page",
        F.transform("headers", lambda h: F.struct(h["strict"].alias("strict"), h["loose"].alias("loose"))).alias("found"),
        titles_alone("headers", rules).alias("alone"),
        # The mark may run over the seam between the two texts.
        F.transform(
            "cols", lambda t: T.has_answer_mark(F.concat(t, F.lit("\n"), F.col("full")), rules)
        ).alias("answers"),
        T.has_answer_mark(F.col("full"), rules).alias("full_answer"),
        _subject_hits(F.array_append("cols", F.col("full")), rules).alias("hits"),
    )


def subjects_of(detected: DataFrame) -> DataFrame:
    """The subject met in most texts of a book.

    A tie goes to the subject met first in (page, text, list) order.  Counts
    are combined before the shuffle, so a huge book costs one row per task.
    """
    hits = explode_once(detected, ["book_id", "page"], F.col("hits"), "n_hit", "s")
    counts = hits.groupBy("book_id", F.col("s.subject").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("page", "s.seq", "s.word_no")).alias("first"),
    )
    rank = F.struct(
        F.col("n"), -F.col("first.page"), -F.col("first.seq"), -F.col("first.word_no")
    )
    return counts.groupBy("book_id").agg(F.max_by("subject", rank).alias("subject"))


def book_subjects(page_strip: DataFrame, rules: RuleProfile = CN_EXAM) -> DataFrame:
    """A6 straight from the texts, for use without header detection."""
    texts = F.array_append("cols", F.coalesce("full", F.lit("")))
    return subjects_of(page_strip.select("book_id", "page", _subject_hits(texts, rules).alias("hits")))


def with_layout(detected: DataFrame, layout: DataFrame) -> DataFrame:
    """Findings cut or padded to the number of columns of the page's layout."""
    lay = layout.select("book_id", "page", "layout")
    empty = F.struct(F.array().cast(HEADERS).alias("strict"), F.lit(None).cast(HEADER).alias("loose"))
    index = F.sequence(F.lit(0), columns_per_layout(F.col("layout")) - 1)
    return (
        detected.join(lay, ["book_id", "page"], "left")
        .withColumn("layout", F.coalesce("layout", F.lit("2-up")))
        .withColumn("found", F.transform(index, lambda c: F.coalesce(F.get("found", c), empty)))
        .withColumn(
            "answers", F.transform(index, lambda c: F.coalesce(F.get("answers", c), F.col("full_answer")))
        )
    )


def _carry_year(found: Column) -> Column:
    """W10 + W8: first header per column; a missing year comes from the left.

    At most three columns, folded left to right inside the row.
    """
    state = f"struct<out:{HEADERS},year:string>"
    zero = F.struct(
        F.array().cast(HEADERS).alias("out"), F.lit(None).cast("string").alias("year")
    ).cast(state)

    def step(acc: Column, c: Column) -> Column:
        h = F.coalesce(F.get(c["strict"], F.lit(0)), c["loose"])

        def put(h: Column) -> Column:
            dated = F.when(
                h.isNotNull(),
                F.struct(
                    h["school"].alias("school"),
                    h["branch"].alias("branch"),
                    F.coalesce(h["year"], acc["year"]).alias("year"),
                    h["title"].alias("title"),
                    h["volume"].alias("volume"),
                ),
            ).cast(HEADER)
            return F.struct(
                F.array_append(acc["out"], dated).alias("out"),
                F.coalesce(h["year"], acc["year"]).alias("year"),
            ).cast(state)

        return T.bind(h, put)

    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def identity(h: Column) -> Column:
    """What makes two headers the same document: volumes go by title alone."""
    return F.when(
        h["volume"],
        F.struct(
            F.lit("__volume__").alias("school"),
            F.lit(None).cast("string").alias("branch"),
            F.lit(None).cast("string").alias("year"),
            h["title"].alias("title"),
        ),
    ).otherwise(
        F.struct(
            h["school"].alias("school"),
            h["branch"].alias("branch"),
            h["year"].alias("year"),
            h["title"].alias("title"),
        )
    )


def _settled(heads: Column, rules: RuleProfile) -> Column:
    return F.transform(
        heads,
        lambda h: F.when(
            h.isNotNull(), h.withField("title", settle_subject(h["title"], F.col("subject"), rules))
        ),
    )


def page_flags(
    detected: DataFrame,
    layout: DataFrame,
    subjects: DataFrame | None = None,
    rules: RuleProfile = CN_EXAM,
) -> DataFrame:
    """Distinct headers, contents page, answer page."""
    pages = with_layout(detected, layout)
    if subjects is None:
        pages = pages.withColumn("subject", F.lit(None).cast("string"))
    else:
        pages = salted_lookup(pages, subjects, "book_id", F.col("page"))
    with_heads = pages.withColumn("heads", _carry_year(F.col("found"))).withColumn(
        "heads", _settled(F.col("heads"), rules)
    )
    strict = F.flatten(F.transform("found", lambda c: c["strict"]))
    seen = F.transform(
        F.filter(F.concat(strict, F.col("heads")), lambda h: h.isNotNull()), identity
    )
    return (
        with_heads.withColumn("n_keys", F.size(F.array_distinct(seen)))
        .withColumn("is_toc", (F.col("layout") == "1-up") & (F.col("n_keys") > rules.toc_keys))
        .withColumn("is_answer", F.exists("answers", lambda a: a))
        .drop("found", "alone", "hits", "full_answer", "subject")
    )


def build_subpages(
    page_strip: DataFrame,
    layout: DataFrame,
    overrides: DataFrame | None = None,
    subjects: DataFrame | None = None,
    rules: RuleProfile = CN_EXAM,
) -> DataFrame:
    """T5: subpage rows (book_id, page, col, key, is_answer, is_toc)."""
    return subpages_of(detect_headers(page_strip, rules), layout, overrides, subjects, rules)


def subpages_of(
    detected: DataFrame,
    layout: DataFrame,
    overrides: DataFrame | None = None,
    subjects: DataFrame | None = None,
    rules: RuleProfile = CN_EXAM,
) -> DataFrame:
    """T5 from the findings of ``detect_headers``."""
    pages = page_flags(detected, layout, subjects, rules)
    rows = pages.select(
        "book_id",
        "page",
        "n_keys",
        "is_toc",
        F.col("is_answer").alias("page_answer"),
        "heads",
        "answers",
        # By index: exploding the headers themselves would compute them twice.
        F.explode(F.sequence(F.lit(0), columns_per_layout(F.col("layout")) - 1)).alias("col"),
    )
    if rules.answer_scope == "column":
        answer = F.get("answers", F.col("col"))
    else:
        answer = F.col("page_answer")
    sub = rows.select(
        "book_id", "page", "col", F.get("heads", F.col("col")).alias("key"), answer.alias("is_answer"), "is_toc"
    )
    return sub if overrides is None else apply_title_overrides(sub, overrides, rules)


def apply_title_overrides(
    subpages: DataFrame, overrides: DataFrame, rules: RuleProfile = CN_EXAM
) -> DataFrame:
    """Every column of an overridden page takes the override and opens."""
    ov = overrides.select(
        "book_id",
        "page",
        F.struct(
            F.col("school"),
            F.col("branch"),
            F.col("year"),
            F.coalesce(
                F.col("title"), override_title(F.col("school"), F.col("branch"), F.col("year"), rules)
            ).alias("title"),
            F.lit(False).alias("volume"),
        )
        .cast(HEADER)
        .alias("override"),
        (F.col("seq") if "seq" in overrides.columns else F.lit(0)).alias("seq"),
    )
    # The last of several overrides of a page wins, as with layouts.
    ov = ov.groupBy("book_id", "page").agg(F.max_by("override", F.struct("seq", "override")).alias("override"))
    forced = F.col("override").isNotNull()
    return (
        subpages.join(ov, ["book_id", "page"], "left")
        .withColumn("key", F.coalesce("override", "key"))
        .withColumn("is_answer", F.col("is_answer") & ~forced)
        .withColumn("is_toc", F.col("is_toc") & ~forced)
        .drop("override")
    )


def override_title(school: Column, branch: Column, year: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """Title of an override given without one."""
    return F.concat(
        school,
        F.coalesce(F.concat(F.lit("("), T.nonempty(branch), F.lit(")")), F.lit("")),
        F.coalesce(
            F.concat(F.lit("初"), T.nonempty(year), F.lit(f"级新初一分班真卷{rules.override_subject}")),
            F.lit(""),
        ),
    )
