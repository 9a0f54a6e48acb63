"""Header detection on the text of one column: strict, relaxed, volume."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import bind
from ..rules import (
    CN_EXAM,
    FULL_MARKS,
    QUESTION_LINE,
    TIME_LIMIT,
    VOLUME_MARK,
    VOLUME_NAME,
    WS_SET,
    RuleProfile,
    any_of,
)

HEADER = "struct<school:string,branch:string,year:string,title:string,volume:boolean>"
HEADERS = f"array<{HEADER}>"
# Cheap necessary conditions, tried before anything is normalised.
FOUR_DIGITS = "^(?:[^0-9０-９]*+[0-9０-９]){4}"
RELAXED_HINTS = T.SCHOOL_HINTS + "届级班卷初"
NONE = lambda: F.lit(None).cast(HEADER)


def _header(school, branch, year, title, volume=False) -> Column:
    return F.struct(
        school.alias("school"),
        branch.alias("branch"),
        year.alias("year"),
        title.alias("title"),
        F.lit(volume).alias("volume"),
    ).cast(HEADER)


# --- strict -----------------------------------------------------------------


def _strict_title(n: Column, rules: RuleProfile) -> Column:
    from_school = F.regexp_extract(n, "(?s)" + T.SCHOOL + ".*", 0)
    cut = F.regexp_replace(
        T.normalize_title(from_school, rules),
        f"(?<![{WS_SET}。，；:])[{WS_SET}。，；:]++$",
        "",
    )
    return T.clean_title(cut, rules)


def strict_header(line: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """H1 on one (possibly merged) line: year, subtitle and school all present.

    The tests run from cheap to dear; each stops the rest.
    """

    def on_school(n: Column, y: Column) -> Column:
        return bind(
            T.school_in_normalized(n, rules),
            lambda so: F.when(
                so.isNotNull(), _header(so["school"], so["branch"], y, _strict_title(n, rules))
            ),
        )

    def on_normalized(n: Column) -> Column:
        return F.when(
            (F.length(n) >= 6) & T.has_subtitle(n, rules),
            bind(T.year_from_line(n, rules), lambda y: F.when(y.isNotNull(), on_school(n, y))),
        )

    return F.when(
        line.rlike(FOUR_DIGITS) & T.may_hold_school(line),
        bind(T.normalize_title(line, rules), on_normalized),
    )


def strict_headers(text: Column, rules: RuleProfile = CN_EXAM, all_lines: Column | None = None) -> Column:
    """H1 + W6 + U2: distinct header candidates of a text, in order.

    ``all_lines`` are the lines of the text where the caller has them already; they
    may be null for a text without any of ``RELAXED_HINTS``.

    Only lines with a school character or a subtitle word can start, extend or
    complete a header; the fold runs over those.  Each gets three tries, in
    order: extend the held header, stand alone, form a pair with the next
    line.  ``held`` is the header still open to follow-on lines, ``taken`` its
    text so far and ``used`` the last line that went into one.
    """
    state = f"struct<found:{HEADERS},held:{HEADER},taken:string,used:int>"
    empty = F.array().cast(HEADERS)
    zero = F.struct(
        empty.alias("found"),
        NONE().alias("held"),
        F.lit(None).cast("string").alias("taken"),
        F.lit(-1).alias("used"),
    ).cast(state)

    def short(x: Column) -> Column:
        return F.coalesce(T.is_short_subtitle(x, rules=rules), F.lit(False))

    def relevant(ls: Column) -> Column:
        told = any_of((*T.SCHOOL_HINTS, *rules.subtitle_hints))
        found = F.filter(
            F.transform(ls, lambda x, i: F.struct(x.alias("t"), i.alias("i"))),
            lambda x: x["t"].rlike(told),
        )

        def flags(x: Column) -> Column:
            nxt = F.get(ls, x["i"] + 1)
            return F.struct(
                x["i"].alias("i"),
                x["t"].alias("t"),
                nxt.alias("next"),
                short(x["t"]).alias("short"),
                short(nxt).alias("next_short"),
                F.when(
                    short(x["t"]) | short(nxt), T.school_in_line(x["t"], rules).isNotNull()
                ).alias("school"),
            )

        return F.transform(found, flags)

    def step(acc: Column, m: Column, rel: Column) -> Column:
        def tried(x: Column, turn: Column) -> Column:
            holding = acc["held"].isNotNull()
            fresh = x["i"] > acc["used"]
            extends = holding & (x["i"] == acc["used"] + 1) & x["short"] & ~x["school"]
            trial = F.when(
                fresh,
                F.when((turn == 0) & extends, F.concat(acc["taken"], x["t"]))
                .when((turn == 1) & ~holding, x["t"])
                .when((turn == 2) & ~holding & x["next_short"] & x["school"], F.concat(x["t"], x["next"])),
            )

            def settle(h: Column) -> Column:
                last = F.when(turn == 2, x["i"] + 1).otherwise(x["i"])
                return (
                    F.when(h.isNotNull(), _state(acc["found"], h, trial, last))
                    .when(
                        fresh & (turn == 0) & holding,
                        _state(F.array_append(acc["found"], acc["held"]), NONE(), F.lit(None), acc["used"]),
                    )
                    .otherwise(acc)
                )

            return bind(trial, lambda t: bind(strict_header(t, rules), settle))

        return bind(F.get(rel, F.floor(m / 3).cast("int")), lambda x: tried(x, m % 3))

    def _state(found, held, taken, used) -> Column:
        return F.struct(
            found.alias("found"), held.alias("held"), taken.alias("taken"), used.alias("used")
        ).cast(state)

    def finish(acc: Column) -> Column:
        return F.array_distinct(
            F.when(acc["held"].isNotNull(), F.array_append(acc["found"], acc["held"])).otherwise(
                acc["found"]
            )
        )

    def fold(rel: Column) -> Column:
        turns = F.sequence(F.lit(0), F.size(rel) * 3 - 1)
        return F.when(
            F.size(rel) > 0, F.aggregate(turns, zero, lambda acc, m: step(acc, m, rel), finish)
        ).otherwise(empty)

    long_lines = T.of_length(T.lines(text) if all_lines is None else all_lines, 4)
    return F.when(
        T.holds_any(text, T.SCHOOL_HINTS) & text.rlike(FOUR_DIGITS),
        bind(long_lines, lambda ls: bind(relevant(ls), fold)),
    ).otherwise(empty)


# --- relaxed ----------------------------------------------------------------


def _top_lines(all_lines: Column, rules: RuleProfile) -> Column:
    return F.slice(T.strip_noise(T.nonblank(all_lines), rules), 1, rules.top_band + 5)


def _facts(ls: Column, rules: RuleProfile) -> Column:
    """What each top line shows."""

    def one(x: Column, i: Column) -> Column:
        in_band = i < rules.top_band
        nxt = F.coalesce(F.get(ls, i + 1), F.lit(""))
        school = F.when(
            in_band & T.may_hold_school(x) & ~T.is_body_line(x, 45, rules),
            T.school_in_first(F.array(T.noisy_reading(x), x), rules),
        )

        def dated(yl: Column) -> Column:
            y = T.year_relaxed(x, nxt, rules, strict=yl)
            return F.struct(x.alias("t"), school.alias("so"), y.alias("y"), F.when(in_band, yl).alias("yl"))

        return bind(T.year_from_line(x, rules), dated)

    return F.transform(ls, one)


def _around_at(v: Column, i: Column) -> Column:
    return F.array_join(F.transform(T.around(v, i), lambda x: x["t"]), "\n")


def _finding(v: Column, full: Column | None, rules: RuleProfile) -> Column:
    """What a detector finds in the facts before the title is built: the line the title is
    read around, the school, the school without the whole-page text, and the year."""
    no_school = F.lit(None).cast("struct<school:string,branch:string>")

    def first_index(test) -> Column:
        index = F.sequence(F.lit(0), F.size(v) - 1)
        return F.get(F.filter(index, lambda i: test(F.get(v, i), i)), F.lit(0))

    def finding(at: Column, so: Column, own: Column, year: Column) -> Column:
        return F.struct(at.alias("at"), so.alias("so"), own.alias("own"), year.alias("year"))

    def strong(yi: Column) -> Column:
        def with_school(si: Column) -> Column:
            own = F.get(v, si)["so"]
            lost = no_school if full is None else T.school_in_full_text(full, rules)
            so = F.when(si.isNotNull(), own).otherwise(lost)
            return finding(F.greatest(F.coalesce(si, F.lit(-1)), yi), so, own, F.get(v, yi)["y"])

        return bind(first_index(lambda x, i: x["so"].isNotNull()), with_school)

    def vouched(i: Column) -> Column:
        """A subtitle or a marks-and-minutes line close to the school line."""
        return F.exists(T.around(v, i), lambda x: T.has_subtitle(x["t"], rules)) | bind(
            _around_at(v, i), lambda b: b.rlike(FULL_MARKS) & b.rlike(TIME_LIMIT)
        )

    def medium() -> Column:
        def with_year(i: Column) -> Column:
            after = F.filter(F.slice(v, i + 1, 5), lambda x: x["y"].isNotNull())
            top = F.filter(v, lambda x: x["yl"].isNotNull())
            year = F.coalesce(F.get(after, F.lit(0))["y"], F.get(top, F.lit(0))["yl"])
            so = F.get(v, i)["so"]
            return F.when(i.isNotNull(), finding(i, so, so, year))

        return bind(first_index(lambda x, i: x["so"].isNotNull() & vouched(i)), with_year)

    def title_like(x: Column, i: Column) -> Column:
        return x["y"].isNotNull() & (i < rules.top_band) & ~T.is_body_line(x["t"], 60, rules)

    found = bind(first_index(title_like), lambda yi: F.when(yi.isNotNull(), strong(yi)).otherwise(medium()))
    return F.when(F.size(v) > 0, found)


def _relaxed_title(blob: Column, f: Column, so: Column, subject: Column, rules: RuleProfile) -> Column:
    school = F.coalesce(so["school"], F.lit(rules.unnamed_school))
    return T.canonical_title(blob, school, so["branch"], f["year"], subject, rules)


def _relaxed_header(blob: Column, f: Column, subject: Column, rules: RuleProfile) -> Column:
    school = F.coalesce(f["so"]["school"], F.lit(rules.unnamed_school))
    title = _relaxed_title(blob, f, f["so"], subject, rules)
    return F.when(f.isNotNull(), _header(school, f["so"]["branch"], f["year"], title))


def relaxed_header(
    text: Column,
    full: Column | None = None,
    book_subject: Column | None = None,
    rules: RuleProfile = CN_EXAM,
) -> Column:
    """H2: header with parts lost.

    The year of the result is null when only the neighbourhood vouched for the
    school and no year was near; the caller may fill it from the page (W8).
    """
    subject = F.lit(None).cast("string") if book_subject is None else book_subject

    def titled(v: Column, f: Column) -> Column:
        return bind(_around_at(v, f["at"]), lambda b: _relaxed_header(b, f, subject, rules))

    def detect(v: Column) -> Column:
        return bind(_finding(v, full, rules), lambda f: titled(v, f))

    return F.when(
        T.holds_any(text, RELAXED_HINTS), bind(_top_lines(T.lines(text), rules), lambda ls: bind(_facts(ls, rules), detect))
    )


# --- volumes ----------------------------------------------------------------


def volume_prefix(text: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """Compilation name from the top lines of one text, '' when there is none."""
    named = lambda x: x.rlike(VOLUME_NAME) & ~x.rlike(QUESTION_LINE)

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(x, r"[（(][^）)]*$", "")
        return T.apply_fix(F.regexp_replace(x, "(?<![^一-鿿])[^一-鿿]++$", ""), rules)

    def pick(ls: Column) -> Column:
        top, following = F.slice(ls, 1, 3), F.slice(ls, 2, 3)
        # Two adjacent top lines read as one.
        pairs = F.zip_with(
            top,
            following,
            lambda a, b: F.when(
                b.isNotNull() & named(a) & named(b) & (F.length(a) + F.length(b) <= 48), F.concat(a, b)
            ),
        )
        single = F.filter(top, lambda x: named(x) & (F.length(x) <= 48))
        first = F.coalesce(
            F.get(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0)), F.get(single, F.lit(0))
        )
        return F.coalesce(bind(first, lambda f: F.when(f.isNotNull(), tidy(f))), F.lit(""))

    return bind(F.slice(T.nonblank_lines(text), 1, 4), pick)


def volume_header(texts: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """H3: volume of a compilation, from a page's texts in column order."""

    def build(vol: Column, prefix: Column) -> Column:
        named = F.contains(prefix, F.lit("真卷精编"))
        title = (
            F.when(named, prefix)
            .when(prefix != "", F.concat(prefix, F.lit("(分班)考试真卷精编("), vol, F.lit(")")))
            .otherwise(F.concat(F.lit("真卷精编("), vol, F.lit(")")))
        )
        title = F.replace(F.translate(T.drop_space(title), "（）", "()"), F.lit("(("), F.lit("("))
        title = F.regexp_replace(title, r"(真卷精编\([一二三四五六七八九十百0-9]+)$", "$1)")
        school = F.coalesce(T.nonempty(prefix), F.lit(rules.volume_school))
        return _header(school, F.lit(None), vol, title, volume=True)

    def detect(ts: Column) -> Column:
        vols = F.filter(
            F.transform(ts, lambda t: F.regexp_extract(t, VOLUME_MARK, 1)), lambda v: v != ""
        )
        prefixes = F.filter(F.transform(ts, lambda t: volume_prefix(t, rules)), lambda x: x != "")
        return bind(
            F.get(vols, F.lit(0)),
            lambda vol: F.when(
                vol.isNotNull(),
                bind(F.coalesce(F.get(prefixes, F.lit(0)), F.lit("")), lambda px: build(vol, px)),
            ),
        )

    marked = F.exists(texts, lambda t: F.contains(t, F.lit("真卷精编")))
    answered = F.array_join(texts, "\n").rlike(rules.answer_mark)
    return F.when(marked & ~answered, detect(texts))


# --- cascade ----------------------------------------------------------------


# Stands for the book's subject in a title until that is known.  A Unicode
# noncharacter, so no text can hold it.
PENDING_SUBJECT = "\ufdd0"


def with_column_headers(pages: DataFrame, rules: RuleProfile = CN_EXAM) -> DataFrame:
    """H4 over the columns of pages (cols, full): strict candidates, else one relaxed
    or volume header, as ``headers``.

    array<struct<strict: array, f, blob, loose: header>>; ``loose`` is looked for only
    when no strict candidate exists, and its title may hold PENDING_SUBJECT; ``f`` and
    ``blob`` are what the relaxed rules found before the title.  A text is cut into
    lines once and its lines are judged once.  Every step is a column of its own:
    lambdas inside one another are analysed anew at every level.
    """
    for step in _steps(id(SparkContext._gateway), rules):
        pages = pages.withColumn("headers", step)
    return pages


@functools.lru_cache(maxsize=16)
def _steps(_jvm: int, rules: RuleProfile) -> tuple[Column, ...]:
    """Built once per JVM; names and rules are all they depend on."""

    def cut(text: Column) -> Column:
        # Either kind of header needs one of these signs.
        return F.struct(text.alias("text"), F.when(T.holds_any(text, RELAXED_HINTS), T.lines(text)).alias("lines"))

    def strict(c: Column) -> Column:
        return F.struct(c["text"].alias("text"), c["lines"].alias("lines"), strict_headers(c["text"], rules, c["lines"]).alias("strict"))

    def judged(c: Column) -> Column:
        facts = F.when(c["lines"].isNotNull(), bind(_top_lines(c["lines"], rules), lambda ls: _facts(ls, rules)))
        return F.struct(c["text"].alias("text"), c["strict"].alias("strict"), facts.alias("v"))

    def found(c: Column) -> Column:
        f = F.when(c["v"].isNotNull(), _finding(c["v"], F.col("full"), rules))
        return F.struct(c["text"].alias("text"), c["strict"].alias("strict"), c["v"].alias("v"), f.alias("f"))

    def around(c: Column) -> Column:
        blob = F.when(c["f"].isNotNull(), _around_at(c["v"], c["f"]["at"]))
        return F.struct(c["text"].alias("text"), c["strict"].alias("strict"), c["f"].alias("f"), blob.alias("blob"))

    def loose(c: Column) -> Column:
        relaxed = _relaxed_header(c["blob"], c["f"], F.lit(PENDING_SUBJECT), rules)
        other = F.when(F.size(c["strict"]) == 0, F.coalesce(relaxed, volume_header(F.array(c["text"]), rules)))
        return F.struct(c["strict"].alias("strict"), c["f"].alias("f"), c["blob"].alias("blob"), other.alias("loose"))

    later = [F.transform("headers", step) for step in (strict, judged, found, around, loose)]
    return F.transform("cols", cut), *later


def titles_alone(headers: str, rules: RuleProfile = CN_EXAM) -> Column:
    """Per column that shows a header in ``headers`` (of ``with_column_headers``): the title the relaxed rules read from it by itself.

    Titles may hold PENDING_SUBJECT.
    """

    def one(c: Column) -> Column:
        same = c["f"]["own"].isNotNull() | c["f"]["so"].isNull()
        title = F.when((F.size(c["strict"]) == 0) & same, c["loose"]["title"]).otherwise(
            _relaxed_title(c["blob"], c["f"], c["f"]["own"], F.lit(PENDING_SUBJECT), rules)
        )
        return F.when(c["f"].isNotNull(), title)

    return F.transform(headers, one)


def settle_subject(title: Column, subject: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """header's own subject (already in), else the book's, else the default."""
    return F.replace(
        title, F.lit(PENDING_SUBJECT), F.coalesce(subject, F.lit(rules.default_subject))
    )
