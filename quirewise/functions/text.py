"""Text clean-up as Column expressions (nothing here runs Python on a row)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import (
    CIRCLED,
    CITY_CHARS,
    CN_EXAM,
    HAN,
    NAME_NOISE_CHARS,
    NOISE_CHARS,
    NOISE_WORDS,
    PLACEHOLDER,
    PLACEHOLDER_MISREADS,
    SCHOOL_BAD_STARTS,
    SCHOOL_ENDINGS,
    SCHOOL_QUANTIFIERS,
    SCHOOL_REJECTS,
    SCHOOL_SUFFIXES,
    DIGIT,
    WS,
    WS_CHARS,
    WS_SET,
    YEAR_CANDIDATE,
    RuleProfile,
    any_of,
)

SCHOOL = (
    rf"({HAN}{{2,16}}?(?:{'|'.join(SCHOOL_SUFFIXES)}))"
    rf"{WS}*([（(]{WS}*({HAN}{{1,10}}){WS}*[)）])?"
)
# A school name can only come from text holding one of these characters …
SCHOOL_HINTS = "学中川"
# … and, once everything is out that some reading drops between characters,
# one of these: the suffixes and what the corrections turn into a suffix.
SCHOOL_TRACE = "学[校院术木]|中学|[中一附联]中|语学|西川"
LATIN_JUNK = r"[a-zA-Z0-9{}\[\]()|\\/_-]+"
DROPPED_JUNK = r"[a-zA-Z0-9{}\[\]()|\\/_'\"‘’“”-]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    Inside higher-order functions Spark shares no sub-expressions, so a value
    used twice would otherwise be computed twice at every nesting level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds_any(c: Column, signs: str) -> Column:
    """Whether a text holds any of the signs; byte searches, which need no decoding."""
    return functools.reduce(operator.or_, [F.contains(c, F.lit(s)) for s in signs])


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def drop_space(c: Column) -> Column:
    return F.translate(c, WS_CHARS, "")


def squeeze_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def lines(c: Column) -> Column:
    """text to its stripped lines; a final line break opens no extra line."""
    parts = F.split(c, r"\R|[\x1c-\x1e]")
    return bind(
        parts,
        lambda p: F.transform(
            F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
            strip,
        ),
    )


def nonblank(all_lines: Column) -> Column:
    """P10: lines that hold anything."""
    return F.filter(all_lines, lambda x: x != "")


def nonblank_lines(c: Column) -> Column:
    return nonblank(lines(c))


def around(v: Column, i: Column, before: int = 1, after: int = 4) -> Column:
    """The entries of ``v`` from ``before`` ahead of place ``i`` to ``after`` behind it."""
    first = F.greatest(i - before, F.lit(0))
    return F.slice(v, first + 1, i + after + 1 - first)


def of_length(all_lines: Column, n: int = 4) -> Column:
    """P10: lines of at least ``n`` characters."""
    return F.filter(all_lines, lambda x: F.length(x) >= n)


def min_length_lines(c: Column, n: int = 4) -> Column:
    return of_length(lines(c), n)


def constant(rows: Iterable[tuple], *names: str) -> Column:
    """A fixed table as one literal array of structs."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    structs = (
        "struct(" + ", ".join(f"{quote(v)} AS {n}" for v, n in zip(row, names)) + ")" for row in rows
    )
    return F.expr(f"array({', '.join(structs)})")


def replace_pairs(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements one after the other.

    A fold over a literal table keeps the expression small however often the
    correction is used in a plan.
    """
    return F.aggregate(
        constant(pairs, "old", "new"), c, lambda acc, p: F.replace(acc, p["old"], p["new"])
    )


def apply_fix(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """ordered dictionary correction.

    A first replacement needs its source in the text as it stands, so text
    holding no source at all skips the whole fold after one match attempt.
    """
    gate = "|".join([any_of(a for a, _ in rules.fix_pairs)] + [p for p, _ in rules.fix_patterns])

    def fold(v: Column) -> Column:
        out = replace_pairs(v, rules.fix_pairs)
        for pattern, new in rules.fix_patterns:
            out = F.regexp_replace(out, pattern, new)
        return F.when(v.rlike(gate), out).otherwise(v)

    return bind(c, fold)


def fix_subject(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F2"""
    return replace_pairs(c, rules.subject_fix_pairs)


def restore_placeholder(c: Column) -> Column:
    """F3"""
    return F.translate(c, PLACEHOLDER_MISREADS, PLACEHOLDER * len(PLACEHOLDER_MISREADS))


def strip_lead(c: Column) -> Column:
    """item numbers and their misreadings at the start of a line."""
    c = F.regexp_replace(c, f"^[{CIRCLED}]+", "")
    c = F.regexp_replace(c, rf"^[(（]{WS}*{DIGIT}+{WS}*[)）]{WS}*", "")
    c = F.regexp_replace(c, rf"^{DIGIT}++[.、)）]{WS}*", "")
    c = F.regexp_replace(c, "^四(?!川)", "")
    c = F.regexp_replace(c, rf"['\"‘’“”]{WS}*[a-zA-Z]{{0,3}}{WS}*", "")
    return F.regexp_replace(
        lstrip(c), rf"^(?:(?:{any_of(NOISE_WORDS)}|[{NOISE_CHARS}]){WS}*)++", ""
    )


def normalize(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """one stray character before the placeholder goes too."""
    return strip(
        F.regexp_replace(
            strip_lead(apply_fix(c, rules)), f"^[^{PLACEHOLDER}](?={PLACEHOLDER})", ""
        )
    )


def normalize_title(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F6"""
    return squeeze_space(strip_lead(apply_fix(c, rules)))


def clean_school_name(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F7"""
    c = lstrip(restore_placeholder(apply_fix(c, rules)))
    c = F.regexp_replace(c, rf"^(?:[{NAME_NOISE_CHARS}]{WS}*)++", "")
    return F.regexp_replace(c, f"^{PLACEHOLDER}(?=[{CITY_CHARS}])", "")


def clean_title(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F8"""
    c = squeeze_space(fix_subject(restore_placeholder(apply_fix(c, rules)), rules))
    c = F.regexp_replace(c, r"\(([^()]*)\|([^()]*)\)", "($1$2)")
    c = F.regexp_replace(c, r"(?<!\()校区\)", "(校区)")
    c = F.regexp_replace(c, r"真卷语\(", "真卷英语(")
    c = F.regexp_replace(c, r"分班语\(", "分班英语(")
    c = F.regexp_replace(
        c, rf"(?<!{DIGIT}){DIGIT}++\){WS}*(?={DIGIT}{{4}}{WS}*届|初{WS}*{DIGIT}{{4}})", ""
    )
    c = F.regexp_replace(
        c, rf"{WS}*[|—\-«~•·]+{WS}*(?={DIGIT}{{4}}{WS}*[届级]|初{WS}*{DIGIT}{{4}})", ""
    )
    c = F.regexp_replace(c, rf"(?<!成)华{WS}*[(（]{WS}*校{WS}*区{WS}*[)）]", "成华（校区）")
    tail = rf"[{WS_SET}©®|、．·a-zA-Z]"
    return F.regexp_replace(c, rf"(?<!{tail}){tail}++$", "")


# --- predicates ------------------------------------------------------------


def is_noise_line(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """Boilerplate, unless the line carries a hard year."""
    hit = c.rlike(rules.noise_line)
    for keep in rules.noise_keep:
        hit = hit & ~c.rlike(keep)
    return hit


def strip_noise(line_array: Column, rules: RuleProfile = CN_EXAM) -> Column:
    return F.filter(line_array, lambda x: ~is_noise_line(x, rules))


def is_body_line(c: Column, max_len: int = 45, rules: RuleProfile = CN_EXAM) -> Column:
    """Reads like a sentence rather than a title."""
    pattern = f"{rules.body_punct}|{any_of(rules.body_words)}"
    return bind(drop_space(c), lambda s: (F.length(s) > max_len) | s.rlike(pattern))


def has_subtitle(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """P6"""
    return c.rlike(any_of(rules.subtitle_hints))


def is_short_subtitle(c: Column, max_len: int = 70, rules: RuleProfile = CN_EXAM) -> Column:
    """P7"""
    return (F.length(c) <= max_len) & has_subtitle(c, rules)


def has_answer_mark(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """P9"""
    return c.rlike(rules.answer_mark)


def plausible_year(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """P5: full-width digits count as digits; anything unreadable is false."""
    number = F.translate(c, "０１２３４５６７８９", "0123456789").try_cast("int")
    return F.coalesce(number.between(rules.year_min, rules.year_max), F.lit(False))


def valid_school(c: Column) -> Column:
    """P8"""
    ok = (
        c.rlike(f"(?:{'|'.join(SCHOOL_ENDINGS)})$")
        & ~c.rlike(any_of(SCHOOL_REJECTS + SCHOOL_QUANTIFIERS))
        & ~c.rlike(f"^[{SCHOOL_BAD_STARTS}]")
        & (c.startswith(PLACEHOLDER) | (F.length(c) >= 4))
    )
    return F.coalesce(ok, F.lit(False))


# --- years, schools, subjects ----------------------------------------------


def _first_plausible(c: Column, pattern: str, rules: RuleProfile) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.get(F.filter(found, lambda y: plausible_year(y, rules)), F.lit(0))


def year_from_line(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """first plausible year, patterns tried in order of priority."""
    return F.when(
        c.rlike(YEAR_CANDIDATE),
        F.coalesce(*[_first_plausible(c, p, rules) for p in rules.year_patterns]),
    )


def year_relaxed(
    c: Column, following: Column, rules: RuleProfile = CN_EXAM, strict: Column | None = None
) -> Column:
    """any plausible number once this or the next line carries a hint.

    ``strict`` is the line's F9 year when the caller has it already.
    """
    hints = any_of(rules.relaxed_year_hints)
    return F.coalesce(
        year_from_line(c, rules) if strict is None else strict,
        F.when(
            c.rlike(YEAR_CANDIDATE) & (c.rlike(hints) | following.rlike(hints)),
            _first_plausible(c, YEAR_CANDIDATE, rules),
        ),
    )


def school_in_normalized(n: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """First school of an already normalised line, as struct<school, branch>."""
    raw = F.regexp_extract(n, SCHOOL, 1)
    name = bind(
        nonempty(raw), lambda m: F.when(m.isNotNull(), clean_school_name(normalize(m, rules), rules))
    )
    return bind(
        name,
        lambda s: F.when(
            valid_school(s),
            F.struct(s.alias("school"), nonempty(F.regexp_extract(n, SCHOOL, 3)).alias("branch")),
        ),
    )


def may_hold_school(c: Column) -> Column:
    """Cheap necessary condition for any school reading of a line."""
    compact = F.regexp_replace(drop_space(c), DROPPED_JUNK, "")
    return holds_any(c, SCHOOL_HINTS) & compact.rlike(SCHOOL_TRACE)


def school_in_line(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F11"""
    return F.when(
        may_hold_school(c),
        bind(normalize_title(c, rules), lambda n: school_in_normalized(n, rules)),
    )


def _without_latin(c: Column) -> Column:
    return drop_space(F.regexp_replace(c, LATIN_JUNK, ""))


def school_in_first(texts: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F11 on the first of several readings that shows a school."""
    none = F.lit(None).cast("struct<school:string,branch:string>")
    return F.aggregate(texts, none, lambda acc, t: F.coalesce(acc, school_in_line(t, rules)))


def noisy_reading(c: Column) -> Column:
    """A polluted line with Latin, digits, brackets and blanks taken out."""
    return _without_latin(strip_lead(c))


def school_in_noisy_line(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """F12"""
    return F.when(
        holds_any(c, SCHOOL_HINTS),
        bind(noisy_reading(c), lambda s: school_in_line(s, rules)),
    )


def school_in_full_text(full: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """first clean school among the top lines of the whole-page text."""
    found = F.transform(
        F.slice(nonblank_lines(full), 1, rules.top_band),
        lambda ln: bind(_without_latin(ln), lambda s: school_in_line(s, rules)),
    )
    usable = F.filter(found, lambda so: so.isNotNull() & ~has_subtitle(so["school"], rules))
    return F.when(holds_any(full, SCHOOL_HINTS), F.get(usable, F.lit(0)))


def subject_in(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """prefix order decides before subject order."""
    marks = [(pre + sub, sub) for pre in rules.subject_prefixes for sub in rules.subjects]
    return bind(
        fix_subject(c, rules),
        lambda b: F.get(
            F.filter(constant(marks, "mark", "subject"), lambda m: F.contains(b, m["mark"])), F.lit(0)
        )["subject"],
    )


def canonical_title(
    blob: Column,
    school: Column,
    branch: Column,
    year: Column,
    book_subject: Column,
    rules: RuleProfile = CN_EXAM,
) -> Column:
    """rebuild a title from its recovered pieces."""
    subject = F.coalesce(subject_in(blob, rules), book_subject, F.lit(rules.default_subject))
    kind = (
        F.when(F.contains(blob, F.lit("奖学金")), "分班（奖学金）")
        .when(F.contains(blob, F.lit("分班")), "分班")
        .when(F.contains(blob, F.lit("入学")), "入学")
        .otherwise("分班")
    )
    return clean_title(
        F.concat(
            F.coalesce(nonempty(school), F.lit(rules.unnamed_school)),
            F.coalesce(F.concat(F.lit("（"), nonempty(branch), F.lit("）")), F.lit("")),
            F.coalesce(F.concat(F.lit("初"), nonempty(year), F.lit("届")), F.lit("")),
            F.lit("新初一"),
            kind,
            F.lit("真卷"),
            subject,
        ),
        rules,
    )


# --- numbers and names -----------------------------------------------------


# The signs of numerals and what they stand for.
CN_DIGITS, WIDE_DIGITS, ASCII_DIGITS = "一二三四五六七八九", "０１２３４５６７８９", "0123456789"


def cn_number(c: Column) -> Column:
    """F16: a numeral to int, 0 when unclear; full-width digits are digits.

    A number in digits alone is read as it stands.  Else every 百 and 十 counts as
    often as the sign right before it says (once without one), the last sign is
    added, and signs that are no part of a numeral are overlooked.
    """
    plain = F.translate(strip(c), WIDE_DIGITS, ASCII_DIGITS)
    signs = lambda v: F.translate(F.regexp_replace(v, f"[^{CN_DIGITS}0-9十百]", ""), CN_DIGITS, ASCII_DIGITS[1:])

    def counted(pair: Column) -> Column:
        times = F.greatest(F.coalesce(F.regexp_substr(pair, F.lit("^[0-9]")).try_cast("int"), F.lit(1)), F.lit(1))
        return times * F.when(pair.endswith("百"), 100).otherwise(10)

    def value(v: Column) -> Column:
        units = F.regexp_extract_all(v, F.lit("[0-9]?[十百]"), F.lit(0))
        last = F.coalesce(F.regexp_substr(v, F.lit("[0-9]$")).try_cast("int"), F.lit(0))
        return F.aggregate(F.transform(units, counted), F.lit(0), lambda x, y: x + y) + last

    return bind(
        plain, lambda v: F.when(v.rlike("^[0-9]+$"), v.try_cast("int")).otherwise(bind(signs(v), value))
    )


ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*]'


def output_name(title: Column, school: Column, branch: Column, year: Column) -> Column:
    """F17"""
    built = F.concat(
        F.coalesce(school, F.lit("")),
        F.coalesce(F.concat(F.lit("("), nonempty(branch), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" 初"), nonempty(year), F.lit("届")), F.lit(" 未知届")),
    )
    return F.regexp_replace(
        drop_space(F.coalesce(nonempty(title), built)), ILLEGAL_NAME_CHARS, "_"
    )


def prefix_year(c: Column, rules: RuleProfile = CN_EXAM) -> Column:
    """put the prefix before a bare year."""
    if rules.strict_year_prefix:
        return F.regexp_replace(c, rf"(?:初{WS}*)?(?<!{DIGIT})({DIGIT}{{4}})届", "初$1届")
    return F.regexp_replace(c, rf"(?<!初)({DIGIT}{{4}})届", "初$1届")


TITLE_PARTS = rf"(?d)^(.*?)(?:[(（](.*?)[)）])?{WS}*初{WS}*({DIGIT}{{4}}){WS}*届"


def parse_title(c: Column) -> Column:
    """struct<school, branch, year>; an unmatched title is all school."""
    part = lambda i: F.regexp_extract(c, TITLE_PARTS, i)
    return F.when(
        c.rlike(TITLE_PARTS),
        F.struct(
            strip(part(1)).alias("school"),
            F.when(part(2) != "", strip(part(2))).alias("branch"),
            part(3).alias("year"),
        ),
    ).otherwise(
        F.struct(
            c.alias("school"),
            F.lit(None).cast("string").alias("branch"),
            F.lit(None).cast("string").alias("year"),
        )
    )
