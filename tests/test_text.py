"""Golden cases for the text functions."""

import pytest
from pyspark.sql import functions as F

from quirewise import CN_EXAM_STRICT, LATIN
from quirewise.functions import text as T


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (T.apply_fix, "外国语学", "外国语学校"),
        (T.apply_fix, "外国语学校", "外国语学校"),
        (T.apply_fix, "成都某西川", "成都某西川中学"),
        (T.apply_fix, "西川外国语", "西川外国语"),
        (T.apply_fix, "实验外国学校", "实实验外国语学校"),
        (T.apply_fix, "某联中", "某联合中学"),
        (T.apply_fix, "Plain latin text", "Plain latin text"),
        (T.strip_lead, "四川某师大一中", "四川某师大一中"),
        (T.strip_lead, "四成都某西川中学", "成都某西川中学"),
        (T.strip_lead, "⑫成都", "成都"),
        (T.strip_lead, "(12) 成都", "成都"),
        (T.strip_lead, "12、成都", "成都"),
        (T.strip_lead, "人的 龟 成都", "成都"),
        (T.strip_lead, "　成都", "成都"),
        (T.normalize, "x某嘉祥", "某嘉祥"),
        (T.clean_school_name, "吕西川中学", "西川中学"),
        (T.clean_title, "(二|)", "(二)"),
        (T.clean_title, "龙泉校区)", "龙泉(校区)"),
        (T.clean_title, "(龙泉校区)", "(龙泉(校区)"),
        (T.clean_title, "真卷语(一)", "真卷英语(一)"),
        (T.clean_title, "47) 2026届", "2026届"),
        (T.clean_title, "西川中学 |—-« 2025 届", "西川中学2025 届"),
        (T.clean_title, "华(校区)", "成华（校区）"),
        (T.clean_title, "真卷数学 RNY |", "真卷数学"),
        (T.year_from_line, "第 1250 棵树 … 2025 届", "2025"),
        (T.year_from_line, "初 2040级", None),
        (T.year_from_line, "初２０２６届", "２０２６"),
        (T.prefix_year, "某校2026届", "某校初2026届"),
        (T.prefix_year, "初2026届", "初2026届"),
        (T.prefix_year, "初 2026届", "初 初2026届"),
    ],
)
def test_golden(one, fn, given, want):
    assert one(fn, given) == want


def test_strict_profile(one):
    fix = lambda c: T.apply_fix(c, CN_EXAM_STRICT)
    assert one(fix, "实验外国学校") == "实验外国语学校"
    assert one(fix, "北第二外国语学院") == "北京第二外国语学院附属中学"
    assert one(fix, one(fix, "北第二外国语学院")) == "北京第二外国语学院附属中学"
    assert one(lambda c: T.prefix_year(c, CN_EXAM_STRICT), "初 2026届") == "初2026届"


def test_relaxed_year(one):
    assert one(T.year_relaxed, "2025 fe ... 一分班", "") == "2025"
    assert one(T.year_relaxed, "2025 fe", "新初一") == "2025"
    assert one(T.year_relaxed, "2025 fe", "") is None


@pytest.mark.parametrize("y, ok", [("1200", 0), ("2580", 0), ("2015", 1), ("2039", 1), ("十", 0)])
def test_plausible(one, y, ok):
    assert one(T.plausible_year, y) == bool(ok)


@pytest.mark.parametrize(
    "name, ok",
    [("一名一中", 0), ("这个中学", 0), ("这样学校", 0), ("某一中", 1), ("成都七中学校", 1), ("a中学", 0)],
)
def test_valid_school(one, name, ok):
    assert one(T.valid_school, name) == bool(ok)


def test_noise_and_body(one):
    assert one(T.is_noise_line, "绿色真卷水印为正版图书")
    assert not one(T.is_noise_line, "绿色真卷水印为正版图书 初2026级")
    assert one(lambda c: T.is_noise_line(c, LATIN), "Copyright 2001 x") is False
    assert one(lambda c: T.is_noise_line(c, LATIN), "License text")
    assert one(T.is_body_line, "至少要几个")
    assert one(T.is_body_line, "x" * 46)
    assert not one(T.is_body_line, "x " * 45)


def test_schools(one):
    assert one(T.school_in_noisy_line, "成 都 其 rs} tn 联 L 中 RNY")["school"] == "成都某联合中学"
    full = "Mab\n成都 吕 西川 2027 分班真卷碳语"
    assert one(T.school_in_full_text, full)["school"] == "成都某西川中学"
    got = one(T.school_in_line, "12. 成都某嘉祥外国语学校（ 北城 ）初2025届")
    assert (got["school"], got["branch"]) == ("成都某嘉祥外国语学校", "北城")


@pytest.mark.parametrize(
    "s, n", [("１２", 12), ("　７ ", 7), ("0十", 10), ("第二x十卷", 20), ("二八", 8), ("百十", 110), ("三百零２", 302), ("十一", 11), ("二十", 20), ("二十八", 28), ("一百零五", 105), ("7", 7), ("", 0), ("x", 0)]
)
def test_cn_number(one, s, n):
    assert one(T.cn_number, s) == n


def test_lines(one):
    assert one(T.lines, " a \r\nb\x0cc\x1cd\n") == ["a", "b", "c", "d"]
    assert one(T.lines, "") == []
    assert one(T.lines, "a\n\n") == ["a", ""]


def test_names(one):
    name = lambda t, s, b, y: T.output_name(t, s, b, y)
    assert one(name, "A B", "s", None, None) == "AB"
    assert one(name, "a/b", "s", None, None) == "a_b"
    assert one(name, None, "某校", "北", "2026") == "某校(北)初2026届"
    assert one(name, "", "某校", None, None) == "某校未知届"


def test_parse_title(one):
    got = one(T.parse_title, "成都某校（北城）初2026届新初一")
    assert tuple(got) == ("成都某校", "北城", "2026")
    assert tuple(one(T.parse_title, "无年份")) == ("无年份", None, None)


def test_subject(one):
    assert one(T.subject_in, "入学真卷闫语") == "英语"
    assert one(T.subject_in, "分班数学 真卷语文") == "语文"
    assert one(T.subject_in, "数学") is None
    blob = lambda b: T.canonical_title(
        b, F.lit("某校"), F.lit(None).cast("string"), F.lit("2026"), F.lit("数学")
    )
    assert one(blob, "奖学金") == "某校初2026届新初一分班（奖学金）真卷数学"
    assert one(blob, "入学真卷语文") == "某校初2026届新初一入学真卷语文"
