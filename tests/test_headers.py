"""Header detection: strict, relaxed, volume, cascade and page flags."""

from pyspark.sql import functions as F

from quirewise.operators import headers as H
from quirewise.operators import subpages as S

A = "成都某嘉祥外国语学校初2026届新初一分班真卷数学"


def titles(rows):
    return [r["title"] for r in rows]


def test_strict_single_line(one):
    got = one(H.strict_headers, f"junk\n⑫{A}\n1. 正文内容很多很多")
    assert [tuple(r) for r in got] == [("成都某嘉祥外国语学校", None, "2026", A, False)]


def test_strict_absorbs_follow_on_lines(one):
    got = one(H.strict_headers, "成都某七中育才学校初2026届\n新初一分班\n真卷数学\n正文正文正文")
    assert titles(got) == ["成都某七中育才学校初2026届新初一分班真卷数学"]
    got = one(H.strict_headers, "成都某七中育才学校初2026届分班\n真卷数学卷\n正文正文正文")
    assert titles(got) == ["成都某七中育才学校初2026届分班真卷数学卷"]


def test_strict_two_line_header(one):
    text = "成都某七中育才学校\n初2026级新初一分班（奖学金）\n真卷数学\n" + A
    got = one(H.strict_headers, text)
    assert titles(got) == ["成都某七中育才学校初2026级新初一分班（奖学金）真卷数学", A]


def test_strict_second_line_with_its_own_school(one):
    # The line after a bare school line is merged even when it names a school.
    got = one(H.strict_headers, "成都某七中育才学校\n" + A)
    assert titles(got) == ["成都某七中育才学校" + A]


def test_strict_distinct_keeps_first(one):
    assert titles(one(H.strict_headers, f"{A}\n正文正文\n{A}\n")) == [A]
    assert one(H.strict_headers, "") == []
    assert one(H.strict_headers, "no header 2026 here at all") == []


def test_relaxed_strong_from_full_page(one):
    col = "2) Mab JI PS) 2027 届新初一分班真卷闫语"
    full = col + "\n成都 吕 西川 2027 分班真卷碳语"
    got = one(lambda t, f: H.relaxed_header(t, f), col, full)
    assert (got["school"], got["year"]) == ("成都某西川中学", "2027")
    assert got["title"] == "成都某西川中学初2027届新初一分班真卷英语"


def test_relaxed_strong_without_school(one):
    got = one(H.relaxed_header, "初2026级\n满分：100分")
    assert tuple(got)[:3] == ("某校", None, "2026")
    assert one(H.relaxed_header, "2026届毕业生共有480人，分班") is None


def test_relaxed_medium(one):
    got = one(H.relaxed_header, "成都某七中育才学校\n满分：120 时间：90分钟\n1.计算")
    assert (got["school"], got["year"]) == ("成都某七中育才学校", None)
    assert got["title"] == "成都某七中育才学校新初一分班真卷英语"
    assert one(H.relaxed_header, "成都某七中育才学校\n1.计算\n2.应用") is None
    far = "成都某七中育才学校\n" + "甲乙丙丁\n" * 5 + "真卷"
    assert one(H.relaxed_header, far) is None


def test_relaxed_ignores_watermark(one):
    assert one(H.relaxed_header, "成都某七中育才学校\n绿色真卷水印为正版图书\n1.计算") is None


def test_volume(one):
    v = lambda t: H.volume_header(F.array(t))
    got = one(v, "公立名校初一新生入学(\n分班)考试真卷精编（十四\n1.题")
    assert got["title"] == "公立名校初一新生入学(分班)考试真卷精编(十四)"
    assert (got["year"], got["school"], got["volume"]) == ("十四", "公立名校初一新生入学", True)
    assert one(v, "真卷精编（二）")["title"] == "真卷精编(二)"
    assert one(v, "真卷精编（二）\n参考 答案") is None
    assert one(v, "普通文本") is None


def _pages(spark, rows):
    return spark.createDataFrame(rows, "book_id string, page int, cols array<string>, full string")


def _layout(spark, rows):
    return spark.createDataFrame(rows, "book_id string, page int, layout string")


def test_page_flags_and_carry(spark):
    heads = [A.replace("2026", str(y)) for y in (2024, 2025, 2026, 2027)]
    toc = "\n正文正文正文正文\n".join(heads)
    pages = _pages(
        spark,
        [
            ("b", 1, [toc], ""),
            ("b", 2, [toc, ""], ""),
            ("b", 3, [A, "成都某七中育才学校\n满分：120 时间：90分钟"], ""),
            ("b", 4, ["正文参考", "x"], "答案"),
            ("b", 5, [], ""),
        ],
    )
    lay = _layout(spark, [("b", 1, "1-up"), ("b", 2, "2-up"), ("b", 4, "1-up")])
    sub = {(r["page"], r["col"]): r for r in S.build_subpages(pages, lay).collect()}
    assert sub[1, 0]["is_toc"] and not sub[2, 0]["is_toc"]
    assert sorted(sub) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (5, 0), (5, 1)]
    assert sub[3, 1]["key"]["year"] == "2026" and "2026" not in sub[3, 1]["key"]["title"]
    assert sub[4, 0]["is_answer"]


def test_overrides(spark):
    pages = _pages(spark, [("b", 1, ["参考答案", "x"], "")])
    lay = _layout(spark, [("b", 1, "2-up")])
    ov = spark.createDataFrame(
        [("b", 1, "自贡某蜀光中学", None, "2027", None), ("b", 9, "x", None, None, None)],
        "book_id string, page int, school string, branch string, year string, title string",
    )
    rows = S.build_subpages(pages, lay, ov).collect()
    assert len(rows) == 2 and not any(r["is_answer"] for r in rows)
    assert {r["key"]["title"] for r in rows} == {"自贡某蜀光中学初2027级新初一分班真卷数学"}


def test_book_subject(spark):
    pages = _pages(spark, [("b", 1, ["数学 语文", "语文"], "数学"), ("c", 1, ["英语", "数学"], ""), ("d", 1, ["x"], "")])
    got = {r["book_id"]: r["subject"] for r in S.book_subjects(pages).collect()}
    assert got == {"b": "数学", "c": "英语"}


def test_nest_strips(spark):
    strip = spark.createDataFrame([("b", 1, 1, "y"), ("b", 1, 0, "x")], "book_id string, page int, col int, text string")
    row = S.nest_strips(strip).head()
    assert (row["cols"], row["full"]) == (["x", "y"], "")


def test_lines_are_judged_once_for_both_titles(spark, monkeypatch):
    from dataclasses import replace

    from quirewise.functions import text as T
    from quirewise.operators.subpages import detect_headers
    from quirewise.rules import CN_EXAM

    judged, real = [], T.strip_noise
    monkeypatch.setattr(T, "strip_noise", lambda *a: judged.append(1) or real(*a))
    rules = replace(CN_EXAM, year_max=2038)
    school = "成都某七中育才学校"
    texts = [f"{A}\n正文", f"{school}\n满分：120 时间：90分钟", "2026 届新初一分班真卷闫语", "正文", None]
    pages = spark.createDataFrame([("b", 1, texts, "成都 吕 西川 2027\nx")], "book_id string, page int, cols array<string>, full string")
    row = detect_headers(pages, rules).head()
    assert len(judged) == 1
    alone = spark.createDataFrame([(t or "",) for t in texts], "t string").select(H.relaxed_header(F.col("t"), None, F.lit(H.PENDING_SUBJECT), rules)["title"])
    assert row["alone"] == [r[0] for r in alone.collect()]
    assert [len(f["strict"]) for f in row["found"]] == [1, 0, 0, 0, 0]
    assert [f["loose"] and f["loose"]["school"] for f in row["found"]] == [None, school, "成都某西川中学", None, None]
