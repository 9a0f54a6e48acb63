"""Rule profiles: every word list, pattern and threshold an operator consults.

A profile is plain frozen data.  Operators turn it into Column expressions at
plan-building time, so nothing here is shipped to executors as Python code.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

# White space spelt out: the class is cheaper to match than Java's  mode,
# and the characters serve trim and translate, which need no regex at all.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
DIGIT = r"\p{Nd}"
HAN = r"[一-鿿]"

# ---------------------------------------------------------------------------
# Fixed values.  These tables and patterns define the results and have to be
# exactly these; order matters in the pair lists.
# ---------------------------------------------------------------------------
FIX_PAIRS = (
    ("学术", "学校"),
    ("学木", "学校"),
    ("彭祥", "嘉祥"),
    ("其嘉祥", "某嘉祥"),
    ("基西川", "某西川"),
    ("基绵实", "某绵实"),
    ("邮都区", "郫都区"),
    ("郭都区", "郫都区"),
    ("其夹验", "某实验"),
    ("北第二外国语学院", "北京第二外国语学院附属中学"),
    ("人学", "入学"),
    ("盐祥", "嘉祥"),
    ("菜师大", "某师大"),
    ("龙录师一", "龙泉师一"),
    ("奖池金", "奖学金"),
    ("联中", "联合中学"),
    ("验外国学校", "实验外国语学校"),
    ("亮祥北城", "嘉祥北城"),
    ("前实验学校", "成都某郫都区博瑞实验学校"),
)
FIX_PATTERNS = (
    ("外国语学(?!校)", "外国语学校"),
    ("西川(?!中|外国|学)", "西川中学"),
)
SUBJECT_FIX_PAIRS = (
    ("闫语", "英语"),
    ("关语", "英语"),
    ("奖语", "英语"),
    ("趴语", "英语"),
    ("贞卷", "真卷"),
    ("趴卷", "真卷"),
    ("上卷", "真卷"),
)
PLACEHOLDER = "某"
PLACEHOLDER_MISREADS = "茶基菜其色前吕"
NOISE_WORDS = ("人的", "人知")
NOISE_CHARS = "龟和入国图罗钨的僵例因色站"
NAME_NOISE_CHARS = "人知龟和入国图罗钨的僵例因色站"
CITY_CHARS = "成四川浙北上海广深重天武西南长哈沈济青苏南福贵昆兰西"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⑾⑿⒀⒁⒂⒃⒄⒅⒆⒇"
SCHOOL_SUFFIXES = ("初中学校", "学校", "中学", "一中", "附中", "学院", "学术", "学木")
SCHOOL_ENDINGS = ("学校", "中学", "一中", "附中", "学院", "初中学校")
SCHOOL_REJECTS = (
    "年级", "共有", "平均", "同学", "其余", "人数", "每班", "每个学生",
    "男生", "女生", "班级", "学生",
)
SCHOOL_QUANTIFIERS = ("一名", "一个", "这个", "那个", "的", "是")
SCHOOL_BAD_STARTS = "这那该此每各"
SUBTITLE_HINTS = ("分班", "真卷", "真题", "新初一", "奖学金", "数学", "语文", "英语")
RELAXED_YEAR_HINTS = ("分班", "入学", "新初一", "真卷")
SUBJECTS = ("数学", "语文", "英语", "科学", "物理", "化学", "综合")
SUBJECT_PREFIXES = ("真卷", "分班", "试卷", "考试")
NOISE_LINE_WORDS = (
    "水印", "正版", "盗版", "翻印", "侵权", "版权", "必究", "印次", "印张", "出版", "书号", "定价",
    "百年树人", "品德第一", "我做起", "扫码", "二维码", "微信", "公众号", "淘宝", "客服",
    "视频讲解", "购买正版", "举报",
)
BODY_PUNCT = "[。？?！!；;]"
BODY_WORDS = (
    "多少", "几名", "参加", "如果", "已知", "求出", "至少", "分别是",
    "每小题", "共有", "则这", "那么",
)
YEAR_PATTERNS = (
    rf"初{WS}*({DIGIT}{{4}}){WS}*(?:级|届)?",
    rf"({DIGIT}{{4}}){WS}*届",
    rf"({DIGIT}{{4}})(?:{WS}*[a-zA-Z]*)?{WS}*(?:届|级|分班|入学|新初一|真卷)",
)
YEAR_CANDIDATE = rf"({DIGIT}{{4}})"
VOLUME_MARK = rf"真卷精编{WS}*[（(]{WS}*([一二三四五六七八九十百0-9]+){WS}*[)）]?"
ANSWER_MARK = rf"参考{WS}*答案"
VOLUME_NAME = "名校|公立|私立|入学|人学|新生|初一"
QUESTION_LINE = rf"^[一二三四五六七八九十]、|^第{WS}*{DIGIT}+{WS}*题|答案|解析|选择题|填空题"
FULL_MARKS = rf"满分{WS}*[：:]{WS}*{DIGIT}+"
TIME_LIMIT = rf"时[间加]{WS}*[：:]{WS}*{DIGIT}+|{DIGIT}+{WS}*分钟"
LAYOUTS = ("1-up", "2-up", "3-up")
# End of the fixed values.
# ---------------------------------------------------------------------------


def any_of(words: Iterable[str]) -> str:
    """Alternation matching any of the literal words.

    For Han words one range test rules out every position of Latin text.
    """
    words = tuple(words)
    ahead = f"(?={HAN})" if all(re.match(HAN, w) for w in words) else ""
    return f"{ahead}(?:{'|'.join(re.escape(w) for w in words)})"


@dataclass(frozen=True)
class RuleProfile:
    """Text rules for one kind of collection."""

    fix_pairs: tuple = FIX_PAIRS
    fix_patterns: tuple = FIX_PATTERNS
    subject_fix_pairs: tuple = SUBJECT_FIX_PAIRS
    subtitle_hints: tuple = SUBTITLE_HINTS
    relaxed_year_hints: tuple = RELAXED_YEAR_HINTS
    subjects: tuple = SUBJECTS
    subject_prefixes: tuple = SUBJECT_PREFIXES
    default_subject: str = "英语"
    noise_line: str = any_of(NOISE_LINE_WORDS)
    noise_keep: tuple = field(default=YEAR_PATTERNS[:2])
    body_punct: str = BODY_PUNCT
    body_words: tuple = BODY_WORDS
    year_patterns: tuple = YEAR_PATTERNS
    year_min: int = 2015
    year_max: int = 2039
    unnamed_school: str = "某校"
    volume_school: str = "真卷精编汇编"
    override_subject: str = "数学"
    answer_mark: str = ANSWER_MARK
    top_band: int = 10
    toc_keys: int = 3
    long_exam_pages: int = 4
    # 'page' closes the whole page when any column is an answer page,
    # 'column' only the column itself.
    answer_scope: str = "page"
    # Correction join: repair "初 2026届" without doubling the prefix.
    strict_year_prefix: bool = False


CN_EXAM = RuleProfile()

# Same rules with the known misfires repaired.
CN_EXAM_STRICT = replace(
    CN_EXAM,
    fix_pairs=tuple(
        p for p in FIX_PAIRS if p[0] not in ("验外国学校", "北第二外国语学院")
    ),
    fix_patterns=(
        ("实?验外国学校", "实验外国语学校"),
        ("北第二外国语学院(?!附属中学)", "北京第二外国语学院附属中学"),
        ("外国语学(?![校院])", "外国语学校"),
        ("西川(?!中|外国|学)", "西川中学"),
    ),
    strict_year_prefix=True,
)

# Latin-script running text: only the line rules differ.
LATIN = replace(
    CN_EXAM,
    noise_line="[Cc](?i:opyright)|[Ll](?i:icense)",
    noise_keep=(r"(?:19|20)\d\d",),
    body_punct="[?!;]",
    body_words=("therefore", "however", "because"),
)


@dataclass(frozen=True)
class LayoutProfile:
    """Thresholds of the gutter vote."""

    n_bands: int = 12
    blank_ink: float = 1.0
    min_gutter: float = 0.018
    min_gutter_px: int = 4
    search_span: float = 0.045
    reach: float = 0.6
    vote_ratio: float = 0.40
    overlap: float = 0.006
    band_ink_min: float = 2.0
    # Ink is anything this much darker than the paper white.
    ink_depth: int = 40
    paper_percentile: float = 95.0


SCAN = LayoutProfile()
