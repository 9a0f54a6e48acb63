"""Line operators and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_once
from ..rules import CN_EXAM_STRICT, FIX_PAIRS, LATIN, SUBJECT_FIX_PAIRS, WS_CHARS
from . import query
from . import tables as t

RE2_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = (
    "raw AS (SELECT doc_id, regexp_split_to_array(text, '" + RE2_BREAK + "') AS a FROM documents), "
    "cut AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM raw), "
    "lines AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no, "
    f"trim(unnest(a), '{WS_CHARS}') AS line FROM cut), "
    "solid AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS n, line "
    "FROM lines WHERE line <> '')"
)


def documents(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", "text")


def line_rows(spark, sf_dir, lines):
    return explode_once(documents(spark, sf_dir), ["doc_id"], lines, "line_no", "line")


@query("lines", f"WITH {LINES} SELECT * FROM lines")
def lines(spark, sf_dir):
    return line_rows(spark, sf_dir, T.lines(F.col("text")))


@query("long_lines", f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE length(line) >= 4 GROUP BY doc_id")
def long_lines(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.size(T.min_length_lines(F.col("text"), 4)).cast("long").alias("n")
    ).filter("n > 0")


@query(
    "noise_strip",
    f"WITH {LINES} SELECT doc_id, count(*) AS kept, count(*) FILTER (regexp_matches(line, '(?i)copyright|license')) "
    "AS kept_for_year FROM solid WHERE NOT (regexp_matches(line, '(?i)copyright|license') "
    "AND NOT regexp_matches(line, '(19|20)[0-9][0-9]')) GROUP BY doc_id",
)
def noise_strip(spark, sf_dir):
    kept = T.strip_noise(T.nonblank_lines(F.col("text")), LATIN)
    return (
        documents(spark, sf_dir)
        .withColumn("kept", kept)
        .select(
            "doc_id",
            F.size("kept").cast("long").alias("kept"),
            F.size(F.filter("kept", lambda x: x.rlike(LATIN.noise_line))).cast("long").alias("kept_for_year"),
        )
        .filter("kept > 0")
    )


@query(
    "body_lines",
    f"WITH {LINES}, b AS (SELECT doc_id, translate(line, '{WS_CHARS}', '') AS s FROM solid) "
    "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(s) > 45 OR regexp_matches(s, '[?!;]|therefore|however|because')) "
    "AS n_body FROM b GROUP BY doc_id",
)
def body_lines(spark, sf_dir):
    solid = T.nonblank_lines(F.col("text"))
    return (
        documents(spark, sf_dir)
        .withColumn("solid", solid)
        .select(
            "doc_id",
            F.size("solid").cast("long").alias("n_lines"),
            F.size(F.filter("solid", lambda x: T.is_body_line(x, 45, LATIN))).cast("long").alias("n_body"),
        )
        .filter("n_lines > 0")
    )


@query("top_band", f"WITH {LINES} SELECT doc_id, n, line FROM solid WHERE n < 10")
def top_band(spark, sf_dir):
    band = F.slice(T.nonblank_lines(F.col("text")), 1, 10)
    return line_rows(spark, sf_dir, band).withColumnRenamed("line_no", "n")


@query(
    "adjacent_pairs",
    f"WITH {LINES} SELECT a.doc_id, a.n, a.line || b.line AS pair FROM solid a JOIN solid b "
    "ON a.doc_id = b.doc_id AND b.n = a.n + 1 WHERE a.n < 3",
)
def adjacent_pairs(spark, sf_dir):
    def pairs(top):
        return F.filter(
            F.zip_with(F.slice(top, 1, 3), F.slice(top, 2, 3), lambda a, b: F.concat(a, b)),
            lambda p: p.isNotNull(),
        )

    solid = F.slice(T.nonblank_lines(F.col("text")), 1, 4)
    return explode_once(documents(spark, sf_dir), ["doc_id"], T.bind(solid, pairs), "n", "pair")


@query(
    "neighbourhood",
    f"WITH {LINES} SELECT a.doc_id, a.n, string_agg(b.line, chr(10) ORDER BY b.n) AS blob FROM solid a JOIN solid b "
    "ON a.doc_id = b.doc_id AND b.n BETWEEN a.n - 1 AND a.n + 4 GROUP BY a.doc_id, a.n",
)
def neighbourhood(spark, sf_dir):
    """The frame of every line of every text."""

    def blobs(solid):
        return F.transform(solid, lambda _, i: F.array_join(T.around(solid, i), "\n"))

    return explode_once(documents(spark, sf_dir), ["doc_id"], T.bind(T.nonblank_lines(F.col("text")), blobs), "n", "blob")


# --- corrections ------------------------------------------------------------------

_SOURCES = tuple(a for a, _ in FIX_PAIRS) + ("外国语学", "西川")
FIX_INPUT = f"('成都' || {t.pick('doc_id', _SOURCES)} || {t.pick('doc_id / 21', ('校', '中学', '外国', 'en'))} || lang)"


def nested_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def fix_sql(expr: str) -> str:
    """F1 without look-ahead: protect the good spellings, repair, restore."""
    expr = nested_replace(expr, FIX_PAIRS)
    expr = f"regexp_replace({expr}, '外国语学(校?)', '外国语学校', 'g')"
    expr = rf"regexp_replace({expr}, '西川(中|外国|学)', '§\1', 'g')"
    return f"replace(replace({expr}, '西川', '西川中学'), '§', '西川')"


def scalar(spark, sf_dir, source: str, *cols, needs=("doc_id", "lang")):
    docs = t.table(spark, sf_dir, "documents").select(*needs)
    return docs.selectExpr("doc_id", f"{source} AS given").select("doc_id", *cols)


@query("dictionary_fix", f"SELECT doc_id, {fix_sql(FIX_INPUT)} AS fixed FROM documents")
def dictionary_fix(spark, sf_dir):
    return scalar(spark, sf_dir, FIX_INPUT, T.apply_fix(F.col("given")).alias("fixed"))


_SUBJECT_SOURCES = tuple(a for a, _ in SUBJECT_FIX_PAIRS) + ("真卷", "其他基")
SUBJECT_INPUT = f"('入学' || {t.pick('doc_id', _SUBJECT_SOURCES)} || {t.pick('doc_id / 9', ('茶', '数学', '吕'))} || lang)"


@query(
    "subject_and_placeholder_fix",
    f"SELECT doc_id, {nested_replace(SUBJECT_INPUT, SUBJECT_FIX_PAIRS)} AS subject_fixed, "
    f"translate({SUBJECT_INPUT}, '茶基菜其色前吕', '某某某某某某某') AS restored FROM documents",
)
def subject_and_placeholder_fix(spark, sf_dir):
    return scalar(
        spark,
        sf_dir,
        SUBJECT_INPUT,
        T.fix_subject(F.col("given")).alias("subject_fixed"),
        T.restore_placeholder(F.col("given")).alias("restored"),
    )


LEAD_INPUT = (
    f"({t.pick('doc_id', ('⑫', '（12） ', '3、', '四', '四川', '人的 龟', '”ab', '  '))} || "
    f"{t.pick('doc_id / 8', ('成都', '图书', '某校', 'ab某'))} || lang)"
)
_WSRE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lead_sql(x: str) -> str:
    x = f"regexp_replace({x}, '^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⑾⑿⒀⒁⒂⒃⒄⒅⒆⒇]+', '')"
    x = rf"regexp_replace({x}, '^[(（]{_WSRE}*[0-9]+{_WSRE}*[)）]{_WSRE}*', '')"
    x = rf"regexp_replace({x}, '^[0-9]+[.、)）]{_WSRE}*', '')"
    x = f"regexp_replace(regexp_replace({x}, '^四川', '§'), '^四', '')"
    x = f"replace({x}, '§', '四川')"
    x = f"regexp_replace({x}, '[''\"‘’“”]{_WSRE}*[a-zA-Z]{{0,3}}{_WSRE}*', '', 'g')"
    x = f"ltrim({x}, '{WS_CHARS}')"
    return f"regexp_replace({x}, '^((人的|人知|[龟和入国图罗钨的僵例因色站]){_WSRE}*)+', '')"


@query(
    "strip_lead",
    f"SELECT doc_id, {lead_sql(LEAD_INPUT)} AS bare, "
    f"trim(regexp_replace({lead_sql(fix_sql(LEAD_INPUT))}, '^[^某]某', '某'), '{WS_CHARS}') AS name, "
    f"trim(regexp_replace({lead_sql(fix_sql(LEAD_INPUT))}, '{_WSRE}+', ' ', 'g'), '{WS_CHARS}') AS title FROM documents",
)
def strip_lead(spark, sf_dir):
    g = F.col("given")
    return scalar(
        spark,
        sf_dir,
        LEAD_INPUT,
        T.strip_lead(g).alias("bare"),
        T.normalize(g).alias("name"),
        T.normalize_title(g).alias("title"),
    )


NAME_INPUT = f"({t.pick('doc_id', ('人知', '基', '某', '某成都', '某四川', ' 吕'))} || {t.pick('doc_id / 6', ('西川中学', '七中学校', '前实验学校'))})"


@query(
    "clean_school_name",
    "SELECT doc_id, regexp_replace(regexp_replace(ltrim(translate("
    f"{fix_sql(NAME_INPUT)}, '茶基菜其色前吕', '某某某某某某某'), '{WS_CHARS}'), '^([人知龟和入国图罗钨的僵例因色站]{_WSRE}*)+', ''), "
    r"'^某([成四川浙北上海广深重天武西南长哈沈济青苏南福贵昆兰西])', '\1') AS school FROM documents",
)
def clean_school_name(spark, sf_dir):
    return scalar(spark, sf_dir, NAME_INPUT, T.clean_school_name(F.col("given")).alias("school"))


TITLE_INPUT = (
    f"({t.pick('doc_id', ('成都某校', '华(校区)', '成华(校区)', '龙泉校区)', '(校区)'))} || "
    f"{t.pick('doc_id / 5', (' 47) ', ' |—-« ', '  ', '(二|)'))} || {t.YEAR} || "
    f"{t.pick('doc_id / 20', ('届', ' 届', '级'))} || {t.pick('doc_id / 60', ('真卷语(一)', '趴卷数学', '分班语(二) RNY |'))})"
)


def title_sql(x: str) -> str:
    """F8 in RE2: look-around by capture groups and protected spellings."""
    x = nested_replace(f"translate({fix_sql(x)}, '茶基菜其色前吕', '某某某某某某某')", SUBJECT_FIX_PAIRS)
    x = f"trim(regexp_replace({x}, '{_WSRE}+', ' ', 'g'), '{WS_CHARS}')"
    x = rf"regexp_replace({x}, '\(([^()]*)\|([^()]*)\)', '(\1\2)', 'g')"
    x = f"replace(replace(replace({x}, '(校区)', '§'), '校区)', '(校区)'), '§', '(校区)')"
    x = f"replace(replace({x}, '真卷语(', '真卷英语('), '分班语(', '分班英语(')"
    x = rf"regexp_replace({x}, '[0-9]+\) *([0-9]{{4}} *届|初 *[0-9]{{4}})', '\1', 'g')"
    x = rf"regexp_replace({x}, ' *[|—\-«~•·]+ *([0-9]{{4}} *[届级]|初 *[0-9]{{4}})', '\1', 'g')"
    x = f"replace(regexp_replace(replace({x}, '成华', '§'), '华 *[(（] *校 *区 *[)）]', '成华（校区）', 'g'), '§', '成华')"
    return f"regexp_replace({x}, '[ ©®|、．·a-zA-Z]+$', '')"


@query("title_clean", f"SELECT doc_id, {title_sql(TITLE_INPUT)} AS title FROM documents")
def title_clean(spark, sf_dir):
    return scalar(spark, sf_dir, TITLE_INPUT, T.clean_title(F.col("given")).alias("title"))


# --- years, schools, subjects ---------------------------------------------------------

YEAR_INPUT = (
    f"('第 ' || CAST(doc_id % 3000 AS STRING) || ' 题 ' || {t.pick('doc_id', ('初', '', ' '))} || "
    f"CAST(2010 + doc_id % 35 AS STRING) || {t.pick('doc_id / 3', ('届', ' 级', 'fe 真卷', ' fe', '分班'))} || ' ' || lang)"
)


def years_sql(x: str) -> str:
    plausible = (
        "list_filter(regexp_extract_all({0}, '{1}', 1), lambda y: CAST(y AS INTEGER) BETWEEN 2015 AND 2039)[1]"
    )
    patterns = (r"初\s*(\d{4})\s*(?:级|届)?", r"(\d{4})\s*届", r"(\d{4})(?:\s*[a-zA-Z]*)?\s*(?:届|级|分班|入学|新初一|真卷)")
    return f"coalesce({', '.join(plausible.format(x, p) for p in patterns)})"


def relaxed_sql(x: str, nxt: str) -> str:
    return (
        f"coalesce({years_sql(x)}, CASE WHEN regexp_matches({x} || chr(10) || {nxt}, '分班|入学|新初一|真卷') THEN "
        rf"list_filter(regexp_extract_all({x}, '(\d{{4}})', 1), lambda y: CAST(y AS INTEGER) BETWEEN 2015 AND 2039)[1] END)"
    )


@query("year_extract", f"SELECT doc_id, {years_sql(YEAR_INPUT)} AS year FROM documents")
def year_extract(spark, sf_dir):
    return scalar(spark, sf_dir, YEAR_INPUT, T.year_from_line(F.col("given")).alias("year"))


NEXT_INPUT = t.pick("doc_id / 7", ("", "新初一", "x"))


@query("relaxed_year", f"SELECT doc_id, {relaxed_sql(YEAR_INPUT, NEXT_INPUT)} AS year FROM documents")
def relaxed_year(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.selectExpr("doc_id", f"{YEAR_INPUT} AS given", f"{NEXT_INPUT} AS following")
    return rows.select("doc_id", T.year_relaxed(F.col("given"), F.col("following")).alias("year"))


@query(
    "plausible_years",
    "SELECT doc_id, n_chars BETWEEN 2015 AND 2039 AS plausible FROM documents",
)
def plausible_years(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", T.plausible_year(F.col("n_chars").cast("string")).alias("plausible"))


SCHOOL_INPUT = (
    f"({t.pick('doc_id', ('⑫', '12. ', '', '四'))} || {t.pick('doc_id / 4', t.SCHOOLS + ('这样学校', '一名一中', '六年级学生学校', '无名'))} "
    f"|| '初' || {t.YEAR} || '届' || lang)"
)
_SCHOOL_RE2 = r"([一-\x{9fff}]{2,16}?(?:初中学校|学校|中学|一中|附中|学院|学术|学木))"


def _school_ctes() -> str:
    clean = (
        "regexp_replace(regexp_replace(translate(raw, '茶基菜其色前吕', '某某某某某某某'), "
        rf"'^[人知龟和入国图罗钨的僵例因色站]+', ''), '^某([成四川浙北上海广深重天武西南长哈沈济青苏南福贵昆兰西])', '\1')"
    )
    return (
        f"n AS (SELECT doc_id, {lead_sql(fix_sql(SCHOOL_INPUT))} AS n FROM documents), "
        f"m AS (SELECT doc_id, n, regexp_extract(n, '{_SCHOOL_RE2}', 1) AS raw, "
        rf"regexp_extract(n, '{_SCHOOL_RE2}\s*([（(]\s*([一-\x{{9fff}}]{{1,10}})\s*[)）])?', 3) AS br FROM n), "
        f"c AS (SELECT doc_id, {clean} AS school, nullif(br, '') AS branch FROM m WHERE raw <> ''), "
        "v AS (SELECT * FROM c WHERE regexp_matches(school, '(学校|中学|一中|附中|学院)$') "
        "AND NOT regexp_matches(school, '年级|共有|平均|同学|其余|人数|每班|每个学生|男生|女生|班级|学生|一名|一个|这个|那个|的|是|^[这那该此每各]') "
        "AND (starts_with(school, '某') OR length(school) >= 4))"
    )


@query(
    "school_capture",
    f"WITH {_school_ctes()} SELECT d.doc_id, v.school, v.branch FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id",
)
def school_capture(spark, sf_dir):
    so = scalar(spark, sf_dir, SCHOOL_INPUT, T.school_in_line(F.col("given")).alias("so"))
    return so.select("doc_id", "so.school", "so.branch")


@query(
    "school_recover",
    f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '成都某西川中学' END AS school FROM ({t.STRIPS_SQL})",
)
def school_recover(spark, sf_dir):
    rows = t.page_strips(spark, sf_dir).select("page", "full")
    return rows.select(
        F.col("page").alias("doc_id"), T.school_in_full_text(F.col("full"))["school"].alias("school")
    )


BLOB_INPUT = (
    f"({t.pick('doc_id', ('真卷', '分班', '试卷', '考试', '分班数学 真卷', '其他'))} || "
    f"{t.pick('doc_id / 6', ('数学', '闫语', '语文', '综合', '体育'))} || {t.pick('doc_id / 30', ('奖学金', '入学', ''))} || lang)"
)
_SUBJ = ("数学", "语文", "英语", "科学", "物理", "化学", "综合")


def subject_sql(x: str) -> str:
    fixed = nested_replace(x, SUBJECT_FIX_PAIRS)
    cases = " ".join(
        f"WHEN contains({fixed}, '{p}{s}') THEN '{s}'" for p in ("真卷", "分班", "试卷", "考试") for s in _SUBJ
    )
    return f"(CASE {cases} END)"


@query("subject_from", f"SELECT doc_id, {subject_sql(BLOB_INPUT)} AS subject FROM documents")
def subject_from(spark, sf_dir):
    return scalar(spark, sf_dir, BLOB_INPUT, T.subject_in(F.col("given")).alias("subject"))


_BRANCH = t.pick("doc_id / 2", ("北城", None)).replace("'None'", "NULL")
_KIND = (
    f"(CASE WHEN contains({BLOB_INPUT}, '奖学金') THEN '分班（奖学金）' WHEN contains({BLOB_INPUT}, '分班') THEN '分班' "
    f"WHEN contains({BLOB_INPUT}, '入学') THEN '入学' ELSE '分班' END)"
)


@query(
    "make_title",
    f"SELECT doc_id, {t.pick('doc_id', ('某实验学校', '四川某师大一中'))} || coalesce('（' || {_BRANCH} || '）', '') || '初' || {t.YEAR} "
    f"|| '届新初一' || {_KIND} || '真卷' || coalesce({subject_sql(BLOB_INPUT)}, '英语') AS title FROM documents",
)
def make_title(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.selectExpr(
        "doc_id",
        f"{BLOB_INPUT} AS blob",
        f"{t.pick('doc_id', ('某实验学校', '四川某师大一中'))} AS school",
        f"{_BRANCH} AS branch",
        f"{t.YEAR} AS year",
    )
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id",
        T.canonical_title(F.col("blob"), F.col("school"), F.col("branch"), F.col("year"), none).alias("title"),
    )


# --- names and numbers -----------------------------------------------------------------

CN_INPUT = (
    f"({t.pick('doc_id / 10', ('', '一百', '二百', '三百零'))} || {t.pick('doc_id', ('一', '九', '十', '十一', '二十', '二十八', '九十九', '五', 'x', '7'))})"
)
_CN_VALUE = t.pick("doc_id", ("1", "9", "10", "11", "20", "28", "99", "5", "0", "7"))
_CN_BASE = t.pick("doc_id / 10", ("0", "100", "200", "300"))


@query(
    "wide_number",
    f"SELECT doc_id, CAST({_CN_BASE} AS INTEGER) + CAST({_CN_VALUE} AS INTEGER) AS n, CAST(doc_id % 1000 AS INTEGER) AS wide FROM documents",
)
def wide_number(spark, sf_dir):
    """Numerals among other signs, and numbers in full-width digits."""
    noisy = f"'第 ' || {CN_INPUT} || ' 卷'"
    rows = t.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{noisy} AS given", "'　' || translate(CAST(doc_id % 1000 AS STRING), '0123456789', '０１２３４５６７８９') AS wide"
    )
    return rows.select("doc_id", T.cn_number(F.col("given")).alias("n"), T.cn_number(F.col("wide")).alias("wide"))


@query(
    "cn_number",
    f"SELECT doc_id, CAST({_CN_BASE} AS INTEGER) + CAST({_CN_VALUE} AS INTEGER) AS n FROM documents",
)
def cn_number(spark, sf_dir):
    return scalar(spark, sf_dir, CN_INPUT, T.cn_number(F.col("given")).alias("n"))


PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "output_name",
    f"SELECT page_id, regexp_replace(translate(CASE WHEN page_id % 5 = 0 OR {PAGE_TITLE} = '' THEN "
    "'某校' || CASE WHEN page_id % 2 = 0 THEN '(北)' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN ' 未知届' ELSE ' 初2026届' END "
    f"ELSE {PAGE_TITLE} END, '{WS_CHARS}', ''), "
    r"""'[<>:"/\\|?*]', '_', 'g') AS name FROM pages""",
)
def output_name(spark, sf_dir):
    rows = t.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"CASE WHEN page_id % 5 = 0 THEN '' ELSE {PAGE_TITLE} END AS title",
        "'某校' AS school",
        "CASE WHEN page_id % 2 = 0 THEN '北' END AS branch",
        "CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2026' END AS year",
    )
    return rows.select(
        "page_id",
        T.output_name(F.col("title"), F.col("school"), F.col("branch"), F.col("year")).alias("name"),
    )


PARSE_INPUT = (
    f"({t.pick('doc_id', t.SCHOOLS + ('无', '( )校'))} || {t.pick('doc_id / 8', ('初', ' 初 ', '无'))} || {t.YEAR} || "
    f"{t.pick('doc_id / 24', ('届', ' 届', '级'))} || '新初一')"
)
_PARTS_RE2 = r"^(.*?)(?:[(（](.*?)[)）])?\s*初\s*(\d{4})\s*届"


@query(
    "parse_title",
    f"WITH p AS (SELECT doc_id, {PARSE_INPUT} AS g FROM documents), m AS (SELECT doc_id, g, regexp_matches(g, '{_PARTS_RE2}') AS hit, "
    f"regexp_extract(g, '{_PARTS_RE2}', 1) AS a, regexp_extract(g, '{_PARTS_RE2}', 2) AS b, regexp_extract(g, '{_PARTS_RE2}', 3) AS y FROM p) "
    "SELECT doc_id, CASE WHEN hit THEN trim(a) ELSE g END AS school, CASE WHEN hit AND b <> '' THEN trim(b) END AS branch, "
    "CASE WHEN hit THEN y END AS year, "
    r"replace(replace(regexp_replace(replace(g, '初2', '§2'), '(\d{4})届', '初\1届', 'g'), '§初', '初'), '§', '初') AS raw_prefixed FROM m",
)
def parse_title(spark, sf_dir):
    g = F.col("given")
    rows = scalar(
        spark, sf_dir, PARSE_INPUT, T.parse_title(g).alias("p"), T.prefix_year(g).alias("raw_prefixed")
    )
    return rows.select("doc_id", "p.school", "p.branch", "p.year", "raw_prefixed")


# --- rules over every line of the texts ---------------------------------------------------

#: A scanned line as the rules meet it: something in front, a misreading, the document's own line, a year.
SCANNED = (
    f"({t.pick('n', ('⑫', '（12） ', '', '3、', '四', '四川', '人的 龟', '”ab', '  '))} || "
    f"{t.pick('doc_id + n', _SOURCES + ('',))} || line || ' ' || CAST(2010 + (doc_id + n) % 35 AS STRING) || "
    f"{t.pick('doc_id + n', ('届', ' 级', '', 'fe 真卷', '', '分班'))})"
)
FOLLOWING = f"({t.pick('n', ('', '新初一', '', '分班'))} || following)"
_SCANNED_SQL = (
    f"{LINES}, near AS (SELECT doc_id, n, line, lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY n) AS following FROM solid), "
    f"src AS (SELECT doc_id, n, {SCANNED} AS given, {FOLLOWING} AS following FROM near)"
)


def scanned_lines(spark, sf_dir):
    """doc_id, n, given, following: every line that is not blank, of every text, and the one after it."""

    def pairs(solid):
        following = lambda i: F.coalesce(F.get(solid, i + 1), F.lit(""))
        return F.transform(solid, lambda x, i: F.struct(x.alias("line"), following(i).alias("following")))

    rows = explode_once(documents(spark, sf_dir), ["doc_id"], T.bind(T.nonblank_lines(F.col("text")), pairs), "n", "pair")
    rows = rows.select("doc_id", "n", "pair.line", "pair.following")
    return rows.selectExpr("doc_id", "n", f"{SCANNED} AS given", f"{FOLLOWING} AS following")


@query(
    "line_corrections",
    f"WITH {_SCANNED_SQL}, fixed AS (SELECT doc_id, n, given, {fix_sql('given')} AS fixed FROM src) "
    f"SELECT doc_id, n, fixed, {nested_replace('given', SUBJECT_FIX_PAIRS)} AS subject_fixed, {lead_sql('given')} AS bare, "
    f"trim(regexp_replace({lead_sql('fixed')}, '{_WSRE}+', ' ', 'g'), '{WS_CHARS}') AS title FROM fixed",
)
def line_corrections(spark, sf_dir):
    g = F.col("given")
    return scanned_lines(spark, sf_dir).select(
        "doc_id", "n",
        T.apply_fix(g).alias("fixed"), T.fix_subject(g).alias("subject_fixed"),
        T.strip_lead(g).alias("bare"), T.normalize_title(g).alias("title"),
    )


@query(
    "line_years",
    f"WITH {_SCANNED_SQL} SELECT doc_id, n, {years_sql('given')} AS year, {relaxed_sql('given', 'following')} AS relaxed FROM src",
)
def line_years(spark, sf_dir):
    g = F.col("given")
    return scanned_lines(spark, sf_dir).select(
        "doc_id", "n", T.year_from_line(g).alias("year"), T.year_relaxed(g, F.col("following")).alias("relaxed")
    )


# The strict profile's misfires, each beside the spelling that has to stay.
_MISFIRES = ("验外国学校", "实验外国学校", "北第二外国语学院", "北第二外国语学院附属中学", "外国语学院", "外国语学", "西川", "西川学", "学木", "")
STRICT = f"({t.pick('doc_id + n', _MISFIRES)} || line || {t.pick('n', ('初 2026届', '2026届', ' 12026届', '初2027 届', '初  2028届', '2031级'))})"


def strict_sql(x: str) -> str:
    """F1 of the strict profile without look-ahead."""
    x = nested_replace(x, [p for p in FIX_PAIRS if p[0] not in ("验外国学校", "北第二外国语学院")])
    x = f"regexp_replace({x}, '实?验外国学校', '实验外国语学校', 'g')"
    x = f"replace(replace({x}, '北第二外国语学院附属中学', '¤'), '北第二外国语学院', '北京第二外国语学院附属中学')"
    x = f"replace({x}, '¤', '北第二外国语学院附属中学')"
    x = rf"replace(regexp_replace({x}, '外国语学([校院])', '¶\1', 'g'), '外国语学', '外国语学校')"
    x = rf"regexp_replace(replace({x}, '¶', '外国语学'), '西川(中|外国|学)', '§\1', 'g')"
    return f"replace(replace({x}, '西川', '西川中学'), '§', '西川')"


def strict_year_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '([0-9]{{5,}})届', '\1†届', 'g')"
    return rf"replace(regexp_replace({x}, '(初{_WSRE}*)?([0-9]{{4}})届', '初\2届', 'g'), '†', '')"


@query(
    "line_corrections_strict",
    f"WITH {LINES}, src AS (SELECT doc_id, n, {STRICT} AS given FROM solid) "
    f"SELECT doc_id, n, {strict_sql('given')} AS fixed, {strict_year_sql('given')} AS dated FROM src",
)
def line_corrections_strict(spark, sf_dir):
    """F1 and F18 of the profile whose misfires are repaired."""
    rows = explode_once(documents(spark, sf_dir), ["doc_id"], T.nonblank_lines(F.col("text")), "n", "line")
    g = F.col("given")
    return rows.selectExpr("doc_id", "n", f"{STRICT} AS given").select(
        "doc_id", "n", T.apply_fix(g, CN_EXAM_STRICT).alias("fixed"), T.prefix_year(g, CN_EXAM_STRICT).alias("dated")
    )
