"""Main texts of hand-made sites, and classes against occurrence vectors built in full."""

import collections

import pytest

from quirewise.llm import markup, templates

SCHEMA = "page_id long, url string, html string, host string, text string, page string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "p", 1) for r in rows], SCHEMA).repartition(3)


def texts(spark, rows, **options):
    return collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in templates.extract(frame(spark, rows), **options).collect())


def only(spark, html):
    (row,) = texts(spark, [(1, "http://a.example/x", html)])
    return row[1]


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; T</title><script>var t="</p><article>no";</script><style>p{}</style></head>
<body class="home has-sidebar"><header><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a href='/b>"'>Blog</a></ul></nav></header>
<div id="cookie-notice">We use cookies</div><!-- <article>hidden</article> --><div class="content has-sidebar"><article>
<header class="entry-header"><h1>Caf&eacute;  &lt;b&gt;</h1><span>by someone</span></header>
<p>First <b>bold<p>second&nbsp;one &amp;amp; a < b
<p class="advert">Buy!</p><div class="ad-slot"><p>Ad</p></div><p>third<br>line <span class="sponsored">no</span>yes</p>
<form><input value="x"><label>Mail</label></form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>
<aside>Side</aside><section class="comments"><h2>Comments</h2><article class="comment"><p>Nice</p></article></section>
</article></div><div class="sidebar"><p>Links</p></div><footer>&copy; 2024</footer><p hidden>gone</p>"""
LINES = ["Café <b>", "First bold", "second one &amp; a < b", "third line yes", "one", "two", "c1", "c2"]


def test_one_page(spark):
    assert only(spark, ARTICLE) == "\n".join(LINES)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><p>a</article><footer>f", "a"),
        ("<nav><ul><li>menu<article><p>a</p></article>", "a"),
        ("<main><h2>T</h2>text</main><p>out", "T\ntext"),
        ("<!--><article>a<!-- b --!>c</article>", "ac"),
        ("<article>a<script>x</article>", "a"),
        ("<article>a<p title='1>2' x=\"3>4\">b<br/>c<p", "a\nb c"),
        ("<div role=main>a</div>b", "a"),
        ("<article>x<article>y</article>z</article><div class=related><article>n</article></div>", "x\ny\nz"),
        ("plain &amp words", "plain & words"),
        ("<form><article>a</article><p>b</form>", "a"),
        ("<article><div style='display: none'>h</div><p aria-hidden=true>i</p>v</article>", "v"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
        ("", ""),
        (None, ""),
        ("<article>  \n </article>", ""),
    ],
)
def test_markup(html, want):
    assert "\n".join(templates.main_blocks(markup.read_page(html), set(), set(), None)) == want


def soup(i, body, menu=3):
    links = "".join(f'<a href="/{i}/{k}">Link {k * 7 + i}</a> ' for k in range(menu))
    return f'<html><body><div class="c1">{links}</div><div class="c2"><div class="c3">{body}</div></div><div class="c4">Page of site {i}</div></body></html>'


def test_site_without_articles(spark):
    rows = [(i, f"https://u:p@Soup.example:80/{i}", soup(i, f"<p>Story number {i} has words<p>and more of them {i * i}")) for i in range(8)]
    want = {(i, f"Story number {i} has words\nand more of them {i * i}") for i in range(8)}
    assert {r[:2] for r in texts(spark, rows)} == want


def test_template_words_go_and_copies_stay(spark):
    box = "<p>Join our readers today</p>"
    story = [" ".join(f"w{i * 7 + k}" for k in range(20)) for i in range(30)]
    rows = [(i, f"http://a.example/{i}", f"<article><p>Story about {story[i]}</p>{box}</article>") for i in range(30)]
    copies = [(100 + i, "http://b.example/", "<article><p>Always the same words</p></article>") for i in range(30)]
    few = [(200 + i, f"http://c.example/{i}", f"<article><p>Tale {i}</p>{box}</article>") for i in range(3)]
    want = {(i, f"Story about {story[i]}") for i in range(30)}
    want |= {(100 + i, "Always the same words") for i in range(30)} | {(200 + i, f"Tale {i}\nJoin our readers today") for i in range(3)}
    assert {r[:2] for r in texts(spark, rows + copies + few)} == want


def test_nulls_repeats_and_empty_table(spark):
    page = "<article><p>é漢 text</p></article>"
    rows = [(1, None, page), (1, None, page), (None, "no host", page), (2, "http://x/", None), (3, "http://x/", ""), (4, None, "<article>" + "word " * 100_000)]
    found = texts(spark, rows)
    long = " ".join(["word"] * 100_000)
    assert found == {(1, "é漢 text", 7): 2, (None, "é漢 text", 7): 1, (2, "", 0): 1, (3, "", 0): 1, (4, long, len(long)): 1}
    assert templates.extract(frame(spark, rows).limit(0)).count() == 0


def test_classes_have_equal_vectors(spark):
    rows = [(i, f"http://a.example/{i}", soup(i % 4, "<p>Common words here</p>" * (i % 3 + 1) + f"<i>{i}</i>", menu=2)) for i in range(25)]
    rows += [(50 + i, "http://b.example/", f"<ul><li>{i}</ul>") for i in range(3)]
    found = {r["host"]: r for r in templates.classes(templates.keyed(frame(spark, rows))).collect()}
    assert {h: r["n"] for h, r in found.items()} == {"a.example": 25, "b.example": 3}
    vectors = collections.defaultdict(dict)
    for i, (_, _, html) in enumerate(rows[:25]):
        page = markup.read_page(html)
        counts = collections.Counter((0, t) for t in page.tags)
        counts.update((b.place.path, markup.word_token(b.place.path, w)) for b in page.blocks for w in b.words)
        for token, n in counts.items():
            vectors[token][i] = n
    groups = collections.defaultdict(set)
    for (scope, token), v in vectors.items():
        groups[scope, tuple(v.get(i, 0) for i in range(25))].add(token)
    want = set()
    for (scope, v), tokens in groups.items():
        support = sum(map(bool, v))
        if (scope == 0 and support >= 12.5 and (len(tokens) > 1 or set(v) == {1})) or (scope and support == 25 and len(tokens) > 1):
            want.add((scope, frozenset(tokens)))
    assert {(c["scope"], frozenset(c["tokens"])) for c in found["a.example"]["classes"]} == want
    assert any(c["scope"] for c in found["a.example"]["classes"])


def test_order_of_a_class():
    assert templates._order([1, 2, 3]) == templates._order([1, 2, 3, 1, 2, 3]) != templates._order([2, 1, 3])
    assert {templates._order(x) for x in ([1, 1, 2], [1, 2, 2, 1], [1, 2, 1])} == {templates.BROKEN}
