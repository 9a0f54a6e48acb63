"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its tags and words, told apart by the containers they stand
in.  Tokens with one occurrence vector over the pages of a host form a class.
Vectors are never built: a token carries two sums, over its pages, of a hash of
page and count, which partial aggregates add up, so a host of any size costs one
row per task and token.  A class is valid if its tokens come in one order on all
pages and all its occurrences lie in one gap of the class around it.  The class
of tags that stand once on every page is the root; valid classes nest in its
gaps.  Texts are the slots between: which slots hold the main text is decided per
host, and words that the template itself holds are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm import markup
from quirewise.llm.common import chunks, mix, partitions, spread_lookup, stage_table

#: Words are template text only where at least so many pages of a host agree.
MIN_PAGES = 20
#: Of the host's pages, a tag class stands on this share at least.
SUPPORT = 0.5
#: Slots of this share of linked words are lists of links.
LINKED = 0.5

_COUNT = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


# ------------------------------------------------------------ pages at rest

PACKED = "page_id {id}, url string, host string, deal long, page binary"


def keyed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, host, page_key (equal for equal pages) of every row."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.withColumns({"host": host_of(F.col("url")), "page_key": F.xxhash64("url", "html")})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages compressed for their exchange; ``deal`` numbers a task's rows, so equal pages can be dealt apart."""
    press, at = zstandard.ZstdCompressor(level=1), 0
    for batch in chunks(batches, column="html"):
        pages = pa.array([press.compress((h or "").encode("utf-8", "surrogatepass")) for h in batch.column("html").to_pylist()], pa.binary())
        deal = pa.array((mix(np.arange(at, at + batch.num_rows, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), deal, pages], names=["page_id", "url", "host", "deal", "page"])


def packed(rows: DataFrame) -> DataFrame:
    rows = rows.select("page_id", "url", "host", "html")
    return rows.mapInArrow(_pack, PACKED.format(id=dict(rows.dtypes)["page_id"]))


def _pages(batch: pa.RecordBatch) -> Iterator[markup.Page]:
    if "html" in batch.schema.names:
        yield from (markup.read_page(h.as_py()) for h in batch.column("html"))
        return
    press = zstandard.ZstdDecompressor()
    for data in batch.column("page"):
        yield markup.read_page(press.decompress(data.as_py()).decode("utf-8", "surrogatepass"))


# ------------------------------------------------------------ occurrence vectors

VECTOR = "host string, scope long, token long, a long, b long, pages long, total long"
_VECTOR = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("scope", "token", "a", "b", "pages", "total"))])
#: The token that every page has once; its count is the number of pages.
PAGE = 0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token the sums of a task's pages; words that some page of the host lacks can't be on all and are left out."""
    for batch in chunks(batches, column="html"):
        tags: dict[tuple[str, int], list[int]] = {}
        words: dict[str, dict] = {}
        keys = mix(batch.column("page_key").to_numpy().view(np.uint64))
        for host, key, page in zip(batch.column("host").to_pylist(), keys, _pages(batch)):
            seen: dict[int, int] = {PAGE: 1}
            for t in page.tags:
                seen[t] = seen.get(t, 0) + 1
            spoken: dict[tuple[int, str], int] = {}
            for block in page.blocks:
                path = block.place.path
                for w in block.words:
                    spoken[path, w] = spoken.get((path, w), 0) + 1
            most = max(max(seen.values()), max(spoken.values(), default=1))
            marks = mix(key + np.arange(most + 1, dtype=np.uint64) * _COUNT)
            low, high = (marks & np.uint64(0xFFFFFFFF)).tolist(), (marks >> np.uint64(32)).tolist()
            for t, n in seen.items():
                sums = tags.setdefault((host, t), [0, 0, 0, 0])
                for i, x in enumerate((low[n], high[n], 1, n)):
                    sums[i] += x
            known = words.get(host)
            if known is None:
                words[host] = {w: [low[n], high[n], 1, n] for w, n in spoken.items()}
            else:
                kept = {}
                for w in known.keys() & spoken.keys():
                    n, sums = spoken[w], known[w]
                    kept[w] = [sums[0] + low[n], sums[1] + high[n], sums[2] + 1, sums[3] + n]
                words[host] = kept
        rows = [(host, 0, t, *sums) for (host, t), sums in tags.items()]
        rows += [(host, path, markup.word_token(path, w), *sums) for host, known in words.items() for (path, w), sums in known.items()]
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _VECTOR)], schema=_VECTOR)


def classes(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, n (its pages), classes: array of (id, scope, root, tokens) with equal occurrence vectors and enough support.

    Tags count from half of the host's pages on, words on all of at least
    ``min_pages``.  All tokens of a class stand on one page, so no list outgrows a page.
    """
    sums = [F.sum(c).alias(c) for c in ("a", "b", "pages", "total")]
    tokens = rows.select("host", "page_key", "html").mapInArrow(_vectors, VECTOR).groupBy("host", "scope", "token").agg(*sums)
    tokens = stage_table(tokens, "vectors")
    hosts = tokens.filter((F.col("scope") == 0) & (F.col("token") == PAGE)).select("host", F.col("pages").alias("n"))
    key = ["host", "scope", "a", "b", "pages", "total"]
    grouped = tokens.filter(F.col("token") != PAGE).groupBy(*key).agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    grouped = spread_lookup(grouped, hosts, "host", F.xxhash64(*key), 4 * partitions(rows.sparkSession))
    root = (F.col("scope") == 0) & (F.col("pages") == F.col("n")) & (F.col("total") == F.col("n"))
    tags = (F.col("scope") == 0) & (F.col("pages") >= F.col("n") * SUPPORT) & (root | (F.size("tokens") > 1))
    text = (F.col("scope") != 0) & (F.col("pages") == F.col("n")) & (F.col("n") >= min_pages) & (F.size("tokens") > 1)
    one = F.struct(F.xxhash64("scope", "a", "b", "pages", "total").alias("id"), "scope", root.alias("root"), "tokens")
    kept = F.collect_list(F.when(tags | text, one))  # hosts of pages without any tag have none
    return hosts.join(grouped.groupBy("host").agg(kept.alias("classes")), "host", "left")


# ------------------------------------------------------------ order and nesting

FACT = "host string, class long, gap long, path long, zone int, low long, high long, gap_low long, gap_high long, words long, linked long, template long"
_FACT = pa.schema([
    ("host", pa.string()), ("class", pa.int64()), ("gap", pa.int64()), ("path", pa.int64()), ("zone", pa.int32()),
    *((c, pa.int64()) for c in ("low", "high", "gap_low", "gap_high", "words", "linked", "template")),
])
#: Order that no order equals, and a gap for occurrences in several gaps.
BROKEN, SEVERAL = -1, -2


class _Host:
    """What a task needs to know of a host's template."""

    def __init__(self, row: dict):
        self.root: set[int] = set()
        self.tag_class: dict[int, int] = {}
        self.word_class: dict[int, dict[int, int]] = {}
        self.order: dict[int, int] = {}
        for c in row["classes"] or []:
            if c["root"]:
                self.root.update(c["tokens"])
                self.root_id = c["id"]
            elif c["scope"] == 0:
                self.tag_class.update((t, c["id"]) for t in c["tokens"])
            else:
                self.word_class.setdefault(c["scope"], {}).update((t, c["id"]) for t in c["tokens"])


def _gaps(page: markup.Page, root: set[int]) -> list[int]:
    """For every number of tags before it the last root token there (0 for none)."""
    gaps, last = [0], 0
    for t in page.tags:
        last = t if t in root else last
        gaps.append(last)
    return gaps


def _order(found: list[int]) -> int:
    """Hash of the order in which a class's tokens repeat; ``BROKEN`` if they come in no one order."""
    period = len(set(found))
    first = found[:period]
    if len(set(first)) < period or len(found) % period or any(found[i : i + period] != first for i in range(period, len(found), period)):
        return BROKEN
    return xxhash.xxh3_64_intdigest(np.array(first, np.int64).tobytes()) >> 1


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, of a task's pages: order and gaps of each class, and words of each slot (gap and path)."""
    for batch in chunks(batches, budget=4_000_000, column="page"):
        hosts: dict[str, _Host] = {}
        orders: dict[tuple, list] = {}
        slots: dict[tuple, list] = {}
        templates = batch.column("classes")
        for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), _pages(batch))):
            if host not in hosts:
                hosts[host] = _Host({"classes": templates[i].as_py()})
            known = hosts[host]
            gaps = _gaps(page, known.root)
            found: dict[int, list[int]] = {}
            inside: dict[int, set[int]] = {}
            for at, t in enumerate(page.tags):
                if t in known.root:
                    found.setdefault(known.root_id, []).append(t)
                elif (c := known.tag_class.get(t)) is not None:
                    found.setdefault(c, []).append(t)
                    inside.setdefault(c, set()).add(gaps[at])
            for block in page.blocks:
                place, template = block.place, 0
                words = known.word_class.get(place.path)
                if words:
                    for w in block.words:
                        t = markup.word_token(place.path, w)
                        if (c := words.get(t)) is not None:
                            found.setdefault(c, []).append(t)
                            inside.setdefault(c, set()).add(gaps[block.tag])
                            template += 1
                slot = slots.setdefault((host, gaps[block.tag], place.path, place.zone), [0, 0, 0])
                slot[0] += len(block.words)
                slot[1] += block.linked
                slot[2] += template
            for c, tokens in found.items():
                order, gap = _order(tokens), inside.get(c, {0})
                gap = next(iter(gap)) if len(gap) == 1 else SEVERAL
                now = orders.setdefault((host, c), [order, order, gap, gap])
                now[:] = min(now[0], order), max(now[1], order), min(now[2], gap), max(now[3], gap)
        rows = [(host, c, None, None, None, *o, None, None, None) for (host, c), o in orders.items()]
        rows += [(host, None, gap, path, zone, None, None, None, None, *sums) for (host, gap, path, zone), sums in slots.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FACT)], schema=_FACT)


def widths(found: DataFrame) -> DataFrame:
    """``found`` with ``width``: into how many parts a host's pages are dealt, in proportion to them and 4 x partitions in all."""
    total = found.agg(F.sum("n")).head()[0] or 1
    return found.withColumn("width", F.ceil(F.col("n") * (4 * partitions(found.sparkSession)) / F.lit(float(total))).cast("int"))


def dealt_to(pages: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``packed`` pages with their host's row of ``table``, dealt by host and part in one exchange that all passes share.

    ``hot`` are the hosts dealt into more than one part.
    """
    # Widths add up to 4 x partitions besides their rounding, so no more hosts than that have one above 1.
    parts = pages.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod("deal", F.coalesce("width", F.lit(1)))).drop("width", "deal")
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1))).drop("width")
    return parts.join(copies, ["host", "part"], "left")


def deduce(pages: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """host, width, root (tokens of the valid root class), fixed (word tokens of valid classes), best: container of the main text.

    ``best`` holds the slot with most words that are neither linked nor template text.
    Words are fixed only where the template is less than half of the text in the
    host's main zone, so pages that are copies of each other keep theirs.
    """
    facts = dealt_to(pages, found, hot).mapInArrow(_facts, FACT)
    # One chain of aggregates without branches, so pages are read and dealt once for them.
    low, high = ([f(c).alias(c) for c in names] for f, names in ((F.min, ("low", "gap_low")), (F.max, ("high", "gap_high"))))
    sums = [F.sum(c).alias(c) for c in ("words", "linked", "template")]
    facts = facts.groupBy("host", "class", "gap", "path", "zone").agg(*low, *high, *sums)
    ordered = (F.col("low") == F.col("high")) & (F.col("low") != BROKEN)
    nested = (F.col("gap_low") == F.col("gap_high")) & (F.col("gap_low") != SEVERAL)
    own = F.when(F.col("path").isNotNull(), F.struct((F.col("words") - F.col("linked") - F.col("template")).alias("own"), "path"))
    zones = (markup.PLAIN, markup.MAIN, markup.ARTICLE)
    differ = [F.sum(F.when(F.col("zone") == z, F.col("words") - 2 * F.col("template"))).alias(f"zone{z}") for z in zones]
    by_host = facts.groupBy("host").agg(F.collect_set(F.when(ordered & nested, F.col("class"))).alias("valid"), F.max(own)["path"].alias("best"), *differ)
    both = found.join(by_host, "host", "left").withColumn("differ", F.coalesce(*(F.col(f"zone{z}") for z in reversed(zones))) > 0)

    def tokens(keep) -> Column:
        good = F.filter("classes", lambda c: keep(c) & F.array_contains("valid", c["id"]))
        return F.coalesce(F.flatten(F.transform(good, lambda c: c["tokens"])), F.array().cast("array<long>"))

    fixed = F.when(F.col("differ"), tokens(lambda c: c["scope"] != 0)).otherwise(F.array().cast("array<long>"))
    return both.select("host", "width", tokens(lambda c: c["root"]).alias("root"), fixed.alias("fixed"), "best")


# ------------------------------------------------------------ slots

TEXT = "page_id {id}, url string, text string, n_chars long"


def main_blocks(page: markup.Page, root: set[int], fixed: set[int], best: int | None) -> Iterator[str]:
    """The blocks of a page's main text, in order.

    The innermost zone of the page (article, else main, else all) counts.  Without
    either, slots of mostly linked words go, and where the host's best container is on
    the page, slots outside it.  Blocks that are template text throughout go.
    """
    zone = max((b.place.zone for b in page.blocks), default=markup.PLAIN)
    blocks = [b for b in page.blocks if b.place.zone == zone]
    if zone == markup.PLAIN:
        gaps = _gaps(page, root)
        slots: dict[tuple, list[int]] = {}
        for b in blocks:
            sums = slots.setdefault((gaps[b.tag], b.place.path), [0, 0])
            sums[0] += b.linked
            sums[1] += len(b.words)
        blocks = [b for b in blocks if (s := slots[gaps[b.tag], b.place.path])[0] < s[1] * LINKED]
        inside = [b for b in blocks if best in b.place.lineage]
        blocks = inside or blocks
    for b in blocks:
        if not fixed or any(markup.word_token(b.place.path, w) not in fixed for w in b.words):
            yield " ".join(b.words)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, budget=4_000_000, column="page"):
        hosts: dict[str, tuple] = {}
        texts = []
        for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), _pages(batch))):
            if host not in hosts:
                root, fixed, best = (batch.column(c)[i].as_py() for c in ("root", "fixed", "best"))
                hosts[host] = set(root or ()), set(fixed or ()), best
            texts.append("\n".join(main_blocks(page, *hosts[host])))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``: the blocks of the main text, joined by one line feed.

    A null or empty page has an empty text; a null URL is a host of its own, as is a
    URL without one.  Equal rows get equal texts each.  Pages of any length are read
    as a whole.  A host with one page has its tags alone as template.  An empty table
    gives no rows; other columns are not read.
    """
    rows = keyed(pages, id_col, url_col, html_col)
    found = stage_table(widths(stage_table(classes(rows, min_pages), "template-classes")), "template-widths")
    hot = found.filter("width > 1").select("host", "width")
    rest = packed(rows)
    return dealt_to(rest, deduce(rest, found, hot), hot).mapInArrow(_texts, TEXT.format(id=dict(rest.dtypes)["page_id"]))
