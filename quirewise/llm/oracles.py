"""DuckDB SQL with the results of the numbered queries, where SQL can express them."""

W = "[^\\x20\\x09-\\x0D]+"
WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (SELECT *, translate(trim(line, {WS}), {UP}) AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, bad.k IS NOT NULL AS gone FROM keyed LEFT JOIN bad USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op10_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {WS})) > 0) AS l,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(w, ''), '[^\\p{{L}}]+', '', 'g')) AS n_alpha
  FROM d LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, greatest(n_words, 1) AS n FROM m
), bits AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (n_symbols / n > 0.3)::BIGINT
    + 8 * (word_chars / n < 2)::BIGINT + 16 * (word_chars / n > 25)::BIGINT
    + 32 * (100 * n_dup_lines > 50 * greatest(n_lines, 1))::BIGINT + 64 * (100 * n_alpha < 30 * word_chars)::BIGINT
    + 128 * (n_symbols / n > 0.1)::BIGINT AS failed_bits
  FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits & 127 = 0 AS kept, failed_bits
FROM bits
"""


def _tree(name: str, leaves: str, levels: int = 9) -> str:
    """Levels ``name``0.. of the trees over ``leaves`` (g, i, h, n), and ``name``_runs: the children of every node by level."""
    parts = [f"{name}0 AS (SELECT g, i, h, n FROM {leaves})"]
    for k in range(levels):
        parts.append(f"{name}r{k} AS (SELECT g, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY g, i // 8)")
        up = "CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END"
        parts.append(f"{name}{k + 1} AS (SELECT g, run AS i, {up} AS h, (n + 7) // 8 AS n FROM {name}r{k})")
    return ", ".join(parts)


def _way(name: str, start: str, levels: int = 9) -> str:
    """``name``w{levels}: rows of ``start`` (key, g, i, shown, proof) with the siblings of all levels added and the shown digest folded."""
    parts, before = [], start
    for k in range(levels):
        at, run = f"w.i // {8**k} % 8", f"w.i // {8 ** (k + 1)}"
        rest = f"list_concat(r.hs[:{at}], r.hs[{at} + 2:])"
        fold = f"sha256(array_to_string(list_concat(list_concat(r.hs[:{at}], [w.shown]), r.hs[{at} + 2:]), ''))"
        parts.append(
            f"{name}w{k} AS (SELECT w.key, w.g, w.i, CASE WHEN r.n = 1 THEN w.shown ELSE {fold} END AS shown,"
            f" CASE WHEN r.n = 1 THEN w.proof ELSE w.proof || array_to_string({rest}, '') END AS proof"
            f" FROM {before} w JOIN {name}r{k} r ON w.g IS NOT DISTINCT FROM r.g AND {run} = r.run)"
        )
        before = f"{name}w{k}"
    return ", ".join(parts)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)

ORACLES["op11_merkle_manifest"] = f"""
WITH l AS (
  SELECT doc_id, lang, sha256({" || ".join([*_LEAF, _field("text")])}) AS h,
         CASE WHEN {_CRC} % 3 = 0 THEN sha256({" || ".join([*_LEAF, _field(f"translate(text, {UP})")])}) END AS changed
  FROM documents
), leaves AS (
  SELECT *, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l
), {_tree("a", "leaves")}, subroots AS (
  SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM a9
), {_tree("b", "subroots")}, start AS (
  SELECT {{'doc_id': doc_id, 'h': h, 'i': i}} AS key, g, i, coalesce(changed, h) AS shown, '' AS proof FROM leaves
), {_way("a", "start")}, crossing AS (
  SELECT {{'k': w.key, 'lang': w.g}} AS key, s.g, s.i, w.shown, w.proof FROM aw8 w JOIN subroots s ON w.g IS NOT DISTINCT FROM s.lang
), {_way("b", "crossing")}
SELECT w.key.k.doc_id AS doc_id, w.key.k.h AS leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256,
       w.shown AS folded_root, w.shown = r.h AS verified
FROM bw8 w JOIN subroots s ON w.key.lang IS NOT DISTINCT FROM s.lang, b9 r
"""


def _codes(rounds: int = 6) -> str:
    distance = "list_sum(list_transform(range(1, 9), lambda j: (p.v[j] - c.v[j]) * (p.v[j] - c.v[j])))"
    near = (
        "SELECT p.vec_id, p.label, p.part, p.v, min(({d})::HUGEINT * 16 + c.entry) AS m FROM parts p JOIN {book} c USING (part) GROUP BY ALL"
    )
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({near.format(d=distance, book=f'book{k}')})")
        steps.append(
            f"sums{k} AS (SELECT part, (m % 16)::INT AS entry, j, sum(v[j])::HUGEINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 9)) AS j) GROUP BY ALL)"
        )
        steps.append(f"means{k} AS (SELECT part, entry, list({floor} ORDER BY j) AS v FROM sums{k} GROUP BY part, entry)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry))")
    steps.append(f"near{rounds} AS MATERIALIZED ({near.format(d=distance, book=f'book{rounds}')})")
    return ", ".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[8 * part + 1 : 8 * part + 8] AS v FROM kept, (SELECT unnest(range(8)) AS part)
), seeds AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, v FROM kept ORDER BY vec_id LIMIT 16),
book0 AS (SELECT part, entry, v[8 * part + 1 : 8 * part + 8] AS v FROM seeds, (SELECT unnest(range(8)) AS part)),
{_codes()},
rows AS (
  SELECT vec_id, label, string_agg('0' || substr('0123456789abcdef', (m % 16)::INT + 1, 1), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error
  FROM near6 GROUP BY vec_id, label
), sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, sha
"""

#: The result on the markup of the given pages, whose hosts all have one article element a page.
ORACLES["op13_main_text"] = """
WITH a AS (
  SELECT page_id, url, html,
         unnest(string_split(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>', chr(1), 'g'), chr(1))) AS b,
         generate_subscripts(string_split(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>', chr(1), 'g'), chr(1)), 1) AS i
  FROM pages
), t AS (
  SELECT page_id, url, html, i, trim(regexp_replace(regexp_replace(replace(
    regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS b FROM a
), j AS (
  SELECT page_id, url, html, coalesce(string_agg(b, chr(10) ORDER BY i) FILTER (b <> ''), '') AS text FROM t GROUP BY page_id, url, html
)
SELECT page_id, url, text, length(text) AS n_chars FROM j
"""
