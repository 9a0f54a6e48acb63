"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans.  The field is trained here from the small
labelled table below, over word shapes, and finds what patterns can't say:
numbers and addresses in other notations, told by the words and signs around
them.  It decodes by Viterbi in numpy, many windows at a time.  Its spans are
added where they touch no base span and hold enough digits or parts; base spans
always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirewise.llm.common import chunks, doc_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ------------------------------------------------------------ base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so longer runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """From every @ to the left over the local part, to the right over the domain: linear at any length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost spans of each kind; matches that fail their test are dropped and not tried again."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT(text):
        out["ip"] = [m.span() for m in _IP(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD(text):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ------------------------------------------------------------ the labelled table

#: Sentences with [kind:span] marks, and sentences of numbers that are no one's.
LABELLED = (
    "call me at [phone:(415) 555-0132] tomorrow",
    "tel. [phone:415-555-0132] or write",
    "phone: [phone:415.555.0132].",
    "Telefon [phone:030 5550 1234] bitte anrufen",
    "mobile [phone:07700 900 123], thanks",
    "tel: [phone:01 55 50 12 34] le matin",
    "teléfono [phone:91 555 01 23] por la tarde",
    "fax [phone:(030) 555-01234] und post",
    "ring [phone:555-0132] after noon",
    "call [phone:800 555 0199] now",
    "phone number is [phone:(212) 555 0147] here",
    "mail [email:jane at example dot com] please",
    "write to [email:jane dot doe at example dot org] soon",
    "email: [email:info (at) example (dot) net] for more",
    "contact [email:sales [at] example [dot] com] today",
    "E-Mail [email:max at beispiel dot de] schreiben",
    "courriel [email:marie (at) exemple (dot) fr] merci",
    "[email:bob at mail dot example dot com]",
    "card [card:3782 822463 10005] expires",
    "Amex [card:378282246310005] was charged",
    "card number [card:3056 930902 5904] on file",
    "pay with card: [card:30569309025904].",
    "server [ip:10 . 0 . 0 . 12] is down",
    "host ip [ip:192[.]168[.]1[.]20] blocked",
    "address [ip:203[.]0[.]113[.]9] seen",
    "version 3. of the license, 2.0 or later",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "in 1998 and 2004 there were 12 of 300",
    "the price is 1,250.00 for 3 items",
    "pages 12-34 and 56-78, chapter 9",
    "on 2021-03-04 at 10:30 we met",
    "on 12.03.2021 at the station",
    "serial 9807915762804490 of the part",
    "order 2390409500648960 was shipped",
    "token = 9233 and key 4455 of 20",
    "meet at noon at the dot on the map",
    "look at this at once and at that",
    "the dot com years, 1999 to 2001",
    "section 4.1.2 of 5.6 and 7",
    "a score of 21-14 and 3 : 2",
    "call him at 5 or at 6 today",
    "card 12 of 52 and number 7",
    "it rained 20 mm at 18 degrees",
    'token = "592e2677e7e6567f917b8c3d" and more',
    'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! X',
    "room 101, floor 12, house 7 - 9",
    "ratio 3.14159 and 2.71828 hold",
    "model 4000 1200 series and 5",
    "year 2020 2021 2022 2023 report",
    "[phone:555-0199] is my phone",
    "Call us: [phone:(800) 555-0147]",
    "tel [phone:0161 496 0123].",
)

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S).finditer
#: Words that say what follows.
CUES = {
    w: kind
    for kind, words in {
        "call": "call phone tel telefon telefono teléfono mobile fax ring téléphone telephone number",
        "mail": "mail email courriel write contact correo e",
        "at": "at",
        "dot": "dot",
        "card": "card amex visa karte carte tarjeta",
        "ip": "ip host server address",
        "not": "version license order serial page pages year in on section token chapter",
    }.items()
    for w in words.split()
}


def shape(token: str) -> str:
    """Digits by their number, letters by case or by what they announce, signs as they are."""
    if token[0].isdecimal():
        return f"d{min(len(token), 20)}"
    if token[0].isspace():
        return "_" if token == " " else "__"
    if token[0].isalpha():
        cue = CUES.get(token.lower())
        return f"w:{cue}" if cue else "W" if token.isupper() else "Ww" if token[0].isupper() else "w"
    return token


class Field:
    """Weights of (place, shape) per label and of label pairs; places are the tokens from -4 to +4."""

    reach = 4

    def __init__(self, rows: tuple[str, ...] = LABELLED, rounds: int = 250, rate: float = 0.1, decay: float = 1e-3):
        data = [self._labelled(r) for r in rows]
        shapes = sorted({s for tokens, _ in data for s in tokens})
        self.ids = {s: i + 2 for i, s in enumerate(shapes)}  # 0: beyond the ends, 1: unknown
        n, labels = len(self.ids) + 2, len(LABELS)
        self.emit = np.zeros((2 * self.reach + 1, n, labels))
        self.move = np.zeros((labels, labels))
        # An inside label follows its own beginning or inside only.
        self.allowed = np.array([[0.0 if not b.startswith("I") or a[2:] == b[2:] else -1e4 for b in LABELS] for a in LABELS])
        self.start = np.array([-1e4 if b.startswith("I") else 0.0 for b in LABELS])
        width = max(len(t) for t, _ in data)
        x = np.stack([self._places([self.ids[s] for s in t], width) for t, _ in data])
        y = np.zeros((len(data), width), int)
        mask = np.zeros((len(data), width), bool)
        for i, (tokens, gold) in enumerate(data):
            y[i, : len(gold)], mask[i, : len(gold)] = gold, True
        self._fit(x, y, mask, rounds, rate, decay)

    @staticmethod
    def _labelled(row: str) -> tuple[list[str], list[int]]:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[[^\]:]*\])+)\]", row):
            text += row[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        text += row[at:]
        tokens, gold = [], []
        for m in _TOKENS(text):
            tokens.append(shape(m.group()))
            inside = next((s for s in spans if s[0] <= m.start() < s[1]), None)
            gold.append(0 if inside is None else LABELS.index(("B-" if m.start() == inside[0] else "I-") + inside[2]))
        return tokens, gold

    def _places(self, ids: list[int], width: int) -> np.ndarray:
        """Shape ids around every token: width rows of 2 * reach + 1."""
        padded = np.zeros(width + 2 * self.reach, int)
        padded[self.reach : self.reach + len(ids)] = ids
        return np.lib.stride_tricks.sliding_window_view(padded, 2 * self.reach + 1)[:width]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][x[..., k]] for k in range(self.emit.shape[0]))

    def _fit(self, x, y, mask, rounds, rate, decay):
        """Gradient ascent (Adam) on the conditional likelihood, by forward and backward sums."""
        params = [self.emit, self.move]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n, width = y.shape
        lengths = mask.sum(axis=1)
        onehot = np.eye(len(LABELS))[y] * mask[..., None]
        pairs = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
        log = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        for step in range(1, rounds + 1):
            e, t = self.scores(x), self.move + self.allowed
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = self.start + e[:, 0]
            for i in range(1, width):
                a[:, i] = np.where(mask[:, i, None], log(a[:, i - 1, :, None] + t, 1) + e[:, i], a[:, i - 1])
            for i in range(width - 2, -1, -1):
                b[:, i] = np.where(mask[:, i + 1, None], log(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
            z = log(a[np.arange(n), lengths - 1], 1)
            single = np.exp(a + b - z[:, None, None]) * mask[..., None]
            double = a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
            double = (np.exp(np.minimum(double, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            grads = [np.zeros_like(self.emit), pairs - double]
            for k in range(self.emit.shape[0]):
                np.add.at(grads[0][k], x[..., k].ravel(), (onehot - single).reshape(-1, len(LABELS)))
            for p, g, m, v in zip(params, grads, first, second):
                g = g / n - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each window of shapes; windows of like length share a numpy batch."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(windows)
        long = [i for i in range(len(windows)) if len(windows[i]) > LONGEST]
        for i, labels in zip(long, self._decode_long([windows[i] for i in long])):
            out[i] = labels
        order = sorted((i for i in range(len(windows)) if 0 < len(windows[i]) <= LONGEST), key=lambda i: len(windows[i]))
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            lengths = np.array([len(windows[i]) for i in some])
            width = int(lengths.max())
            x = np.stack([self._places([self.ids.get(s, 1) for s in windows[i]], width) for i in some])
            e, t = self.scores(x), self.move + self.allowed
            best, back = self.start + e[:, 0], np.zeros(e.shape, np.int8)
            last = best.copy()
            for i in range(1, width):
                ways = best[:, :, None] + t
                back[:, i] = ways.argmax(axis=1)
                best = ways.max(axis=1) + e[:, i]
                last = np.where((lengths > i)[:, None], best, last)
            label = last.argmax(axis=1)
            path = np.zeros((len(some), width), int)
            for i in range(width - 1, -1, -1):
                inside = i < lengths
                path[inside, i] = label[inside]
                label = np.where(inside, back[np.arange(len(some)), i, label], label)
            for row, i in enumerate(some):
                out[i] = path[row, : lengths[row]]
        return out

    def _decode_long(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of windows of any length, each decoded as one sequence.

        Blocks of ``BLOCK`` tokens go through numpy side by side: first the best
        scores from every first to every last label of a block, which carry the
        scores over the block's ends, then Viterbi in every block from those.
        """
        t, labels = self.move + self.allowed, len(LABELS)
        places, block_of, first_of = [], [], []
        for w in windows:
            blocks = -(-len(w) // BLOCK)
            first_of.append(len(block_of))
            places.append(self._places([self.ids.get(s, 1) for s in w], blocks * BLOCK))
            block_of += [(len(places) - 1, b * BLOCK, min(BLOCK, len(w) - b * BLOCK)) for b in range(blocks)]
        first_of.append(len(block_of))

        def groups() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for at in range(0, len(block_of), 256):
                some = block_of[at : at + 256]
                x = np.stack([places[w][begin : begin + BLOCK] for w, begin, _ in some])
                yield at, self.scores(x), np.array([size for _, _, size in some])

        across = np.empty((len(block_of), labels, labels))
        for at, e, sizes in groups():
            best = np.where(np.eye(labels, dtype=bool), e[:, 0, None, :], -np.inf)
            for i in range(1, int(sizes.max())):
                ways = best[:, :, 0, None] + t[0]
                for k in range(1, labels):
                    np.maximum(ways, best[:, :, k, None] + t[k], out=ways)
                best = np.where((sizes > i)[:, None, None], ways + e[:, i, None, :], best)
            across[at : at + len(sizes)] = best
        enter, leave = np.empty((len(block_of), labels)), np.empty((len(block_of), labels))
        for a, b in zip(first_of, first_of[1:]):
            for k in range(a, b):
                enter[k] = self.start if k == a else (leave[k - 1][:, None] + t).max(axis=0)
                leave[k] = (enter[k][:, None] + across[k]).max(axis=0)
        # The path through each block for every label at its end.
        paths = np.zeros((len(block_of), BLOCK, labels), np.int8)
        for at, e, sizes in groups():
            best, back = enter[at : at + len(sizes)] + e[:, 0], np.zeros(e.shape, np.int8)
            for i in range(1, int(sizes.max())):
                ways = best[:, :, None] + t
                back[:, i] = ways.argmax(axis=1)
                best = ways.max(axis=1) + e[:, i]
            label = np.tile(np.arange(labels), (len(sizes), 1))
            for i in range(int(sizes.max()) - 1, -1, -1):
                inside = (i < sizes)[:, None]
                paths[at : at + len(sizes), i] = label
                label = np.where(inside, np.take_along_axis(back[:, i], label, axis=1), label)
        out = []
        for a, b in zip(first_of, first_of[1:]):
            parts, label = [], int(leave[b - 1].argmax())
            for k in range(b - 1, a - 1, -1):
                parts.append(paths[k, : block_of[k][2], label].astype(int))
                if k > a:
                    label = int((leave[k - 1] + t[:, parts[-1][0]]).argmax())
            out.append(np.concatenate(parts[::-1]))
        return out


# ------------------------------------------------------------ windows of a text

_TRIGGER = re.compile(r"[0-9]+|\bdot\b|\(at\)|\[at\]", re.I).finditer
NEAR = 40
#: Windows of more tokens are decoded in blocks side by side, with scores carried over the blocks' ends.
LONGEST, BLOCK = 400, 128


def windows_of(text: str) -> list[list[tuple[str, int, int]]]:
    """Tokens (text, start, end) around all digits and spelled signs.

    Plain words further than ``NEAR`` characters from any of them are outside
    every span by definition.  A window holds a whole area, however long.
    """
    areas: list[list[int]] = []
    for m in _TRIGGER(text):
        if areas and m.start() - areas[-1][1] <= 2 * NEAR:
            areas[-1][1] = m.end()
        else:
            areas.append([m.start(), m.end()])
    out = []
    for lo, hi in areas:
        lo, hi = max(0, lo - NEAR), min(len(text), hi + NEAR)
        out.append([(m.group(), m.start(), m.end()) for m in _TOKENS(text, lo, hi)])
    return out


def _plausible(kind: str, text: str) -> bool:
    """What a span of the field has to hold beyond its labels."""
    digits = _digits(text)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and digits != text and not re.search(r"[^0-9 ()./-]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"\bat\b", text, re.I)) and bool(re.search(r"\bdot\b", text, re.I))


def field_spans(texts: list[str], field: Field) -> list[dict[str, list[Span]]]:
    """Spans the field labels in each text, without regard to base spans."""
    out: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    owners, windows, shapes = [], [], []
    for i, text in enumerate(texts):
        for w in windows_of(text):
            owners.append((i, False))
            windows.append(w)
            shapes.append([shape(t) for t, _, _ in w])
            if any(t == "DOT" for t, _, _ in w):  # spelled in capitals: once more as if in small letters
                owners.append((i, True))
                windows.append(w)
                shapes.append([shape(t.lower()) for t, _, _ in w])
    for (i, folded), tokens, labels in zip(owners, windows, field.decode(shapes)):
        known = sorted(s for spans in out[i].values() for s in spans) if folded else []
        at = 0
        while at < len(tokens):
            if labels[at] == 0:
                at += 1
                continue
            kind, end = LABELS[labels[at]][2:], at + 1
            while end < len(tokens) and LABELS[labels[end]] == f"I-{kind}":
                end += 1
            span = (tokens[at][1], tokens[end - 1][2])
            wanted = not folded or kind == "email" and not any(a < span[1] and span[0] < b for a, b in known)
            if wanted and _plausible(kind, texts[i][span[0] : span[1]]):
                out[i][kind].append(span)
            at = end
    for spans in out:
        spans["email"].sort()
    return out


def find_spans(texts: list[str], field: Field) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """Per text: base spans, and base spans with those of the field that touch none of them."""
    result = []
    for text, extra in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        taken = sorted(s for spans in base.values() for s in spans)
        free = {k: [s for s in spans if not any(a < s[1] and s[0] < b for a, b in taken)] for k, spans in extra.items()} if taken else extra
        result.append((base, {k: sorted(base[k] + free[k]) for k in KINDS}))
    return result


_FIELD: list[Field] = []


def trained_field() -> Field:
    """The field of :data:`LABELLED`; trained once per Python worker, always to the same weights."""
    if not _FIELD:
        _FIELD.append(Field())
    return _FIELD[0]


def spelled(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Offsets are code points, ends exclusive.  A null or empty text has no spans;
    equal ids stay separate rows; other columns are not read.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained_field()
        for batch in chunks(batches, 2_000_000):
            found = find_spans(batch.column("text").to_pylist(), field)
            cols = {"doc_id": batch.column("doc_id")}
            cols |= {f"n_{k}": pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS}
            cols["base_sha256"] = pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b, _ in found], pa.string())
            cols["spans"] = pa.array([spelled(a) for _, a in found], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return doc_rows(docs).mapInArrow(of, schema)


def mask_text(text: str, spans: dict[str, list[Span]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for begin, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; all columns and rows stay, a null text stays null."""
    from pyspark.sql import functions as F

    def masked(texts):
        import pandas as pd

        field, clean, values = trained_field(), [], [t if t is not None else "" for t in texts]
        ends, at = np.cumsum([len(t) for t in values]), 0
        while at < len(values):  # an Arrow batch may hold 10,000 texts of any length
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + 2_000_000, side="right")))
            clean += [mask_text(t, spans) for t, (_, spans) in zip(values[at:stop], find_spans(values[at:stop], field))]
            at = stop
        return pd.Series([None if t is None else c for t, c in zip(texts, clean)], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(masked, "string")(F.col(text_col)))
