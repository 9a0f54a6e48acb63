"""Byte-level BPE through a sentencepiece model written directly from a vocabulary.

Every byte is mapped to one printable character, every token to the string of
its mapped bytes, and its score is the negative rank; sentencepiece then merges
the pair with the best score, which is the pair with the lowest rank.  The
model has an identity normaliser and no space handling, and is serialised by
hand (protocol-buffer wire format), so nothing is trained.  Texts are cut into
pre-tokens first; ids turn back into bytes by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from quirewise.llm.common import chunks, doc_rows

#: Fixed values of the model format: piece types and model kind.
NORMAL, UNKNOWN, CONTROL = 1, 2, 3
BPE_MODEL = 2
#: Where the marked last character of a word lives (see :class:`WordBpe`).
END_OFFSET = 0x4E00


def byte_chars() -> list[str]:
    """A printable character for every byte: itself where it is visible, else from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


# ------------------------------------------------------------ the model file


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(pieces: Iterable[tuple[str, float, int]]) -> bytes:
    """A BPE model with these (piece, score, type), ids in order; identity normaliser, no added spaces."""
    pieces = list(pieces)
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in pieces)
    unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
    minus_one = (1 << 64) - 1
    trainer = _field(3, BPE_MODEL) + _field(40, unknown) + b"".join(_field(n, minus_one) for n in (41, 42, 43))
    trainer += _field(4, len(pieces)) + _field(22, 0) + _field(24, 0)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


def processor(pieces: Iterable[tuple[str, float, int]]) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(pieces))


def _le32(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Cached:
    """Pre-token to the bytes of its ids (little-endian unsigned 32 bit), for a bounded number of them."""

    bound = 600_000
    longest = 64

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def lookup(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens, joined.

        Only unknown pre-tokens reach the model, each once.
        """
        if len(self.known) > self.bound:  # what came first is what is frequent: keep that half
            self.known = dict(islice(self.known.items(), self.bound // 2))
        known = self.known
        get = known.get
        found = [list(map(get, parts)) for parts in lists]
        holes = [i for i, ids in enumerate(found) if None in ids]
        new = list({p for i in holes for p, ids in zip(lists[i], found[i]) if ids is None})
        fresh: dict[str, bytes] = {}
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            fresh.update(zip(some, self._encode(some)))
        for i in holes:
            found[i] = [fresh[p] if ids is None else ids for p, ids in zip(lists[i], found[i])]
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= self.longest)
        return [b"".join(ids) for ids in found]


class ByteBpe(_Cached):
    """Ranks of a tiktoken file as a sentencepiece model."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_chars()
        self.table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        names = {rank: "".join(chars[b] for b in token) for token, rank in ranks.items()}
        size = max(names) + 1
        rows = [(names[i], -float(i), NORMAL) if i in names else (f"<unused{i}>", 0.0, CONTROL) for i in range(size)]
        self.model = processor([*rows, ("<unk>", 0.0, UNKNOWN)])
        self.bytes_of = [bytes(back[c] for c in names[i]) if i in names else b"" for i in range(size)]
        # The white space of the pattern is Unicode's; the separators U+001C to U+001F are not in it.
        pattern = pattern.replace("[^\\s", "[^\\p{White_Space}").replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}")
        self.split = regex.compile(pattern).findall

    def _encode(self, parts: list[str]) -> list[bytes]:
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in parts]
        return [_le32(ids) for ids in self.model.encode(mapped, out_type=int, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for an empty text."""
        return self.lookup([self.split(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class WordBpe(_Cached):
    """The vocabulary with word ends (``word_bpe_49k.json``) as a sentencepiece model.

    A token that ends a word has its last character moved to a block of its
    own, so a word end is part of the merges.  A chunk between white space is
    encoded by itself: the vocabulary drops white space and no pre-token crosses it.
    Chunks with characters beyond Latin Extended-B go to the ``tokenizers``
    library, which knows their normalisation best.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = sorted(model["vocab"].items(), key=lambda x: x[1])
        score = {"".join(pair): -float(i) for i, pair in enumerate(model["merges"])}
        chars = byte_chars()
        self.table = {b: c for b, c in enumerate(chars) if b not in (10, 32)}
        self.end = {c: chr(ord(c) + END_OFFSET) for c in chars}

        def name(token: str) -> str:
            body = token.removesuffix("</w>")
            return body if body == token else body[:-1] + self.end[body[-1]]

        base = {*chars, *(c + "</w>" for c in chars)}
        rows = [(name(t), score.get(t, -1e6), NORMAL) if t in score or t in base else (t, 0.0, CONTROL) for t, _ in vocab]
        assert [i for _, i in vocab] == list(range(len(vocab)))
        self.model = processor([*rows, ("<unk>", 0.0, UNKNOWN)])
        white = "\\p{White_Space}"
        self.split = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{white}\\p{{L}}\\p{{N}}]+|\\n").findall
        self.chunk = regex.compile(f"\\P{{White_Space}}+").findall

    def _encode(self, parts: list[str]) -> list[bytes]:
        out, simple, at = [b""] * len(parts), [], []
        for i, part in enumerate(parts):
            if part.isascii():
                simple.append(part.lower())
            elif max(part) < "ɐ":
                simple.append("".join(map(str.lower, unicodedata.normalize("NFC", part))))
            else:
                out[i] = _le32(self.library.encode(part, add_special_tokens=False).ids)
                continue
            at.append(i)
        # Words of all chunks at once, a line end between the chunks.
        words = " ".join(self.split("\n".join(simple))).encode("utf-8").decode("latin-1").translate(self.table).split(" ")
        end, n, owner, marked = self.end, 0, [], []
        for w in words:
            if w == "\n":
                n += 1
            elif w:
                owner.append(n)
                marked.append(w[:-1] + end[w[-1]])
        for n, ids in zip(owner, self.model.encode(marked, out_type=int, num_threads=1) if marked else ()):
            out[at[n]] += _le32(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for an empty text."""
        return self.lookup([self._chunks(t) for t in texts])

    def _chunks(self, text: str) -> list[str]:
        """``str.split``, but for the separators U+001C to U+001F, which are no white space to the vocabulary."""
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return self.chunk(text) if odd else text.split()


_LOADED: dict[tuple, _Cached] = {}


def codec(kind: str, path: str, *args) -> _Cached:
    """One codec per Python worker; its cache goes on from task to task."""
    key = (kind, path, *args)
    if key not in _LOADED:
        _LOADED[key] = {"byte": ByteBpe, "word": WordBpe}[kind](path, *args)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bit), ids_sha256, decoded_sha256.

    ``path`` is a tiktoken rank file that every executor can read.  A null or
    empty text has no ids; equal ids or texts stay separate rows; other columns
    are not read.  Without ``keep_ids`` the column ``ids`` is left out.
    """
    schema = "doc_id long, n_tokens long, " + "ids binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec("byte", path, pattern)
        for batch in chunks(batches, 2_000_000):
            ids = bpe.encode(batch.column("text").to_pylist())
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }
            yield pa.RecordBatch.from_pydict({k: v for k, v in cols.items() if keep_ids or k != "ids"})

    return doc_rows(docs).mapInArrow(of, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of a table with doc_id and ids; bytes that are no UTF-8 become U+FFFD, null ids null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec("byte", path, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")
