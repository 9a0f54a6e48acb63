"""J9 with the words in a table: which of many words a text holds, in one pass over it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and characters that an automaton may have; it goes to every task.
MAX_WORDS, MAX_CHARS = 200_000, 4_000_000
BYTES_AT_ONCE = 8_000_000


def automaton(words: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> bytes:
    """The words of ``words`` (word_no, word) as a packed Aho-Corasick automaton.

    Null and empty words match nothing.  A word listed under several numbers has
    the smallest.  More words or characters than stated raise ValueError, before
    any word reaches the driver.
    """
    rows = words.filter("word <> ''").groupBy("word").agg(F.min("word_no").alias("word_no"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).head()
    if size["n"] > max_words or size["chars"] > max_chars:
        raise ValueError(f"{size['n']} words of {size['chars']} characters; at most {max_words} of {max_chars} go into one automaton")
    built = ahocorasick.Automaton()
    for r in rows.collect():
        built.add_word(r["word"], (r["word_no"], len(r["word"])))
    built.make_automaton()
    return pickle.dumps(built)


HIT = "array<struct<word_no:long,n:long,at:long>>"
_HIT = pa.list_(pa.struct([("word_no", pa.int64()), ("n", pa.int64()), ("at", pa.int64())]))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut so that each part has some megabytes of text."""
    start = size = 0
    for i, t in enumerate(batch.column("text")):
        size += len(t.as_py() or "")
        if size >= BYTES_AT_ONCE:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def find_words(texts: DataFrame, words: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``texts`` (any columns, one of them ``text``) with ``found`` in place of the text.

    ``found`` has an entry per distinct word in the text, by ``word_no``: how often it
    stands there, overlaps included, and the place of the first (code points from 0).
    The cost of a text is its length and its hits, whatever the number of words.
    Null and empty texts have none; no text is shuffled.
    """
    shared = texts.sparkSession.sparkContext.broadcast(automaton(words, max_words, max_chars))
    others = [c for c in texts.columns if c != "text"]
    # Numbers for names, as names of any kind can't be handed to the function.
    numbered = texts.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = pickle.loads(shared.value)
        for whole in batches:
            for batch in _slices(whole):
                found = []
                for text in batch.column("text"):
                    hits: dict[int, list[int]] = {}
                    for end, (word_no, length) in built.iter(text.as_py() or "") if len(built) else ():
                        hit = hits.setdefault(word_no, [0, end - length + 1])
                        hit[0] += 1
                        hit[1] = min(hit[1], end - length + 1)
                    found.append([{"word_no": w, "n": n, "at": at} for w, (n, at) in sorted(hits.items())])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(found, _HIT)], names=names)

    names = [*(f"c{i}" for i in range(len(others))), "found"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(names, [*(t for c, t in texts.dtypes if c != "text"), HIT]))
    return numbered.mapInArrow(of, schema).toDF(*others, "found")


def subjects_by_table(page_texts: DataFrame, words: DataFrame) -> DataFrame:
    """A6 with subjects of a table: (book_id, subject) by texts (book_id, page, seq, text) and words (word_no, word, subject).

    The subject whose words stand in most texts of the book; a text counts once for a
    subject, a tie goes to the one met first by page, text and number of the word.
    Several words may stand for one subject.
    """
    found = find_words(page_texts.select("book_id", "page", "seq", "text"), words)
    hits = found.select("book_id", "page", "seq", F.explode(F.col("found.word_no")).alias("word_no"))
    # As many rows as the automaton has words at most.
    named = words.filter("word <> ''").groupBy("word").agg(F.min(F.struct("word_no", "subject")).alias("w")).select("w.*")
    hits = hits.join(named, "word_no")
    by_text = hits.groupBy("book_id", "page", "seq", "subject").agg(F.min("word_no").alias("word_no"))
    counts = by_text.groupBy("book_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "seq", "word_no")).alias("first"))
    rank = F.struct("n", -F.col("first.page"), -F.col("first.seq"), -F.col("first.word_no"))
    return counts.groupBy("book_id").agg(F.max_by("subject", rank).alias("subject"))
