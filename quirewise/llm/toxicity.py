"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the words of a text
and the probabilities of the categories before it.  For training these come
from out-of-fold models, so a later model learns from probabilities as honest as
those it will meet.  Models are small weight tables that travel to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.common import chunks, doc_rows

_WORD = re.compile(r"[^\W\d_]+").findall


def features(text: str) -> set[str]:
    """The distinct words of the whole text in lower case, and shapes of its signs."""
    words = set(_WORD(text.lower()))
    tokens = max(1, text.count(" ") + text.count("\n"))
    signs = sum(map(text.count, "#*$%&|<>"))
    words.add(f"<signs {min(4, 10 * signs // tokens)}>")
    words.add(f"<rest {min(9, 10 * len(words) // tokens)}>")
    return words


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """Logistic regression on word presence and a few dense inputs."""

    weights: dict[str, float] = field(default_factory=dict)
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    @classmethod
    def fit(cls, words: list[set[str]], dense: np.ndarray, y: np.ndarray, size: int = 400, rounds: int = 150, decay: float = 3e-3) -> Linear:
        """``size`` words with the largest signed chi statistic are used; gradient descent with momentum scaling."""
        out = cls(dense=np.zeros(dense.shape[1]))
        n, positive = len(y), float(y.sum())
        if n == 0 or positive in (0.0, float(n)):
            out.bias = float(_logit(np.array([(positive + 0.5) / (n + 1)]))[0])
            return out
        seen: dict[str, list[int]] = {}
        for i, bag in enumerate(words):
            for w in bag:
                seen.setdefault(w, []).append(i)
        names = sorted(w for w, at in seen.items() if len(at) >= max(4, n // 2000))
        total = np.array([len(seen[w]) for w in names], float)
        hits = np.array([y[seen[w]].sum() for w in names])
        expected = total * positive / n
        chi = (hits - expected) ** 2 / np.maximum(expected * (1 - total / n), 1e-9) / (1 - positive / n)
        names = [names[i] for i in np.lexsort((np.arange(len(names)), -chi))[:size]]
        x = np.zeros((n, len(names) + dense.shape[1]))
        for j, w in enumerate(names):
            x[seen[w], j] = 1
        x[:, len(names) :] = dense
        w, b = np.zeros(x.shape[1]), float(_logit(np.array([positive / n]))[0])
        gw, gb, m = np.zeros_like(w), 0.0, np.zeros_like(w)
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            g = x.T @ (p - y) / n + decay * w
            m = 0.9 * m + 0.1 * g
            gw = 0.99 * gw + 0.01 * g * g
            gb = float((p - y).mean())
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(gw / (1 - 0.99**step)) + 1e-8)
            b -= 1.0 * gb
        out.weights, out.dense, out.bias = dict(zip(names, w[: len(names)].tolist())), w[len(names) :], b
        return out

    def predict(self, words: list[set[str]], dense: np.ndarray) -> np.ndarray:
        known = self.weights.keys()
        z = np.array([sum(map(self.weights.__getitem__, known & bag)) for bag in words]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z + dense @ self.dense, -30, 30)))


@dataclass
class Chain:
    """One model per category, in order, and the threshold of each."""

    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]
    #: Out-of-fold probabilities of the training rows, NaN where a label is missing.
    held_out: np.ndarray

    @classmethod
    def fit(cls, texts: Sequence[str], labels: np.ndarray, categories: Sequence[str], folds: int = 5) -> Chain:
        """``labels``: rows by categories, 1, 0 or NaN.  Copies of a text share a fold, so none is its own judge.

        The threshold of a category is where its out-of-fold F1 is best.
        """
        words = [features(t) for t in texts]
        fold = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % folds for t in texts], int)
        n = len(texts)
        held, models, thresholds = np.zeros((n, len(categories))), [], []
        for c in range(len(categories)):
            dense = _logit(held[:, :c])
            known = ~np.isnan(labels[:, c])
            for f in range(folds):
                train, test = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
                model = Linear.fit([words[i] for i in train], dense[train], labels[train, c])
                held[test, c] = model.predict([words[i] for i in test], dense[test])
            train = np.flatnonzero(known)
            models.append(Linear.fit([words[i] for i in train], dense[train], labels[train, c]))
            thresholds.append(_best_threshold(held[train, c], labels[train, c]))
        return cls(tuple(categories), models, thresholds, held)

    def predict(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities, texts by categories; each is an input of those after it."""
        words = [features(t) for t in texts]
        out = np.zeros((len(texts), len(self.categories)))
        for c, model in enumerate(self.models):
            out[:, c] = model.predict(words, _logit(out[:, :c]))
        return out


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, midway to the next lower probability; 0.5 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    below = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float(np.clip((p[order[at]] + below) / 2, 0.05, 0.95))


#: Characters of all texts that a chain is fitted on.
MAX_CHARS = 64_000_000


def labelled_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``max_rows`` labelled documents, chosen by the hash of their id.

    ``categories`` maps a name to a SQL expression over ``labels`` that is 1, 0 or null.
    An id with several rows stands with one text, that of the smallest hash; in the
    order of the choice, documents count while their texts together have at most
    ``max_chars`` characters.  So the driver gets max_rows rows and max_chars
    characters at most, whatever the tables hold.
    """
    place = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = labels.filter("doc_id is not null").select("doc_id", *(F.expr(e).cast("double").alias(c) for c, e in categories.items()))
    picked = picked.dropDuplicates(["doc_id"]).orderBy(*place).limit(max_rows)
    # At most max_rows ids, so the texts stay where they are.
    texts = doc_rows(docs).join(F.broadcast(picked.select("doc_id")), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    total = F.sum(F.length("text")).over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.withColumn("_total", total).filter(F.col("_total") <= max_chars).drop("_total").join(picked, "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    table = np.array([[np.nan if r[c] is None else r[c] for c in categories] for r in rows], float).reshape(len(rows), len(categories))
    return [r["text"] for r in rows], table


#: Low quality first: junk and insults go together, and the chain may use it.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, max_rows: int = 8000, folds: int = 5) -> Chain:
    """A chain from a bounded sample of labelled rows; without labels every probability is one half."""
    texts, table = labelled_rows(docs, labels, categories, max_rows)
    return Chain.fit(texts, table, tuple(categories), folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> and a boolean <category> each, for every row.

    A null text is empty; equal ids stay separate rows; other columns are not read.
    """
    names = chain.categories
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in names) + ", " + ", ".join(f"{c} boolean" for c in names)
    shared = docs.sparkSession.sparkContext.broadcast(Chain(names, chain.models, chain.thresholds, np.zeros((0, 0))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, 2_000_000):
            p = model.predict(batch.column("text").to_pylist())
            cols = {"doc_id": batch.column("doc_id")}
            cols |= {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(names)}
            cols |= {c: pa.array(p[:, i] >= model.thresholds[i]) for i, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(cols)

    return doc_rows(docs).mapInArrow(of, schema)
