"""Toxicity by a classifier chain.

The categories are predicted in turn. Each has a logistic regression over the presence of words; a later category's
model also gets the probabilities of those before it. In training these come from models that did not see the row
(out of fold), so the later model learns how far to trust them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, cut, table

#: Labelled ids in training at most, by order of a hash of the id, and rows: an id may stand in several.
LABELLED, ROWS = 12_000, 24_000
#: Words that the models use: those whose presence tells most about any category.
WORDS = 1024
FOLDS = 5
STEPS = 150
#: Chain order: name and the label column; low quality is quality = 0.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def word_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's index, word hash), each word once for each text; words lower-cased, without punctuation."""
    for first, data, offsets in T.chunks(texts):
        w = T.words(data, offsets, separators=T.PUNCT)
        order = np.lexsort((w.hash, w.doc))
        d, h = w.doc[order], w.hash[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        yield d[new] + first, h[new]


class Lookup:
    """Place of a hash among sorted ones, or -1; a bit table spares most searches."""

    def __init__(self, sorted_hashes: np.ndarray, bits: int = 20):
        self.h, self.mask = sorted_hashes, np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(sorted_hashes & self.mask).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are among them, and where."""
        maybe = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(maybe) or not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.h, h[maybe]), len(self.h) - 1)
        ok = self.h[at] == h[maybe]
        return maybe[ok], at[ok]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, use: np.ndarray, n: int, l2: float = 1.0) -> np.ndarray:
    """Weights of n words, of the extra columns and the intercept; full-batch Adam on the rows in use."""
    m = use[row]
    row, col, x = row[m], col[m], np.c_[extra, np.ones(len(y))]
    w, g1, g2 = np.zeros(n + x.shape[1]), 0.0, 0.0
    rows = max(1, use.sum())
    p0 = (y[use].sum() + 0.5) / (rows + 1)
    w[-1] = np.log(p0 / (1 - p0))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], len(y)) + x @ w[n:]
        e = (sigmoid(z) - y) * use / rows
        g = np.r_[np.bincount(col, e[row], n), x.T @ e] + l2 / rows * np.r_[w[:-1], 0.0]
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        w -= 0.2 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-10)
    return w


def train(sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Word hashes (sorted), each category's weights, each category's threshold (best F1 out of fold).

    A fold's models see nothing of the fold: their words, too, are chosen on the other folds' labels.
    """
    k = labels.shape[1]
    every = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    words, inverse = np.unique(h, return_inverse=True)

    def choose(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that tell most about some category in the rows in use; row and chosen word of each occurrence."""
        seen_in = use[every]
        total, tell = np.bincount(inverse[seen_in], minlength=len(words)), np.zeros(len(words))
        for j in range(k):
            y = labels[:, j]
            p = y[use].mean() if use.any() else 0
            seen = np.bincount(inverse[seen_in], y[every[seen_in]], len(words))
            tell = np.maximum(tell, (seen - total * p) ** 2 / np.maximum(total * p * (1 - p), 1e-9) * (total >= 3))
        chosen = np.sort(np.argsort(-tell, kind="stable")[:WORDS])
        place = np.full(len(words) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        col = place[inverse] if len(h) else np.zeros(0, int)
        return chosen, every[col >= 0], col[col >= 0]

    def predict(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(np.bincount(row, w[col], len(sets)) + np.c_[extra, np.ones(len(sets))] @ w[n:])

    folds = [choose(fold != f) for f in range(FOLDS)]
    chosen, row, col = choose(np.ones(len(sets), bool))
    extra, weights, cuts = np.zeros((len(sets), 0)), [], []
    for j in range(k):
        y, out = labels[:, j].astype(float), np.zeros(len(sets))
        for f, (some, r, c) in enumerate(folds):
            held = fold == f
            out[held] = predict(r, c, logistic(r, c, extra, y, ~held, len(some)), len(some))[held]
        weights.append(logistic(row, col, extra, y, np.ones(len(sets), bool), len(chosen)))
        order = np.argsort(-out, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        i = int(np.argmax(f1)) if len(y) and y.any() else -1
        cuts.append(1.1 if i < 0 else float(out[order[i]] + (out[order[i + 1]] if i + 1 < len(y) else 0)) / 2)
        extra = np.c_[extra, out]
    return words[chosen], weights, cuts


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Trains in one task on a bounded sample of labelled rows; documents whose labels disagree are left out.

    The sample holds at most LABELLED ids, and of their rows at most ROWS, the first in an order by hash of the words. Both
    cuts are made before the one task, so they bound it, however many rows an id has.
    """
    arrow(docs.sparkSession)
    sure = labels.where(F.col("doc_id").isNotNull())
    for _, column, _ in chain:
        sure = sure.where(F.col(column).isin(0, 1))
    sure = sure.groupBy(F.col("doc_id").alias("__id")).agg(*[f(c).alias(f"{p}_{n}") for n, c, _ in chain for p, f in (("min", F.min), ("max", F.max))])
    for n, _, _ in chain:
        sure = sure.where(f"min_{n} = max_{n}")
    y = F.array(*[(F.col(f"min_{n}") == v).cast("int") for n, _, v in chain])
    sample = cut(sure.orderBy(F.xxhash64("__id"), "__id").limit(LABELLED).select("__id", y.alias("__y"), F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("__fold")), "toxicity-labels")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [b""] * b.num_rows
            for d, h in word_sets(b.column(0)):
                ends = np.r_[np.flatnonzero(d[1:] != d[:-1]) + 1, len(d)] if len(d) else []
                for i, j in zip(np.r_[0, ends[:-1]].astype(int) if len(d) else [], ends):
                    sets[d[i]] = h[i:j].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), b.column(1), b.column(2)], ["words", "y", "fold"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((f, tuple(y), s) for b in batches for s, y, f in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[2], r[1]))
        words, weights, cuts = train([np.frombuffer(s, np.uint64) for _, _, s in rows], np.array([y for _, y, _ in rows], int).reshape(len(rows), len(chain)), np.array([f for f, _, _ in rows], int))
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([[w.tobytes() for w in weights]], pa.list_(pa.binary())), pa.array([cuts], pa.list_(pa.float64()))], ["words", "weights", "cuts"])

    known = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("text", "__y", "__fold").mapInArrow(pack, "words binary, y array<int>, fold int")
    known = known.orderBy(F.xxhash64("words"), "words", "y").limit(ROWS)
    got = known.repartition(1).mapInArrow(learn, "words binary, weights array<binary>, cuts array<double>").first()
    if got is None:
        return np.zeros(0, np.uint64), [np.r_[np.zeros(j), -30.0] for j in range(len(chain))], [1.1] * len(chain)
    return np.frombuffer(got.words, np.uint64), [np.frombuffer(w) for w in got.weights], list(got.cuts)


def classify(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> DataFrame:
    """Returns docs with p_<category> and a boolean <category> for each category of the chain; such columns are replaced.

    Texts are judged whole, however long. A null text is empty, and a text without words gets the base rate of the training rows.
    Without labelled documents all probabilities are near 0. Equal texts get equal results; an empty table gives an
    empty table. labels needs doc_id and the label columns; other columns are ignored.
    """
    words, weights, cuts = fit(docs, labels, chain)
    docs = docs.drop(*[c for n, _, _ in chain for c in (n, f"p_{n}")])
    kind = t.StructType([t.StructField(f"p_{n}", t.DoubleType()) for n, _, _ in chain])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        n, look, z = len(words), Lookup(words), np.zeros((len(weights), len(texts)))
        for d, h in word_sets(texts):
            hit, at = look(h)
            for j, w in enumerate(weights):
                z[j] += np.bincount(d[hit], w[at], len(texts))
        p = np.zeros((len(texts), 0))
        for j, w in enumerate(weights):
            p = np.c_[p, sigmoid(z[j] + np.c_[p, np.ones(len(texts))] @ w[n:])]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, j])) for j in range(len(weights))], [f"p_{n}" for n, _, _ in chain])

    out = docs.withColumn("__p", score(F.col("text")))
    return out.withColumns({f"p_{n}": F.col(f"__p.p_{n}") for n, _, _ in chain} | {n: F.col(f"__p.p_{n}") >= F.lit(c) for (n, _, _), c in zip(chain, cuts)}).drop("__p")


def op9_classifier_chain(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: probability and verdict of each category of the chain. See classify()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic")
