"""Quality classifier by importance resampling.

Two generative models, bags of hashed n-grams, are counted: one over labelled good texts (target), one over all texts
(raw). A document's log importance weight is the sum of log(target / raw) over its n-grams. Documents are sampled
without replacement in proportion to their weights by Gumbel top-k: the k largest of log weight plus Gumbel noise.
n-grams are single words and pairs, and singles and pairs of word shapes (runs of byte classes, and whether a word
repeats the one before), so that shouting, tables and loops count as n-grams of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, cut, table

BUCKETS = 10_000
#: Labelled documents that are used at most, by order of a hash of the id: half for the target, half for k.
LABELLED = 20_000
TEMPERATURE = 1.0
SEED = 11


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of all n-grams, for one chunk after another."""
    for first, data, offsets in T.chunks(texts):
        w = T.words(data, offsets, table=None)
        again = np.zeros(len(w.hash), np.uint64)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        shape = T.mix(T.shapes(w, data) + again * np.uint64(0x51ED27)) if len(again) else w.hash
        (pair, at), (shape2, at2) = T.grams(w.hash, w.doc, 2), T.grams(shape, w.doc, 2)
        f = np.concatenate([w.hash, pair, shape, shape2]) % np.uint64(BUCKETS)
        yield f.astype(np.int64), np.concatenate([w.doc, w.doc[at], w.doc, w.doc[at2]]) + first


def labelled(labels: DataFrame, column: str, most: int = LABELLED) -> DataFrame:
    """(__id, label, held): at most `most` documents whose label is one of 0 and 1 and without contradiction."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.min(column).alias("__label"), F.max(column).alias("__most")).where("__label = __most")
    return one.orderBy(F.xxhash64("__id"), "__id").limit(most).select("__id", "__label", (F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(2)) == 1).alias("__held"))


def models(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(target / raw) for each bucket, from one pass over all texts; each task gives one row per bucket."""
    arrow(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for f, d in features(b.column(0)):
                raw += np.bincount(f, minlength=BUCKETS)
                target += np.bincount(f[good[d]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    good = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left").select("text", ((F.col("__label") == 1) & ~F.col("__held")).alias("good"))
    rows = good.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).sort("bucket").collect()
    c = np.array([tuple(r) for r in rows], float).reshape(-1, 3)[:, 1:].T if rows else np.zeros((2, BUCKETS))
    smooth = lambda x: np.log((x + 1) / (x.sum() + BUCKETS))
    return smooth(c[1]) - smooth(c[0]) if c[1].sum() else np.zeros(BUCKETS)


def log_weight(ratio: np.ndarray):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for f, d in features(texts):
            out += np.bincount(d, ratio[f], len(texts))
        return pa.array(out)

    return score


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the fewest errors, midway between scores; 0 if a class is missing."""
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    errors = np.r_[0, np.cumsum(g)] + np.r_[(~g).sum(), (~g).sum() - np.cumsum(~g)]
    errors[1:-1][s[1:] == s[:-1]] = len(s) + 1
    i = int(np.argmin(errors))
    return float(s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by counting in ever narrower bins; the driver sees at most `bins` rows."""
    if k <= 0:
        return float("inf")
    x = F.col(column)
    low, high, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or k >= n:
        return float("-inf")
    inside = df
    while high > low:
        at = F.least(F.floor((x - F.lit(low)) * F.lit(bins / (high - low))), F.lit(bins - 1)).cast("int")
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).sort(F.desc("bin")).collect()
        for r in rows:
            if k <= r.n:
                break
            k -= r.n
        low, high = r.low, r.high
        inside = df.where((x >= low) & (x <= high))
        if r.n <= bins and high > low:
            return inside.select(x).sort(x.desc()).collect()[k - 1][0]
    return low


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, carry: list[str] | None = None) -> DataFrame:
    """Returns docs with log_weight, sampling_key and kept; columns of docs so named are replaced.

    k is the number of documents whose log weight is at or above the threshold that best parts the held-out labelled
    documents, so the share of good documents sets it; of rows with these labels the first LABELLED in an order by hash of
    the id are taken. The noise is Gumbel noise times temperature (weights to the
    power 1 / temperature), from a hash of the id: reruns agree, and rows with equal id and text fare alike; where
    they tie at the cut, all are kept. A null or empty text has weight 0; long texts are scored whole. Without labels of
    both classes the threshold is 0; without good labels all weights are 0 and all is kept. An empty table gives an
    empty table. If `carry` names columns of docs, only these are returned, written along with the weights, and texts are
    scored once. By default all columns are returned, and texts scored again when the result is read: that takes less than
    a written copy of all texts.
    """
    docs = docs.drop("log_weight", "sampling_key", "kept")
    sample = cut(labelled(labels, "quality"), "quality-labels")
    ratio = models(docs.select("doc_id", "text"), sample)
    every = docs.withColumn("log_weight", log_weight(ratio)(F.col("text")))
    kept = cut(every.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", *(carry or [])])], "log_weight"), "quality-scores")
    scores = kept.select("doc_id", "log_weight")
    weighed = every if carry is None else kept.select(*[F.col(f"`{c}`") for c in carry], "log_weight") if "doc_id" in carry else kept
    held = scores.join(F.broadcast(sample.where("__held")), F.col("doc_id") == F.col("__id")).select("doc_id", "log_weight", "__label")
    held = held.orderBy(F.xxhash64("doc_id"), "doc_id", "log_weight").limit(LABELLED).collect()
    threshold = best_cut(np.array([r[1] for r in held], float), np.array([r[2] == 1 for r in held], bool))
    k = scores.where(F.col("log_weight") >= threshold).count()
    key = F.col("log_weight") + F.lit(float(temperature)) * gumbel(F.col("doc_id"))
    least = kth_largest(scores.withColumn("sampling_key", key), "sampling_key", k)
    return weighed.withColumn("sampling_key", key).withColumn("kept", F.col("sampling_key") >= F.lit(least))


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: importance weight, sampling key, whether it is drawn. See resample()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), carry=["doc_id"]).select("doc_id", "log_weight", "sampling_key", "kept")
