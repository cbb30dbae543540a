"""Near-duplicates of the pipeline against a comparison of all pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from isohyet.llm import simhash


def expected(texts):
    """First index of each group, by comparing all pairs."""
    sets = [np.frombuffer(x, np.uint64) for x in simhash.shingle_sets(pa.array(texts))]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and simhash.similarity(sets[i], sets[j]) >= simhash.SIMILARITY - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.dedup(docs).collect())


def words(rng, n, mark="w"):
    return [f"{mark}{x}" for x in rng.integers(0, 1 << 40, n)]


def test_block_edits(spark):
    """An appended, a planted and a cut block leave a shingle similarity of 0.8 to 0.9."""
    rng, texts = np.random.default_rng(3), []
    for n in rng.integers(60, 400, 40):
        own, new, at = words(rng, n), words(rng, n // 5, "x"), int(rng.integers(5, n - 5))
        texts += [" ".join(w) for w in (own, own + new[: n // 5 - 1], own[:at] + new[: n // 8] + own[at:], own[: n - n // 6])]
    want = expected(texts)
    assert len(want) < 50
    assert kept(spark, texts) == want


def test_repeats_and_equal_word_sets(spark):
    """Texts of one word set: two similar ones are linked though neither is similar to the others."""
    rng, texts = np.random.default_rng(4), []
    for _ in range(12):
        line = words(rng, 12)
        texts += [" ".join(line * n) for n in (5, 50, 52)]
        own = words(rng, 150)
        other = list(rng.permutation(own))
        texts += [" ".join(own), " ".join(other), " ".join(other + other[:6])]
    texts += ["", " ", "  "]
    want = expected(texts)
    assert len(want) == 12 * 4 + 1
    assert kept(spark, texts) == want


def test_large_buckets(spark):
    """Many texts of one template, of which some pairs are similar, and many orders of one word set, each twice."""
    rng = np.random.default_rng(5)
    template, own = words(rng, 200), words(rng, 300)
    texts = [" ".join(template + words(rng, n, "x")) for n in rng.integers(4, 60, 150)]
    for _ in range(60):
        other = list(rng.permutation(own))
        texts += [" ".join(other + words(rng, 2, "y")) for _ in range(2)]
    want = expected(texts)
    assert 80 < len(want) < 200
    assert kept(spark, texts) == want


def test_a_pair_of_near_copies_is_given_once(spark, monkeypatch):
    """Near copies share many shingles; all pairs of their buckets are given, each by one bucket only."""
    rng = np.random.default_rng(11)
    base, rows = [f"w{k}" for k in range(90)], []
    for i in range(40):
        words = list(base)
        words[int(rng.integers(90))] = f"x{i}"
        rows.append((i, " ".join(words)))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    n, prefix, _, odd = simhash.prefixes(pa.array([t for _, t in rows], pa.string()), *none, 0.8)
    table = [(i, int(n[i]), prefix[i], i, odd[:, i].view(np.int64).tolist()) for i in range(40)]
    texts = spark.createDataFrame(table, "th long, n int, prefix binary, root long, odds array<long>")
    at = simhash.index(texts).join(texts.select("th", "root", "odds"), "th")
    large = at.groupBy("key").agg(F.count("*").alias("c")).where("c > 4096")
    made, real = [], DataFrame.distinct
    monkeypatch.setattr(DataFrame, "distinct", lambda df: made.append(df.count()) or real(df))
    got = {(r.a, r.b) for r in simhash.prefix_pairs(at, large, 0.8, None).collect()}
    sets = [np.frombuffer(x, np.uint64) for x in simhash.shingle_sets(pa.array([t for _, t in rows], pa.string()))]
    alike = {(i, j) for i in range(40) for j in range(i + 1, 40) if simhash.similarity(sets[i], sets[j]) >= 0.8}
    assert alike and alike <= got
    assert made[0] < 1.2 * len(got)
