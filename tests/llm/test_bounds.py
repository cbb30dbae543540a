"""Bounded samples and hot keys: what is cut is cut in a fixed order before any single task, what is not is whole."""

from collections import Counter

import numpy as np
import pytest

from isohyet.llm import ann, quality, simhash, toxicity

RNG = np.random.default_rng(12)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(60)]


def text():
    return " ".join(RNG.choice(VOCAB, 12))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 30, text()) for i in range(300)] + [(5, text()) for _ in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(30)], "doc_id long, quality int, toxic int")


def test_index_keeps_shared_shingles(spark):
    rows = [(th, 3, np.sort(np.r_[np.int64(99), RNG.integers(0, 150, 2)]).astype(np.int64).tobytes()) for th in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = simhash.index(spark.createDataFrame(rows, "th long, n int, prefix binary")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    every = [(int(k), th, 3, i) for th, _, p in rows for i, k in enumerate(np.frombuffer(p, np.int64))]
    often = Counter(k for k, *_ in every)
    assert sorted(map(tuple, got)) == sorted(r for r in every if often[r[0]] > 1) and often[99] >= 200


def test_training_rows_do_not_hang_on_the_partitions(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 50)
    a, b = (toxicity.fit(docs.repartition(n), labels) for n in (2, 7))
    assert (a[0] == b[0]).all() and all(np.allclose(x, y) for x, y in zip(a[1], b[1])) and a[2] == b[2]


def test_threshold_does_not_hang_on_the_partitions(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 25)
    a, b = (sorted(map(tuple, quality.resample(docs.repartition(n), labels).select("doc_id", "text", "kept").collect())) for n in (2, 7))
    assert a == b and len(a) == 700


def test_width_of_a_shard_is_measured():
    """Vectors without any structure need wider searches than the least width to find the nearest from outside."""
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(3000, 64)), rng.normal(size=(60, 64))
    levels = ann.build(ann.augmented(v))
    width = ann.calibrated(v, levels, 21)
    near = ann.search(v, levels, q, width)
    assert ann.SEARCH < width < 3000 and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in near)
    score = np.where(near < 0, -np.inf, np.einsum("qkd,qd->qk", v[near], q))
    least = np.sort(q @ v.T, axis=1)[:, -20]
    assert np.minimum((score >= least[:, None] - 1e-9).sum(1), 20).mean() >= 0.9 * 20
    few = rng.normal(size=(5, 3))
    assert ann.calibrated(few, ann.build(ann.augmented(few)), 21) == 5
