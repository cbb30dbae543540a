"""The index of benchmark items against comparisons of all windows, and its odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.llm import decontamination as D


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else [], k


def brute(text, items):
    """Items with a window of similarity 0.8 or more, whatever its place."""
    out = set()
    for x, item in enumerate(items):
        a, k = shingles(item)
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        b = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []
        m = min(len(a), len(b))
        for i in range(len(b) - m + 1 if m else 0):
            p, q = Counter(a), Counter(b[i : i + m])
            if 5 * sum((p & q).values()) >= 4 * sum((p | q).values()):
                out.add(x)
                break
    return out


def made(seed):
    """Items that share templates and repeat shingles, and texts that hold them with changed, cut and added words."""
    r = random.Random(seed)
    word = lambda n=300: f"w{r.randrange(n)}"
    bases = [[word() for _ in range(r.choice((1, 3, 5, 12, 30, 60)))] for _ in range(12)]
    items = [" ".join(word() if r.random() < 0.03 else w for w in r.choice(bases)) for _ in range(80)] + ["a b c " * 9, "", None, "..."]
    texts = [None, "", "?!"]
    for _ in range(60):
        v = [word() for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            w = (r.choice(items) or "").split()
            w = [word() if r.random() < 0.02 else x for x in w][r.randrange(3) if len(w) > 20 else 0 :]
            v += w + [word() for _ in range(r.randrange(9))]
        texts.append(" ".join(v))
    return items, texts


@pytest.mark.parametrize("small", [1000, 3])
def test_finder_finds_what_all_windows_give(small, monkeypatch):
    monkeypatch.setattr(D, "SMALL", small)  # 3: buckets have multi-indexes
    items, texts = made(11)
    found = D.Finder(pa.array(items, pa.string()))
    assert small > 3 or max(np.diff(b.ends).max() for b in found.by_k.values()) > 3
    got = found(pa.array(texts, pa.string()))
    want = [brute(t, items) for t in texts]
    assert [{x for x, *_ in leaks} for leaks in got] == want and sum(map(len, want)) > 100
    for t, leaks in zip(texts, got):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t or "")
        for x, start, words, sim in leaks:
            a, k = shingles(items[x])
            p, q = Counter(a), Counter(tuple(w[i : i + k]) for i in range(start, start + words - k + 1))
            assert sim == pytest.approx(sum((p & q).values()) / sum((p | q).values()))


def test_rare_shingles_leave_no_window_out():
    item, n = np.zeros(4, np.int64), np.array([10])
    keys, counts = np.arange(4).astype(np.uint64), np.array([1, 2, 3, 4])
    assert sorted(counts[D.rarest(item, keys, counts, n)].tolist()) == [1, 2]  # 10 - 8 + 1 = 3 of 10
    item = np.repeat(np.arange(3), 2)  # shingle 7 is in all items, the others are filed first
    keys = np.array([7, 1, 7, 2, 7, 3], np.uint64)
    assert keys[D.rarest(item, keys, np.ones(6, int), np.array([2, 2, 2]))].tolist() == [1, 2, 3]


def test_long_text_with_an_item_many_times(monkeypatch):
    monkeypatch.setattr(D, "SPAN", 1000)  # fingerprints of a long text come in parts
    item = " ".join(f"q{i}" for i in range(25))
    text = " ".join([*(f"x{i}" for i in range(5000)), *[item, "gap"] * 400, *["only"] * 30_000])
    got = D.Finder(pa.array([item, "only"]))(pa.array([text]))[0]
    assert [s for x, s, *_ in got if x == 0] == [5000 + 26 * i for i in range(400)]
    assert sum(x == 1 for x, *_ in got) == 30_000


def test_ids_of_any_type_and_names_that_clash(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {text} b", 5), (1, f"a {text} b", 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, __leaks int")
    bench = spark.createDataFrame([("x", text, 1), (None, text, 2), ("y", None, 3)], "item_id string, text string, __leaks int")
    rows = docs.withColumn("l", D.leaks(bench, F.col("text"))).collect()
    assert [[k.item_id for k in r.l] for r in sorted(rows, key=lambda r: r.doc_id)] == [[None, "x"], [None, "x"], [], []]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    packs = D.clean(docs, bench.unionByName(bench))
    assert sorted(r.doc_id for r in packs.collect()) == [2, 3]
    assert docs.withColumn("l", D.leaks(bench.limit(0), F.col("text"))).where("size(l) = 0").count() == 4
