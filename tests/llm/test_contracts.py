"""The registered queries on the smallest tables, against plain Python over all rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from isohyet.llm import toxicity
from isohyet.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_op1(spark, docs):
    got = rows(spark, "op1_importance_resampling")
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    kept, left = ([r["sampling_key"] for r in got if r["kept"] is k] for k in (True, False))
    assert kept and left and min(kept) > max(left)
    quality = {r["doc_id"]: r["quality"] for r in table("labels")}
    share = lambda k: np.mean([quality[r["doc_id"]] for r in got if r["kept"] is k and quality.get(r["doc_id"]) in (0, 1)])
    assert share(True) > share(False)


def test_op3(spark, docs):
    got = rows(spark, "op3_simhash_windows")
    items = {r["item_id"]: r["text"] for r in table("benchmark")}
    assert got and {r["doc_id"] for r in got} <= set(docs)
    whole = {(i, k) for i, t in docs.items() for k, item in items.items() if item and len(item.split()) >= 13 and " ".join(WORD.findall(low(item))) in " ".join(WORD.findall(low(t)))}
    found = {r["doc_id"] for r in got if r.get("leaks", True)}
    assert {i for i, _ in whole} <= found


def test_op4(spark, docs):
    n, data = 400, {i: t.encode() for i, t in docs.items()}
    seen = Counter(hash(b[k : k + n]) for b in data.values() for k in range(len(b) - n + 1))
    got = rows(spark, "op4_suffix_array_family")
    assert len(got) == len(data)
    for r in got:
        b = data[r["doc_id"]]
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if seen[hash(b[k : k + n])] > 1:
                gone[k] += 1
                gone[k + n] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op5(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    ids, m = np.array(sorted(v)), np.array([v[i] for i in sorted(v)])
    got = rows(spark, "op5_hnsw_shards")
    assert len(got) == 20 * sum(i % 20 == 0 for i in v)
    hits = 0
    for q in (i for i in v if i % 20 == 0):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = m @ v[q]
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r["score"] == pytest.approx(float(v[r["vec_id"]] @ v[q]), abs=1e-12) for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"])) and q not in {r["vec_id"] for r in mine}
        best = [int(i) for _, i in sorted((-s, i) for s, i in zip(score, ids) if i != q)[:20]]
        hits += len(set(best) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * len(got)


def test_op6(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in docs.items()}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(count.values()), len(count)
    got = rows(spark, "op6_katz_backoff")
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), rel=1e-9) and r["score"] < 0
    both = [(r["score"], r["base_score"]) for r in got if r["held_out"]]
    assert sum(s for s, _ in both) > sum(b for _, b in both)


def test_op7(spark, docs):
    prints = {}
    for i, t in docs.items():
        ws = WORD.findall(low(t))
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([ws[k : k + 4] for k in range(len(ws) - 3)] or ([ws] if ws else []))]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op7_pigeonring_groups")}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in docs}


def test_op9(spark, docs):
    got = rows(spark, "op9_classifier_chain")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels")}
    p = {k: [r["p_toxic"] for r in got if r["toxic"] is k] for k in (True, False)}
    assert all(0 <= x <= 1 for x in p[True] + p[False]) and min(p[True]) >= max(p[False])
    known = [(r["toxic"], toxic[r["doc_id"]] == 1) for r in got if toxic.get(r["doc_id"]) in (0, 1)]
    assert np.mean([a == b for a, b in known]) > 0.9


def test_op9_weights_are_a_minimum():
    """The gradient of the penalised loss vanishes where training ends."""
    rng = np.random.default_rng(0)
    n, words = 300, 12
    x = rng.random((n, words)) < 0.3
    extra = rng.random((n, 1))
    y = (x[:, 0] | (rng.random(n) < 0.1)).astype(float)
    use = rng.random(n) < 0.8
    row, col = np.nonzero(x)
    w = toxicity.logistic(row, col, extra, y, use, words)
    full = np.c_[x, extra, np.ones(n)][use]
    loss = lambda w: float(np.log1p(np.exp(-(2 * y[use] - 1) * (full @ w))).sum() + 0.5 * (w[:-1] ** 2).sum())
    g = full.T @ (1 / (1 + np.exp(-full @ w)) - y[use]) + np.r_[w[:-1], 0.0]
    assert np.abs(g).max() < 0.02 * use.sum() ** 0.5
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in rng.normal(size=(50, len(w))) * 0.3)


def test_op10(spark, docs):
    got = rows(spark, "op10_sampled_splitters")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    homes = {}
    for r in got:
        b = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        homes.setdefault(r["shard"], []).append(r)
    assert set(homes) <= set(range(24)) and all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in homes.values())
    sizes, largest = [sum(r["size"] for r in homes.get(s, [])) for s in range(24)], max(r["size"] for r in got)
    assert max(sizes) <= sum(sizes) / 24 + largest
