"""The stages on the smallest tables, against brute force, and the query that has an SQL twin."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from isohyet.llm import mixing, quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_quality_rejects_labelled_junk(spark, steps):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    rows = steps[0].join(labels, "doc_id").select("doc_id", "quality").collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.95
    whole = quality.resample(steps[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert whole.where("kept").count() == len(kept)


def test_near_dedup_against_brute_force(steps):
    rows = steps[1].select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i].keys() & sets[j].keys() and similar(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(min(g) for g in groups.values())


def test_decontamination_against_brute_force(spark, steps):
    import re

    word = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({i: i + 32 for i in range(65, 91)}))
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = [Counter(cut(word(r.text))) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = []
    for r in steps[2].collect():
        s = cut(word(r.text))
        leak = False
        for item in items:
            if item and item.keys() & set(s):
                n = sum(item.values())
                m = min(n, len(s))
                leak |= any(similar(Counter(s[i : i + m]), item) >= 0.8 for i in range(len(s) - m + 1))
        if not leak:
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(want)


def test_mix_and_shards(steps):
    drawn = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    want = {r.doc_id: r["copies"] for r in mixing.copies(steps[3]).where("copies > 0").collect()}
    assert drawn == want
    shards = steps[5].groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in shards) and steps[5].count() == steps[4].count()


def test_stages_take_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema))
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        assert stage(spark, odd, DATA).count() <= 9


def test_mix_twin(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(c.sql(mixing.OP2_SQL).select("doc_id, size, source_size, target, taken").fetchall())
    assert sorted(tuple(r) for r in mixing.op2_systematic_mix(spark, DATA).collect()) == want
