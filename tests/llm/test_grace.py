"""Exact deduplication against a comparison of all texts."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

from isohyet.llm import grace
from isohyet.llm.queries import ORACLE_SQL, QUERIES

RNG = np.random.default_rng(5)
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row long, rep long, h long, keep_id string, carry string, kept int"


def flat(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def make(n):
    words = ["a", "b", "  c", "d\n", "Ä", "\t"]
    texts = [" ".join(RNG.choice(words, RNG.integers(0, 4))) for _ in range(n)]
    texts += [None, "", " ", "\n\t", "x" * 70_000, "x" * 70_000 + " ", "y" * 30_000, "hot text", "hot  text"] + ["hot text"] * (n // 2)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "a b"), (None, "only without id"), (None, "only  without id"), (3, texts[3]), (3, texts[3])]


def brute(rows):
    found = {}
    for i, t in rows:
        found.setdefault(flat(t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in found.items()}


@pytest.mark.parametrize("room, buckets", [(300, 2), (grace.ROOM, None)])
def test_classes(spark, room, buckets):
    rows = make(400)
    docs = spark.createDataFrame([r + (1, 2, 3, "k", "c", 0) for r in rows], SCHEMA).repartition(5)
    got = grace.classes(docs, carry=["text", "kept"], room=room, buckets=buckets).toPandas()
    want = brute(rows)
    assert len(got) == len(rows)
    stays = {}
    for r in got.itertuples():
        t = flat(r.carry["text"])
        keep, size = want[t]
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.group_size == size
        assert (None if np.isnan(r.keep_id) else int(r.keep_id)) == keep
        stays.setdefault(t, []).append((r.kept, r.doc_id))
    for t, s in stays.items():
        assert [i for k, i in s if k] == pytest.approx([np.nan if want[t][0] is None else want[t][0]], nan_ok=True)


def test_dedup_keeps_all_columns_and_string_ids(spark):
    docs = spark.createDataFrame([("b", "x  y", 1), ("a", "x y", 2), ("c", None, 3)], "doc_id string, text string, h int")
    got = grace.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [("a", "x y", 2), ("c", None, 3)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert grace.classes(none).count() == 0 and grace.dedup(none).count() == 0


def test_equal_hashes_are_told_apart():
    t = grace.Table(1 << 20)
    texts = [f"text {i}".encode() for i in range(3000)]
    for x in texts:
        assert t.find(7, x) < 0 and t.fits(x)
        t.add(7, x)
        if len(t.texts) > 60:
            break
    assert [t.find(7, x) for x in texts[:61]] == list(range(61)) and t.find(7, b"other") < 0 and t.find(8, texts[0]) < 0


def test_table_grows():
    t = grace.Table(1 << 20)
    for i in range(5000):
        assert t.find(i * 64, str(i).encode()) < 0
        t.add(i * 64, str(i).encode())
    assert all(t.find(i * 64, str(i).encode()) == i for i in range(5000))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_and_sql(spark):
    documents = duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet'")  # noqa: F841
    name = "op12_grace_dedup"
    want = duckdb.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
