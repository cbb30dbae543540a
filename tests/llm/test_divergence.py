"""Source divergences against exact arithmetic over all pairs and terms."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from isohyet.llm import divergence
from isohyet.llm.queries import ORACLE_SQL, QUERIES

RNG = np.random.default_rng(6)
DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(low(text))
        groups[lang].add(source)
        seen[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(seen[lang, s]) for s in sources}
        q = shares(sum((seen[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if seen[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", own)):
                out |= {(lang, s, part, item.decode(), -v_, k + 1) for k, (v_, item) in enumerate(found)}
    return out


def rows(n):
    words = ["The", "the", "of", "Ärger", "ärger", "x", "don't", "naïve", "日本", "a1b", "zz" * 20, "😀"]
    out = [(str(RNG.choice(["en", "de"])), f"s{RNG.integers(0, 4)}", " ".join(RNG.choice(words, RNG.integers(0, 12)))) for _ in range(n)]
    return out + [(None, "s1", "alone"), ("", None, None), ("en", "empty", "1 2 3 --"), ("en", None, "the the of"), ("en", "s1", "the\x00of\x7fthe")] + out[:5]


@pytest.mark.parametrize("cells", [7, divergence.BLOCK])
def test_audit(spark, monkeypatch, cells):
    data = rows(300)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], "lang string, source string, text string, term string, n int, total int").repartition(3)
    got = divergence.audit(docs, 10, 3, cells)
    assert {tuple(r) for r in got.collect()} == brute(data, 10, 3)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "xxh64", lambda data, start, end, seed: (end - start).astype(np.uint64) % np.uint64(2))
    held, texts = divergence.Counts(), ["ab cd ab", "cd ef", None, "x ab ef gh", "longer term than eight bytes"]
    held.groups["en", "s"] = 0
    for _ in range(2):
        held.add(pa.array(texts), np.zeros(len(texts), np.int64))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    got = {r["term"]: (r["n"], r["docs"]) for b in held.given(schema) for r in b.to_pylist() if r["term"]}
    terms = [t.split() if t else [] for t in texts]
    assert got == {t: (2 * sum(x.count(t) for x in terms), 2 * sum(t in x for x in terms)) for x in terms for t in x}


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(RNG.choice(["ab", "cde", "f" * 300], 3000))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def counted():
        held = divergence.Counts()
        held.groups["en", "s"] = 0
        held.add(pa.array([text, "ab"]), np.zeros(2, np.int64))
        return {(r["term"], r["n"], r["docs"]) for b in held.given(schema) for r in b.to_pylist()}

    whole = counted()
    monkeypatch.setattr(divergence, "CHUNK", 128)
    assert counted() == whole and ("ab", text.split().count("ab") + 1, 2) in whole


def test_share_is_exact():
    n, total = np.array([0, 1, 10**14, 3 * 10**15]), 3 * 10**15 + 5
    assert divergence.share(n, total, 10**6).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 2 * 10**6) for x in n]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_and_sql(spark):
    documents = duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet'")  # noqa: F841
    name = "op11_source_divergence"
    want = duckdb.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert len(want) > 0 and sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
