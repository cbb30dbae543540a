"""Odd rows, empty tables and clashing names, for every operator; small brute-force versions where SQL has none."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.llm import ann, chat, decontamination, graph, lm, mixing, quality, repeats, sharding, simhash, toxicity

RNG = np.random.default_rng(8)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, kept string, hash string, fp string, target int, copies int"


def sentence(n):
    return " ".join(RNG.choice(VOCAB, n))


BASE = [sentence(int(n)) for n in RNG.integers(3, 200, 40)]
TEXTS = [*BASE, None, "", " \n\t ", "word", sentence(9000), *BASE[:6], BASE[7] + " tail", "Ärger größer ñandú çà"]
ROWS = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 0, "x", "y", "z", "h", "f", 1, 1) for i, t in enumerate(TEXTS)]
ROWS += [(None, "no id here at all", None, None, None) + ROWS[0][5:], ROWS[3], ROWS[3], (5, "same id other text", "en", "src1", 0) + ROWS[0][5:]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0), "x") for i in range(30)] + [(None, 1, 1, "x"), (3, None, None, "x"), (7, 0, 0, "x"), (7, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def key(r):
    return tuple(str(x) for x in r)


def test_sharding(docs, none):
    got = sharding.split(docs, 5, 8).toPandas()
    assert len(got) == len(ROWS) and got.drop(columns=["shard", "slot"]).shape[1] == len(docs.columns) - 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.shard.between(0, 4).all()
    assert sharding.split(none, 5).count() == 0


def test_sharding_balances_a_hot_text(spark):
    rows = [(i, "hot text of one third" if i % 3 == 0 else sentence(6)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", sharding.size_of("text"))
    got = sharding.split(df, 6, 32).groupBy("shard").agg(F.sum("n").alias("n")).toPandas()
    assert len(got) == 6 and got.n.max() / got.n.mean() < 1.1 and got.n.min() / got.n.mean() > 0.9


def test_sharding_keeps_equal_texts_together(spark):
    """Groups of about 0.3 of a shard, one of 0.9, one of 2.5, and small texts: only what outgrows a shard is parted."""
    shard = 30 * 1000
    groups = [0.3] * 12 + [0.9, 2.5] + [0.02] * 40
    texts = [sentence(30)[:92].ljust(92, "x") for _ in groups]
    rows = [t for t, g in zip(texts, groups) for _ in range(round(g * shard / 100))]
    rows += [sentence(30)[:92].ljust(92, "y") for _ in range(12 * shard // 100 - len(rows))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sharding.split(df, 12).toPandas()
    size = got.groupby("shard").size()
    assert len(size) == 12 and size.max() / size.mean() < 1.06 and size.min() / size.mean() > 0.94
    homes = got.groupby("text")["shard"].nunique()
    assert homes[texts[13]] == 3 or homes[texts[13]] == 4
    assert all(homes[t] == 1 for i, t in enumerate(texts) if i != 13) and homes.drop(texts[13]).max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_mixing(docs, none):
    got = mixing.copies(docs).toPandas()
    assert len(got) == len(ROWS) and got["copies"].between(0, 3).all()
    per = got.groupby(got.source.fillna("~")).agg(size=("size", "sum"), s=("source_size", "first"), t=("target", "first"))
    assert (per["size"] == per.s).all() and per.t.sum() == pytest.approx(per.s.sum()) and (per.t <= 3 * per.s + 1e-9).all()
    assert mixing.mix(docs).count() == got["copies"].sum()
    assert mixing.copies(none).count() == 0


def test_targets_fill_up(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["a"] == 30 and got["c"] == 15 and sum(got.values()) == pytest.approx(2000)
    assert got["b"] / 2 == pytest.approx(got[None] / 1)


def test_chat_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        n = int(rng.integers(1, 700 if c == 3 else 14))
        for i in range(n):
            role = "system" if i == 0 and c % 2 else ["user", "assistant"][i % 2]
            text = [None, "", "<|end|> <\\|role|>", "</s>[INST]", sentence(int(rng.integers(1, 300)))][int(rng.integers(0, 5))]
            rows.append((c, i, role, text, "x"))
    rows += [(None, None, None, "lost", "x"), (1, 1, "user", "tie", "x"), (1, 1, "user", "tie", "x"), (4, None, "assistant", "first", "x"), (99, 0, "system", "alone", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    out = chat.windows(df, 256).withColumn("turns", chat.read_turns(F.col("text"))).collect()
    said, learnt = defaultdict(list), defaultdict(list)
    plain = lambda s: __import__("re").sub(r"<(\\*)\\\|", lambda m: "<" + m[1] + "|", s)
    for r in sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id, r.window)):
        said[r.conv_id] += [(t.role, t.text) for t in r.turns[r.n_repeated :]]
        learnt[r.conv_id] += [plain(r.text[s.start : s.start + s.length]) for s in r.loss]
        if len(r.turns) - r.n_repeated > 1:
            system = r.turns[0].role == "system"
            one = [len((t.text or "").split()) + 1 for t in r.turns[r.n_repeated :]]
            assert r.n_tokens <= 256 or (system and len(one) == 1 and len(r.turns) == 2)
    groups = defaultdict(list)
    for c, i, role, text, _ in rows:
        groups[c].append((i is not None, i or 0, role is not None, role or "", text is not None, text or ""))
    for c, g in groups.items():
        want = [(r, t) for *_, r, _, t in ((x[0], x[1], x[3], x[4], x[5]) for x in sorted(g))]
        assert said[c] == want
        assert learnt[c] == [t for r, t in want if r == "assistant"]
    assert chat.windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("system,turn", [(450, 20), (450, 40), (505, 6), (600, 3), (100, 150), (0, 60)])
def test_chat_budget(spark, system, turn):
    """A window is over the budget only if the system turn and the turn it is for are so by themselves."""
    rng = np.random.default_rng(2)
    rows = [(1, 0, "system", sentence(system))] if system else []
    rows += [(1, i + 1, ("user", "assistant")[i % 2], sentence(int(rng.integers(1, turn + 1)))) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, 512).withColumn("turns", chat.read_turns(F.col("text"))).collect()
    assert sum(len(r.turns) - r.n_repeated for r in out) == len(rows)
    for r in out:
        size = [len(t.text.split()) + 1 for t in r.turns]
        assert r.n_tokens == sum(size)
        if system and r.window:
            assert r.turns[0].role == "system"
        assert r.n_tokens <= 512 or (len(size) == 2 and r.n_repeated == 1) or (len(size) == 1 and r.window == 0), (size, r.n_repeated)


def test_simhash_groups(docs, none):
    got = simhash.near_groups(simhash.with_fingerprints(docs)).toPandas()
    assert len(got) == len(ROWS)
    fps = [simhash.fingerprint(r[1]) for r in ROWS]
    parent = list(range(len(fps)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(key((r[0], np.uint64(f).astype(np.int64), least.get(find(i)))) for i, (r, f) in enumerate(zip(ROWS, fps)))
    have = sorted(key((None if pd.isna(a) else int(a), b, None if pd.isna(c) else int(c))) for a, b, c in got.itertuples(index=False))
    assert have == want
    assert simhash.near_groups(simhash.with_fingerprints(none)).count() == 0


def test_fingerprints_against_the_library():
    import pyarrow as pa
    import xxhash

    texts = [r[1] for r in ROWS] + ["a B c", "A b  C\td", " ".join(["x" * n for n in (1, 40, 5000, 3, 9000, 31, 32, 33)])]
    want = []
    for t in texts:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == want


@pytest.mark.parametrize("finer,part", [(4, 1 << 15), (1, 8), (512, 8)])
def test_divided_buckets_lose_no_link(spark, monkeypatch, finer, part):
    """All links within the radius stay connected however buckets are divided and dealt out."""
    monkeypatch.setattr(simhash, "FINER", finer)
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(14)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    # Pairs at every distance up to 6, and fingerprints that share segments but nothing else.
    fps = set(base) | {f ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for f in base for k in (1, 2, 3, 4, 4, 4, 5, 6)}
    fps |= {(base[0] & ((1 << 26) - 1)) | int(x) << 26 for x in rng.integers(0, 1 << 38, 200)}
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(0, f) for f in fps], "s int, fp long")).collect()}
    arr = np.array(sorted(fps)).view(np.uint64)
    want = {frozenset((int(a), int(b))) for i, a in enumerate(arr.view(np.int64)) for b in arr.view(np.int64)[i + 1 :][np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4]}
    assert want and want <= got | want and all(bin((min(p) ^ max(p)) & (2**64 - 1)).count("1") <= 4 for p in got)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in got:
        a, b = p
        parent[find(a)] = find(b)
    assert all(len({find(x) for x in p}) == 1 for p in want)


def test_links_of_a_dense_group(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(63, 2, replace=False)) for _ in range(900)} | set(map(int, rng.integers(0, 1 << 62, 500)))
    df = spark.createDataFrame([(0, f) for f in fps], "s int, fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    arr = np.array(sorted(fps))
    for f in arr:
        for g in arr[np.bitwise_count((arr ^ f).astype(np.uint64)) <= 4]:
            assert find(int(f)) == find(int(g))


def test_dedup(docs, none):
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len({r.text or "" for r in rows}) == len(rows)
    assert sum(not (r.text or "").split() for r in rows) == 1
    kept = {r.doc_id for r in rows}
    assert 3 in kept and 45 not in kept  # a copy of document 0 goes
    assert simhash.dedup(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, none):
    items = [(0, BASE[5]), (1, sentence(40)), (2, None), (3, ""), (4, "word"), (5, BASE[5])]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, k.item_id) for r in docs.withColumn("l", decontamination.leaks(bench, F.col("text"))).collect() for k in r.l}
    assert {(5, 0), (5, 5), (50, 0), (43, 4)} <= got and not any(k in (1, 2, 3) for _, k in got)
    packs = {(r.doc_id, k.item_id) for r in docs.withColumn("l", decontamination.leaks(bench, F.col("text"), 2)).collect() for k in r.l}
    assert packs == got
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.where("doc_id = 43").count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert decontamination.clean(none, bench).count() == 0


def test_multi_index_finds_all_in_radius():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 300, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 26)), replace=False)) for _ in range(300)], np.uint64)
    q, i = decontamination.MultiIndex(fps).near(fps ^ flips)
    have = set(zip(q.tolist(), i.tolist()))
    d = np.bitwise_count((fps ^ flips)[:, None] ^ fps[None])
    assert have == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(d <= decontamination.RADIUS)))}


def test_repeats(docs, none):
    got = repeats.remove(docs).toPandas()
    raws = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(r[p : p + 400] for r in raws for p in range(len(r) - 399))
    want = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                gone[p : p + 400] = True
        want.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    assert sorted((int(a), int(b), int(c), bytes(k)) for a, b, c, k in zip(got.n_bytes, got.n_removed, got.n_spans, got.kept)) == sorted(want)
    assert sum(w[1] for w in want) > 0
    assert sorted(got.n_repeated_words) == sorted(repeated_words(r[1] for r in ROWS)) and got.n_repeated_words.max() >= 50
    assert repeats.remove(none).count() == 0


def repeated_words(texts, span=50):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + span]) for w in words for p in range(len(w) - span + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - span + 1):
            if seen[tuple(w[p : p + span])] > 1:
                gone[p : p + span] = True
        out.append(int(gone.sum()))
    return out


def test_short_passages(spark):
    """60 short words are under 400 bytes: reported by words, not removed; other white space between them matters not."""
    rng, passage = np.random.default_rng(12), [f"{x:x}" for x in np.random.default_rng(13).integers(16, 4096, 60)]
    texts = [" ".join([sentence(80), (" ", "\n", "  ")[i % 3].join(passage), sentence(int(rng.integers(0, 50)))]) for i in range(7)] + [sentence(200), " ".join(passage[:50]), " ".join(passage[:49])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove(df).collect()}
    assert [got[i].n_repeated_words for i in range(10)] == repeated_words(texts) == [60] * 7 + [0, 50, 0]
    assert all(r.n_removed == 0 and r.kept.decode() == texts[i] for i, r in got.items())


@pytest.mark.parametrize("unit", [repeats.Unit(12, 4, 1), repeats.Unit(6, 2, 8)])
def test_family_against_all_pairs(monkeypatch, unit):
    """Batches that share anchors over several levels, contexts that end early, and bytes of value 0."""
    rng, w = np.random.default_rng(9), unit.width
    rows = []
    for gram in range(30):
        core = rng.integers(0, 2, unit.gram * w, np.uint8)
        for _ in range(int(rng.integers(1, 12))):
            a, after = int(rng.integers(0, unit.back + 1)), int(rng.integers(unit.gram, unit.span + 1))
            if a + after < unit.span:
                continue
            draw = lambda n: (rng.random(n * w) < 0.08).astype(np.uint8)
            rows.append((np.concatenate([draw(a), core, draw(after - unit.gram)]).tobytes(), a))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    family = repeats.Family(unit)
    for i in range(0, len(rows), 16):
        family.add(rows[i : i + 16])
    want = np.zeros_like(family.hit)
    for b in range(unit.back + 1):
        cuts = [c[(a - b) * w : (a - b + unit.span) * w] if a >= b else b"" for c, a in rows]
        seen = Counter(cuts)
        want[:, b] = [len(c) == unit.span * w and seen[c] > 1 for c in cuts]
    assert want.any() and (family.hit == want).all() and len(family.levels) < 6


def test_repeats_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    shared = sentence(80)
    texts = [f"{sentence(20)} {shared} {sentence(20)}" for _ in range(12)] + ["ab" * 900, "x" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove(df).collect()}
    raws = [t.encode() for t in texts]
    seen = Counter(r[p : p + 400] for r in raws for p in range(len(r) - 399))
    for i, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                gone[p : p + 400] = True
        assert got[i] == gone.sum()


def test_ann(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(600 + i, v[0].tolist(), 0) for i in range(60)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0] * 3, 0), (None, v[1].tolist(), 0), (20, v[20].tolist(), 0), (2080, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df).toPandas()
    ids, x = np.array([r[0] for r in rows[:660]]), np.array([r[1] for r in rows[:660]], float)
    hit = 0
    for q in range(0, 660, 20):
        s = x @ x[q]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, [x[k] @ x[q] for k in g.vec_id])
        hit += len(set(want) & set(g.vec_id))
    assert hit / (33 * 20) >= 0.9 and set(got.query_id) == set(range(0, 660, 20))
    assert ann.nearest(df.limit(0)).count() == 0


def test_lm(docs, none, spark):
    frame = docs.select("doc_id", "text", "kept", (F.coalesce(F.col("doc_id"), F.lit(1)) % 4 == 0).alias("held"))
    got = lm.score(frame).toPandas()
    texts = [(r[0], (r[1] or "").encode().lower().split() + [None], (r[0] if r[0] is not None else 1) % 4 == 0) for r in ROWS]
    uni, pairs, first = Counter(), Counter(), Counter()
    for _, t, held in texts:
        if not held:
            uni.update(t)
            pairs.update(zip(["<"] + t[:-1], t))
            first.update(["<"] + t[:-1])

    def factors(c):
        n = Counter(c.values())
        common = 6 * n[6] / n[1]
        return {r: x if 0 < x < 1 else 1.0 for r in range(1, 6) for x in [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1.0]}

    d1, d2, total = factors(uni), factors(pairs), sum(uni.values())
    saved = sum((1 - d1.get(c, 1)) * c for c in uni.values())
    p1 = lambda w: (uni[w] * d1.get(uni[w], 1) if uni[w] else max(saved, 0 if saved else 1)) / (total if saved else total + 1)
    seen = defaultdict(lambda: [0.0, 0.0])
    for (h, w), c in pairs.items():
        seen[h][0] += c * d2.get(c, 1)
        seen[h][1] += p1(w)

    def p2(h, w):
        if not first[h]:
            return p1(w)
        used, mass = seen[h]
        spare = first[h] - used > 1e-12 * first[h]
        if pairs[h, w]:
            return pairs[h, w] * d2.get(pairs[h, w], 1) / (first[h] if spare else used + 1)
        return (1 - used / first[h] if spare else 1 / (used + 1)) / (1 - mass) * p1(w)

    want = sorted((len(t), round(sum(math.log10(p2(h, w)) for h, w in zip(["<"] + t[:-1], t)), 5)) for _, t, _ in texts)
    have = sorted((int(n), round(s, 5)) for n, s in zip(got.n_tokens, got.score))
    assert [a for a, _ in have] == [a for a, _ in want] and np.allclose([b for _, b in have], [b for _, b in want], atol=1e-4)
    assert set(got.train_tokens) == {total}
    # Both levels are normalised: over all words, the end and one unknown word.
    for h in ["<", BASE[0].split()[0]]:
        assert sum(p2(h, w) for w in [*uni, "never seen"]) == pytest.approx(1)
    assert lm.score(none.select("doc_id", "text", F.lit(False).alias("held"))).count() == 0
    assert set(lm.score(docs.select("doc_id", "text", F.lit(True).alias("held"))).toPandas().score) == {0.0}


def test_quality(docs, none, labels):
    got = quality.resample(docs, labels)
    assert quality.resample(docs, labels, carry=["doc_id"]).columns == ["doc_id", "log_weight", "sampling_key", "kept"]
    assert sorted(got.columns) == sorted([*docs.columns, "log_weight", "sampling_key"]) and got.count() == len(ROWS)
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == len(ROWS)
    assert quality.resample(none, labels).count() == 0


def test_quality_parts_junk(spark):
    rows = [(i, sentence(60) if i % 3 else " ".join(w.upper() + "!!" for w in sentence(60).split())) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    got = quality.resample(df, lab).toPandas()
    assert ((got.doc_id % 3 > 0) == got.kept).mean() > 0.98


def test_quality_against_brute_force(spark, docs, labels):
    """Counts, weights, the cut and the draw, text by text."""
    one = [[f for f, _ in quality.features(__import__("pyarrow").array([r[1] or ""]))] for r in ROWS]
    grams = [Counter(np.concatenate(f).tolist()) if f else Counter() for f in one]
    lab = {i: int(i % 4 != 0) for i in range(30) if i not in (3, 7)} | {3: 1}
    seed = {r.i: r.h for r in spark.range(60).selectExpr("id AS i", f"pmod(xxhash64(id, {quality.SEED}), 2) = 1 AS h").collect()}
    ids = [r[0] for r in ROWS]
    raw, good = Counter(), Counter()
    for i, g in zip(ids, grams):
        raw.update(g)
        if lab.get(i) == 1 and not seed[i]:
            good.update(g)
    smooth = lambda c, f: math.log((c[f] + 1) / (sum(c.values()) + quality.BUCKETS))
    weight = [sum(n * (smooth(good, f) - smooth(raw, f)) for f, n in g.items()) for g in grams]
    held = [(w, lab[i] == 1) for i, w in zip(ids, weight) if i in lab and seed[i]]
    cut = quality.best_cut(np.array([w for w, _ in held]), np.array([x for _, x in held]))
    noise = {r.i: r.g for r in docs.select(F.col("doc_id").alias("i"), quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    key = [w + noise[i] for i, w in zip(ids, weight)]
    k = sum(w >= cut for w in weight)
    least = sorted(key)[-k]
    got = quality.resample(docs, labels).select("doc_id", "log_weight", "sampling_key", "kept").toPandas()
    want = sorted(zip(weight, key, (x >= least for x in key)))
    have = sorted(zip(got.log_weight, got.sampling_key, got.kept))
    assert np.allclose(np.array(have, float), np.array(want, float)) and 0 < k < len(ROWS)


def test_kth_largest(spark):
    x = np.random.default_rng(3).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 17, 1500, 2999):
        assert quality.kth_largest(df, "x", k, 16) == np.sort(x)[-k]
    assert quality.kth_largest(df, "x", 0) == math.inf and quality.kth_largest(df, "x", 5000) == -math.inf


def test_toxicity(spark, docs, none, labels):
    got = toxicity.classify(docs, labels)
    assert got.count() == len(ROWS) and {"p_toxic", "toxic", "low_quality"} <= set(got.columns)
    assert toxicity.classify(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.classify(none, labels).count() == 0
    rows = [(i, sentence(50) + (" vileword " if i % 5 == 0 else " ") + sentence(5)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1 - (i % 7 == 0), int(i % 5 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(df, lab).where("doc_id >= 800").toPandas()
    assert ((out.doc_id % 5 == 0) == out.toxic).mean() > 0.97


def test_folds_see_nothing_of_themselves(monkeypatch):
    """Labels that are pure chance stay unpredictable out of fold, though words of few rows tell them apart in all rows."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(toxicity, "WORDS", 60)
    sets = [np.unique(rng.integers(0, 4000, 40).astype(np.uint64)) for _ in range(300)]
    labels = rng.integers(0, 2, (300, 1))
    seen = []
    logistic = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda row, col, extra, y, use, n: seen.append((row, col, use, n)) or logistic(row, col, extra, y, use, n))
    fold = np.arange(300) % toxicity.FOLDS
    toxicity.train(sets, labels, fold)
    assert len(seen) == toxicity.FOLDS + 1
    for f, (row, col, use, n) in enumerate(seen[:-1]):
        w = logistic(row, col, np.zeros((300, 0)), labels[:, 0].astype(float), use, n)
        z = np.bincount(row, w[col], 300) + w[-1]
        right = ((z > 0) == (labels[:, 0] == 1))[fold == f].mean()
        assert (use == (fold != f)).all() and right < 0.7


def test_chain_against_brute_force():
    """Scores of a trained chain by plain sums over words, and weights at a minimum of the penalised loss."""
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 50, 8).astype(np.uint64)) for _ in range(400)]
    y = np.array([[3 in s, (3 in s) and (5 in s)] for s in sets]).astype(int)
    words, weights, cuts = toxicity.train(sets, y, np.arange(400) % toxicity.FOLDS)
    place, first = {w: i for i, w in enumerate(words.tolist())}, []
    for s, (a, b) in zip(sets, y):
        p = 1 / (1 + math.exp(-sum(weights[0][place[w]] for w in s.tolist()) - weights[0][-1]))
        q = 1 / (1 + math.exp(-sum(weights[1][place[w]] for w in s.tolist()) - weights[1][-2] * p - weights[1][-1]))
        first.append(((p >= cuts[0]) == a, (q >= cuts[1]) == b))
    assert np.mean(first, axis=0).min() > 0.95 and weights[1][-2] > 0


def test_held_out_remainder():
    assert zlib.crc32(b"12") % 7 == zlib.crc32(str(12).encode()) % 7


def test_contract_digests(spark):
    """Query 8 against plain Python, on the smallest tables."""
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    got = chat.op8_budgeted_windows(spark, data).toPandas().set_index("conv_id")
    conv = pd.read_parquet(f"{data}/conversations.parquet").fillna("")
    for c, g in conv.groupby("conv_id"):
        g = g.sort_values("turn")
        said = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))
        assert got.loc[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.loc[-7].n_turns == 2 and got.loc[-7].loss_chars == 21
