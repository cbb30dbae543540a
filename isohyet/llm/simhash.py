"""SimHash near-dedup with pigeonring filtering.

Two fingerprints of 64 bits within radius t, cut into m segments on a ring: from some segment on, the differences
of the first l segments together are at most l * t / m, for every l (the strong pigeonhole principle; Qin and Xiao,
"Pigeonring", 2018). For t = 4 and m = 5 that means: a segment without a difference, whose next segment has at most
one, so one half of the next is equal too. These bits, 19 or 20, are the index key: 10 keys for each fingerprint.
Pairs that share a key are pruned along the chain, and the last step of the chain is the full Hamming check.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, cut, table
from isohyet.llm.graph import components

RADIUS = 4
#: Segments from the lowest bit, as (first bit, bits).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that one task compares with each other; larger buckets are dealt out as pairs of parts.
PART = 1 << 15
#: Up to this size all links of a bucket are given, beyond it a spanning forest of them.
SMALL = 48
#: Buckets above that are divided by the next step of the chain.
FINER = 512
SHINGLE = 4
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    return int(fingerprints(pa.array([text], pa.string()), shingle)[0])


#: The eight bits of a byte as eight bytes of one number, so up to 255 of them add up side by side.
_SPREAD = np.array([sum((v >> i & 1) << 8 * i for i in range(8)) for v in range(256)], np.uint64)


def majority(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bits that over half of them have; 0 for empty runs."""
    out, n = np.zeros(len(ends) - 1, np.uint64), np.diff(ends)
    some = np.flatnonzero(n)
    if len(some):
        parts = -(-n[some] // 255)
        first = np.r_[0, np.cumsum(parts)[:-1]]
        block = np.repeat(ends[some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
        each = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
        sums = np.stack([np.add.reduceat(_SPREAD[each[:, k]], block) for k in range(8)], axis=1)
        count = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
        out[some] = np.packbits(2 * count > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: words lower-cased (A-Z), shingles joined by spaces; fewer words make one shingle."""
    out = np.zeros(len(texts), np.uint64)
    for first, data, offsets in T.chunks(texts):
        w = T.words(data, offsets)
        size, n = w.end - w.start, len(offsets) - 1
        # All words in a row, each with a space after it.
        at = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()) + 8, 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[~T.SPACE[w.data]]
        ends = np.searchsorted(w.doc, np.arange(n + 1))
        count = np.diff(ends)
        start = np.flatnonzero(np.arange(len(size)) <= ends[w.doc] + np.maximum(count[w.doc] - shingle, 0)) if len(size) else np.zeros(0, int)
        last = np.minimum(start + shingle, ends[w.doc[start] + 1]) - 1
        h = T.xxh64(joined, at[start], at[last] + size[last], SEED)
        out[first : first + n] = majority(h, np.searchsorted(w.doc[start], np.arange(n + 1)))
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long). Texts are taken whole, however long; further columns are left out."""
    arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp long")


def bits(fp: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def keys(fp: Column) -> Column:
    """The ten keys: start segment and half (in the high bits), the segment, the half of the next."""
    found = []
    for i, (first, n) in enumerate(SEGMENTS):
        nfirst, nn = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (a, k) in enumerate(((nfirst, nn // 2), (nfirst + nn // 2, nn - nn // 2))):
            found.append(F.shiftleft(bits(fp, first, n), 7).bitwiseOR(bits(fp, a, k)) + F.lit((2 * i + half) << 32))
    return F.array(*found)


def finer(fp: Column, key: Column) -> Column:
    """The three keys that divide a large bucket: by the chain's next step its first three segments differ in at most 2 bits.

    Beyond the key they hold a half of the second segment and two of the third, so one of these halves is equal, too.
    """
    found = []
    for i in range(len(SEGMENTS)):
        (a, n), (b, m) = SEGMENTS[(i + 1) % len(SEGMENTS)], SEGMENTS[(i + 2) % len(SEGMENTS)]
        third = [(b, m // 2), (b + m // 2, m - m // 2)]
        for other in ((a + n // 2, n - n // 2), (a, n // 2)):
            found.append(F.array(*[F.shiftleft(bits(fp, *p), 22) + F.lit((k + 1) << 20) for k, p in enumerate([other, *third])]))
    mine = F.element_at(F.array(*found), (F.shiftright(key, 32).bitwiseAND(F.lit(255)) + 1).cast("int"))
    return F.transform(mine, lambda x: key + x)


def chain(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which xors pass: from segment start on, l segments differ in at most l * RADIUS / 5 bits, for l = 1 to 5."""
    left = np.arange(len(x))
    masks = np.array([[sum(((1 << n) - 1) << a for a, n in [SEGMENTS[(i + j) % 5] for j in range(k)]) for i in range(5)] for k in range(1, 6)], np.uint64)
    for k in range(1, 6):
        left = left[np.bitwise_count(x[left] & masks[k - 1][start[left]]) <= k * RADIUS // 5]
    return left


def links(fps: DataFrame) -> DataFrame:
    """(s, fp), distinct -> (s, a, b): links within each s that connect all that links of RADIUS or less connect.

    s, from 0, numbers kinds of fingerprint that are not compared with each other.

    A bucket over FINER fingerprints is divided by further bits of the chain, so the pairs to compare grow little faster
    than the fingerprints. What is still over PART is dealt out as pairs of parts, so no task holds more than two parts.
    No pair is missed by either. Within a bucket over SMALL only links between so far unconnected fingerprints are given.
    """
    at = fps.select("s", "fp", F.explode(keys(F.col("fp"))).alias("key")).select("fp", (F.col("key") + F.shiftleft(F.col("s").cast("long"), 40)).alias("key"))
    dense = at.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FINER)
    divided = F.when(F.col("n").isNull(), F.array("key")).otherwise(finer(F.col("fp"), F.col("key")))
    at = at.join(dense, "key", "left").select("fp", F.explode(divided).alias("key"))
    large = at.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    g = F.ceil(F.coalesce("n", F.lit(1)) / PART)
    mine = F.pmod(F.xxhash64("fp"), g)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda j: F.least(mine, j) * 4294967296 + F.greatest(mine, j))
    dealt = at.join(large, "key", "left").select("key", F.explode(pairs).alias("pair"), "fp")
    arrow(fps.sparkSession)

    def flush(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), True]) if len(key) else np.array([0])
        size = np.diff(cuts)
        found = []
        run = np.repeat(np.arange(len(size)), size)
        start, kind = ((key >> 32) & 255) // 2, key >> 40
        inside = np.flatnonzero(size[run] <= SMALL) if len(key) else run
        for s in range(1, min(SMALL, size.max(initial=1))):
            i = inside[inside + s < len(key)]
            i = i[run[i] == run[i + s]]
            if not len(i):
                break
            ok = i[chain(fp[i] ^ fp[i + s], start[i])]
            found.append(np.stack([fp[ok], fp[ok + s], kind[ok].astype(np.uint64)]))
        for a, b in ((cuts[k], cuts[k + 1]) for k in np.flatnonzero(size > SMALL)):
            f, st = fp[a:b], start[a:b]
            label = np.arange(b - a)
            for i in range(len(f) - 1):
                j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                j = j[chain(f[j] ^ f[i], st[j])]
                if len(j):
                    other, k = np.unique(label[j], return_index=True)
                    found.append(np.stack([np.full(len(k), f[i]), f[j[k]], np.full(len(k), kind[a], np.uint64)]))
                    label[np.isin(label, other)] = label[i]
        e = (np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[2].astype(np.int32)), pa.array(e[0]), pa.array(e[1])], ["s", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        n = 0

        def take(whole: np.ndarray) -> pa.RecordBatch:
            return flush(whole[0].astype(np.int64), whole[1], whole[2].view(np.uint64))

        for b in batches:
            kept.append(np.stack([c.to_numpy() for c in b.columns]))
            n += b.num_rows
            if n >= 1 << 18:
                whole = np.concatenate(kept, axis=1)
                last = np.searchsorted(-((whole[:2, ::-1] == whole[:2, -1:]).all(0).astype(int)), 0)  # rows of the last bucket
                if last < n:
                    yield take(whole[:, : n - last])
                kept, n = [whole[:, n - last :]], last
        if n:
            yield take(np.concatenate(kept, axis=1))

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(run, "s int, a long, b long").distinct()


def near_groups(fps: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): smallest doc_id that links of RADIUS or less reach.

    Copies meet as one fingerprint, so a group of copies costs one row per key however large it is. Null ids keep a
    row; they are no group's smallest unless all its ids are null. Null and empty texts have fingerprint 0, like any
    other; ties and repeated rows keep a row each. An empty table gives an empty table; further columns are left out.
    """
    fps = cut(fps, "fingerprints")
    each = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(each.select(F.lit(0).alias("s"), "fp")))
    own = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(own.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_pigeonring_groups(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: fingerprint in hex, smallest doc_id of its group. See near_groups()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(with_fingerprints(docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted for the rare-first order. The order decides how much work there is, not what is found.
SAMPLE = 40_000
#: Up to this size all pairs of a bucket are verified at once; larger ones are linked by stars and chains first.
FEW = 3
#: Texts that candidates need are marked by their hash modulo this, so that few others are moved.
MARKS = 1 << 24
#: Texts of the commonest root that a turn compares with all of a bucket, and turns before all pairs of different roots.
STARS, TURNS = 4, 2
#: Earlier shared shingles of a text that tell a pair which has met in another bucket.
BEFORE = 3
#: Texts of a bucket of shared shingles that one task compares with each other.
BLOCK = 1 << 12


def shingles(texts: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes of shingles, where each text's start) for runs of texts.

    Hashes are sorted in each text, repeats included; fewer words than k make one shingle.
    """
    for first, data, offsets in T.chunks(texts):
        w = T.words(data, offsets)
        g, at = T.grams(w.hash, w.doc, k)
        n = np.bincount(w.doc, minlength=len(offsets) - 1)
        gs, docs = [g], [w.doc[at]]
        for i in np.flatnonzero((n > 0) & (n < k)):
            gs.append(T.grams(w.hash[w.doc == i], np.zeros(n[i], int), int(n[i]))[0])
            docs.append(np.array([i]))
        g, doc = np.concatenate(gs), np.concatenate(docs)
        order = np.lexsort((g, doc))
        yield first, g[order], np.searchsorted(doc[order], np.arange(len(offsets)))


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[bytes]:
    """Sorted hashes of each text's shingles, repeats included; fewer words than k make one shingle."""
    out = [b""] * len(texts)
    for first, g, ends in shingles(texts, k):
        for i in range(len(ends) - 1):
            out[first + i] = g[ends[i] : ends[i + 1]].tobytes()
    return out


def numbered(g: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, text of each): the n-th repeat of a shingle in a text is a token of its own, so multisets become sets."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    i = np.arange(len(g))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    nth = (i - np.maximum.accumulate(np.where(new, i, 0))).astype(np.uint64)
    return np.where(nth > 0, T.mix(g + nth * np.uint64(0x9E3779B97F4A7C15)), g), doc


#: Longs of a text's parity bits, and what they are folded to where a bucket gives no more than a few pairs a text.
PARITY, FOLDED = 16, 4


def parities(token: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 * PARITY bits of each set of tokens, each whether an odd number of tokens falls on it (PARITY x sets).

    What two sets have in common cancels out, so they differ in at least as many tokens as their parities in bits.
    """
    out = np.zeros((PARITY, len(ends) - 1), np.uint64)
    some = np.flatnonzero(np.diff(ends))
    place, bit = (token >> np.uint64(40)) % np.uint64(PARITY), np.uint64(1) << (token >> np.uint64(48) & np.uint64(63))
    if len(some):
        for k in range(PARITY):
            out[k, some] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), ends[some])
    return out


def prefixes(texts: pa.Array, common: np.ndarray, rank: np.ndarray, least: float) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Number of shingles of each text, as many of them, rare first, that texts of `least` similarity share one, SimHash and parities.

    A text of n shingles shares at least ceil(least * n) with a similar one, so in any order that all texts follow, the
    first n - ceil(least * n) + 1 of both have one in common.
    """
    size, out, fps = np.zeros(len(texts), np.int32), [b""] * len(texts), np.zeros(len(texts), np.uint64)
    odd = np.zeros((PARITY, len(texts)), np.uint64)
    for first, g, ends in shingles(texts):
        fps[first : first + len(ends) - 1] = majority(g, ends)
        token, doc = numbered(g, ends)
        odd[:, first : first + len(ends) - 1] = parities(token, ends)
        key = token >> np.uint64(3)
        if len(common):
            at = np.minimum(np.searchsorted(common, token), len(common) - 1)
            key |= np.where(common[at] == token, rank[at], np.uint64(0)) << np.uint64(61)
        key = key[np.lexsort((key, doc))]
        n = np.diff(ends)
        size[first : first + len(n)] = n
        m = np.minimum(n, n - np.ceil((least - 1e-9) * n).astype(int) + 1)
        for i in range(len(n)):
            out[first + i] = key[ends[i] : ends[i] + m[i]].tobytes()
    return size, out, fps, odd


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Sorted rows of longs as arrays (columns x rows) of whole buckets: rows that agree in the first columns."""
    kept: list[np.ndarray] = []
    n = 0
    for b in batches:
        kept.append(np.stack([c.to_numpy() for c in b.columns]))
        n += b.num_rows
        if n >= 1 << 17:
            whole = np.concatenate(kept, axis=1)
            other = np.flatnonzero((whole[:keys] != whole[:keys, -1:]).any(0))
            cut_at = other[-1] + 1 if len(other) else 0
            if cut_at:
                yield whole[:, :cut_at]
            kept, n = [whole[:, cut_at:]], n - cut_at
    if n:
        yield np.concatenate(kept, axis=1)


def buckets(key: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted keys (keys x rows) start, and the end."""
    return np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])


def index(texts: DataFrame) -> DataFrame:
    """(th, n, prefix) -> (key, th, n, pos): shingles of prefixes that several texts have, and their place in each.

    Rows pass in order of the key and are told by their neighbours, so a shingle of very many texts is never held whole.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
            m = np.array([len(x) for x in ps], int)
            pos = np.concatenate([np.arange(x) for x in m] or [m])
            cols = [np.concatenate(ps or [m]), *(np.repeat(b.column(i).to_numpy().astype(np.int64), m) for i in (0, 1)), pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "th", "n", "pos"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = np.zeros((4, 0), np.int64), False
        for b in batches:
            rows = np.concatenate([last, np.stack([c.to_numpy() for c in b.columns])], axis=1)
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.r_[again, same] | np.r_[same, False]
            # The last row waits for the next batch, whose first row may have its key.
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, :-1][:, keep[:-1]]], ["key", "th", "n", "pos"])
            last, again = rows[:, -1:], bool(keep[-1])
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["key", "th", "n", "pos"])

    kind = "key long, th long, n long, pos long"
    at = texts.select("th", "n", "prefix").where("n > 0").mapInArrow(explode, kind)
    return at.repartition("key").sortWithinPartitions("key").mapInArrow(shared, kind)


def folded(longs: int | None) -> list[Column]:
    """Elements of the array odds, or fewer longs of parity bits that each hold several of them: sums of parities are parities."""
    some = longs or PARITY
    return [functools.reduce(Column.bitwiseXOR, [F.col("odds")[i] for i in range(k, PARITY, some)]).alias(f"odd{k}") for k in range(some)]


def prefix_pairs(index: DataFrame, large: DataFrame, least: float, turn: int | None) -> DataFrame:
    """(key, th, n, pos, root, odds), (key, c) -> (a, b), a < b, distinct: pairs of texts that share a key, differ in root and may be similar.

    All such pairs without a turn, else in buckets over FEW only a chain, and stars around some texts of the commonest
    root; each turn takes other texts. At their first common key similar
    texts have enough shingles left on both sides, and their parities differ in no more bits than they may in shingles, so
    pairs that fail either are left out; no similar one does. All pairs of a bucket are told by all parity bits: of many near
    copies just under the limit most have differing shingles that cancel out in a few bits, few in many. There a pair that
    also has one of the last BEFORE shared shingles in common is left to that one's bucket, where it has more shingles left,
    so a pair is not given once for each shingle that copies share, and its first bucket always gives it. A bucket over BLOCK texts, in `large` with its size, is dealt
    out as pairs of parts, so no task holds more than two parts and no pair is missed.
    """
    t = (least - 1e-9) / (1 + least - 1e-9)
    g = F.ceil(F.coalesce("c", F.lit(1)) / BLOCK)
    mine = F.pmod(F.xxhash64("th"), g)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda j: F.least(mine, j) * 4294967296 + F.greatest(mine, j))
    before = [] if turn is not None else [F.coalesce(F.lag("key", k).over(Window.partitionBy("th").orderBy("pos")), "key").alias(f"before{k}") for k in range(1, BEFORE + 1)]
    index = index.select("key", "th", "n", "pos", "root", *before, *folded(None if turn is None else FOLDED))
    dealt = index.join(large, "key", "left").select("key", F.explode(pairs).alias("pair"), *index.columns[1:])

    earlier = len(before)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, 2):
            th, n, pos, root = whole[2:6]
            left, past, odd = n - pos, whole[6 : 6 + earlier], whole[6 + earlier :].view(np.uint64)

            def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                ok = np.flatnonzero((root[i] != root[j]) & (np.minimum(left[i], left[j]) >= t * (n[i] + n[j]) - 1e-6))
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(odd[:, i] ^ odd[:, j]).sum(0, dtype=np.int64) <= (1 - 2 * t) * (n[i] + n[j]) + 1e-6
                i, j = i[ok], j[ok]
                met = np.zeros(len(i), bool)
                for a in past:
                    for b in past:  # a text's first shingles have their own key for an earlier one
                        met |= (a[i] == b[j]) & (a[i] != whole[0, i])
                return th[i[~met]], th[j[~met]]

            cuts = buckets(whole[:2])
            size = np.diff(cuts)
            many = np.repeat(size > FEW, size)
            run = np.repeat(np.arange(len(size)), size)
            small = np.flatnonzero(~many)
            found = []
            for s in range(1, FEW):
                i = small[small + s < len(th)]
                i = i[run[i] == run[i + s]]
                found.append(fit(i, i + s))
            if turn is not None:
                first = buckets(whole[[0, 1, 5]])
                length, first = np.diff(first), first[:-1]
                best = np.lexsort((-length, run[first]))
                best = best[np.flatnonzero(np.r_[True, run[first][best][1:] != run[first][best][:-1]])]
                i = np.flatnonzero(many)
                for s in range(STARS):
                    found.append(fit((first[best] + np.minimum(s, length[best] - 1))[run[i]], i))
                i = i[i + 1 < len(th)]
                i = i[run[i] == run[i + 1]]
                found.append(fit(i, i + 1))
            else:
                for a, b in ((cuts[k], cuts[k + 1]) for k in np.flatnonzero(size > FEW)):
                    for i in range(a, b - 1):
                        j = np.arange(i + 1, b)
                        found.append(fit(np.full(len(j), i), j))
                    if sum(len(x) for x, _ in found[-(b - a) :]) > 1 << 18:
                        yield from out(found)
                        found = []
            yield from out(found)

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "root", F.xxhash64("th", F.lit(turn or 0))).mapInArrow(find, "a long, b long").where("a <> b").distinct()


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """(th, n, fp) -> (a, b), a < b: texts of equal SimHash with the first of them, and those first texts within RADIUS."""
    some = texts.where("n > 0").select("th", "fp")
    first = cut(some.groupBy("fp").agg(F.min("th").alias("first")), "distinct-fingerprints")
    near = links(first.select(F.lit(0).alias("s"), "fp")).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    equal = some.join(first, "fp").where("th <> first").select(F.col("first").alias("x"), F.col("th").alias("y"))
    return near.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sorted multisets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Keeps one document of each group of near duplicates, with the columns of docs.

    Texts are linked if the weighted similarity of their five-word shingles is at least `least`; groups are what links
    connect. First the pairs whose SimHashes pass the pigeonring chain are verified. Texts that differ by a block are
    often farther apart than that, but every pair at 0.8 shares a shingle of its prefixes (see prefixes()): a turn verifies
    a few pairs of each bucket, then come all pairs that are still in different groups, so no link between groups is missed.
    The smallest doc_id of a group stays (nulls first), once. Null counts as empty, texts without words are one group;
    long texts are compared whole. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    arrow(spark)
    keyed = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).withColumn("__th", F.xxhash64("__text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, g, ends in shingles(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(numbered(g, ends)[0].view(np.int64))], ["t"])

    few = keyed.where(F.pmod("__th", F.lit(docs.count() // SAMPLE + 1)) == 0).select("__text").distinct()
    often = few.mapInArrow(tokens, "t long").groupBy("t").agg(F.count("*").alias("n")).where("n > 2").toArrow()
    common = often["t"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    rank = np.clip(np.log2(often["n"].to_numpy()[order].astype(float)), 1, 7).astype(np.uint64)
    known = spark.sparkContext.broadcast((common[order], rank))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prefix, fp, odd = prefixes(b.column(2), *known.value, least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(prefix, pa.binary()), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * PARITY, odd.T.ravel().view(np.int64))], ["id", "th", "n", "prefix", "fp", "odds"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.select("doc_id", "__th", "__text").mapInArrow(heads, f"id {ids}, th long, n int, prefix binary, fp long, odds array<long>")
    texts = cut(rows.groupBy("th").agg(F.min(F.struct("id")).alias("first"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("prefix", "fp", "odds")]), "texts")
    at = cut(index(texts), "shared-shingles")
    large = cut(at.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK), "large-buckets")

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = [[np.frombuffer(x, np.uint64) for x in shingle_sets(t)] for t in (a, b)]
        return pa.array([similarity(x, y) for x, y in zip(*sets)], pa.float64())

    def verified(edges: DataFrame) -> DataFrame:
        wanted = edges.select(F.explode(F.array("a", "b")).alias("th")).select(F.pmod("th", F.lit(MARKS)).alias("m")).distinct().toArrow()
        marks = np.zeros(MARKS, bool)
        marks[wanted["m"].to_numpy()] = True
        marked = spark.sparkContext.broadcast(np.packbits(marks))

        @F.arrow_udf("boolean")
        def asked(th: pa.Array) -> pa.Array:
            m = th.to_numpy() % MARKS
            return pa.array((marked.value[m >> 3] >> (7 - (m & 7)).astype(np.uint8) & 1).astype(bool))

        # Texts, not sets of hashes: they take less than half the disk, and shingling them again is cheap.
        some = keyed.select(F.col("__th").alias("th"), F.col("__text").alias("t")).where(asked("th"))
        have = cut(some.groupBy("th").agg(F.first("t").alias("t")), "candidate-texts")
        pairs = edges.join(have.select(F.col("th").alias("a"), F.col("t").alias("ta")), "a").join(have.select(F.col("th").alias("b"), F.col("t").alias("tb")), "b")
        return cut(pairs.withColumn("sim", alike("ta", "tb")).where(F.col("sim") >= least - 1e-9).select("a", "b"), "links")

    wordless = texts.where("n = 0").select("th")
    linked = wordless.crossJoin(wordless.agg(F.min("th").alias("m"))).select(F.col("m").alias("a"), F.col("th").alias("b"))
    tried = None
    for turn in ["simhash", *range(TURNS), None]:
        edges = simhash_pairs(texts) if turn == "simhash" else prefix_pairs(rooted, large, least, turn)
        edges = cut(edges.join(tried, ["a", "b"], "left_anti") if tried else edges, "candidates")
        tried = tried.unionByName(edges) if tried else edges
        roots = components(linked.unionByName(verified(edges)))
        linked = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        own = texts.join(roots, F.col("th") == F.col("node"), "left").select("th", F.coalesce("root", "th").alias("root"), "odds")
        rooted = at.join(own, "th")
    group = texts.join(roots, F.col("th") == F.col("node"), "left").select("th", "first", F.coalesce("root", "th").alias("root"))
    stay = group.groupBy("root").agg(F.min(F.struct("first", "th")).alias("s")).select(F.col("s.th").alias("__t"), F.col("s.first.id").alias("__i"))
    kept = keyed.join(stay, (F.col("__th") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__i")))
    rank = F.row_number().over(Window.partitionBy("__th").orderBy(F.lit(0)))
    return kept.withColumn("__rank", rank).where("__rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
