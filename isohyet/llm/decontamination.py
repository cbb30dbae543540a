"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document is as long as the benchmark item that it is compared with. To reach SIMILARITY it must hold one
of the item's rarest shingles: of n, repeats counted, it shares 0.8 n at least, so it can't lack more than the rest of
them. Items are filed under these shingles, and a window that holds one gets a 64-bit SimHash, which meets the items of
that bucket alone. A bucket of at most SMALL items is read through; a larger one has a multi-index over blocks of its
fingerprints, which finds all within RADIUS. Candidates are verified by the exact weighted similarity of shingle
multisets: sum of minima over sum of maxima.

At a similarity of exactly 0.8 fingerprints differ in 10 bits, give or take 3. Of 20,000 simulated pairs at that edge the
radius kept all at 9 shingles and from 0.9996 to 0.9999 at 18, 27, 45, 90, 180 and 450; more similar pairs are nearer.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, table
from isohyet.llm.toxicity import Lookup

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Bits of a fingerprint's blocks, and how many of them may differ. Two fingerprints that differ in more than that in
#: each block differ in 4 + 4 + 4 + 3 + 3 + 3 = 21 bits at least.
BLOCKS = ((11, 3), (11, 3), (11, 3), (11, 2), (10, 2), (10, 2))
#: Items of a bucket that are compared one by one; the multi-index looks up 875 values for a query.
SMALL = 1000
#: Items of one function on columns; a worker keeps those of all packs.
PACK = 20_000
#: Shingles whose bits are summed at once, and pairs that are compared at once.
SPAN, PAIRS = 1 << 16, 1 << 20


def simhashes(g: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles from each start, which ascend."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = int(np.searchsorted(start, start[at] + SPAN))
        low, high = int(start[at]), int(start[to - 1]) + n
        bits = np.unpackbits(g[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        s = start[at:to] - low
        out[at:to] = np.packbits(2 * (total[s + n] - total[s]) > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = to
    return out


class MultiIndex:
    """All fingerprints within RADIUS of a query: filed by each block's value, looked up by all values near the query's."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.blocks, shift = fps, [], 0
        for width, most in BLOCKS:
            value = self.value(fps, shift, width)
            order = np.argsort(value, kind="stable")
            flips = np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)])
            self.blocks.append((shift, width, flips, order, np.searchsorted(value[order], np.arange((1 << width) + 1))))
            shift += width

    @staticmethod
    def value(fps: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's index, item's index)."""
        found = []
        for first in range(0, len(fps), 256):
            some = fps[first : first + 256]
            for shift, width, flips, order, cut in self.blocks:
                slot = (self.value(some, shift, width)[:, None] ^ flips).reshape(-1)
                n = cut[slot + 1] - cut[slot]
                q = np.repeat(np.arange(len(slot)) // len(flips), n)
                i = order[np.repeat(cut[slot] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                ok = np.bitwise_count(some[q] ^ self.fps[i]) <= RADIUS
                found.append((q[ok] + first) * len(self.fps) + i[ok])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // len(self.fps), pair % len(self.fps)


def rarest(item: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the items' distinct shingles, rows by item, are filed: those that few items own, until no window without them reaches SIMILARITY."""
    _, which, owners = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((keys, owners[which], item))
    total = np.cumsum(counts[order])
    first = np.searchsorted(item, item)  # of the item, in this order too
    before = total - counts[order] - np.r_[0, total][first]
    return order[before < n[item] - np.ceil(SIMILARITY * n[item] - 1e-6) + 1]


class Buckets:
    """Items of shingles of k words: for each rare shingle and number of shingles, the items that are filed there."""

    def __init__(self, h: np.ndarray, n: np.ndarray, item: np.ndarray, fps: np.ndarray):
        """Rows: a shingle, its item's number of shingles, the item."""
        order = np.lexsort((item, n, h))
        h, n, item = h[order], n[order], item[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (n[1:] != n[:-1])])
        keys, first = np.unique(h[new], return_index=True)
        self.look, self.of = Lookup(keys), np.r_[first, len(new)]
        self.n, self.item, self.ends, self.fps = n[new], item, np.r_[new, len(item)], fps
        self.large: dict[bytes, MultiIndex] = {}

    def near(self, b: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's index, item) within RADIUS in bucket b."""
        items = self.item[self.ends[b] : self.ends[b + 1]]
        if len(items) > SMALL:
            key = items.tobytes()  # alike items share many buckets
            if key not in self.large:
                self.large[key] = MultiIndex(self.fps[items])
            q, i = self.large[key].near(fps)
            return q, items[i]
        step, found = max(1, PAIRS // len(items)), []
        for first in range(0, len(fps), step):
            q, i = np.nonzero(np.bitwise_count(fps[first : first + step, None] ^ self.fps[items]) <= RADIUS)
            found.append((q + first, items[i]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Finder:
    """Finds a pack of items in texts. An item of fewer words than a shingle has one shingle, all its words."""

    def __init__(self, texts: pa.Array):
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        fps, n = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
        rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for first, data, offsets in T.chunks(texts):
            w = T.words(data, offsets, separators=T.PUNCT)
            size = np.minimum(np.bincount(w.doc, minlength=len(offsets) - 1), SHINGLE)[w.doc]
            for k in np.unique(size).tolist():
                doc = w.doc[size == k]
                g, at = T.grams(w.hash[size == k], doc, k)
                item = first + doc[at]
                start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
                n[item[start]] = np.diff(np.r_[start, len(item)])
                bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                over = 2 * np.add.reduceat(bits, start, axis=0, dtype=np.int32) > n[item[start], None]
                fps[item[start]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
                rows[k].append((item, g))
        self.by_k = {}
        for k, parts in rows.items():
            item, g = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((g, item))
            item, g = item[order], g[order]
            new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (g[1:] != g[:-1])])
            item, keys, counts = item[new], g[new], np.diff(np.r_[new, len(g)])
            start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            for x, i, j in zip(item[start].tolist(), start, np.r_[start[1:], len(item)]):
                self.shingles[x] = keys[i:j], counts[i:j]
            filed = rarest(item, keys, counts, n)
            self.by_k[k] = Buckets(keys[filed], n[item[filed]], item[filed], fps)

    def __call__(self, texts: pa.Array) -> list[list[tuple[int, int, int, float]]]:
        """(item, first word, words, similarity) of each text's leaks."""
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(texts))]
        for first, data, offsets in T.chunks(texts):
            w = T.words(data, offsets, separators=T.PUNCT)
            for k, buckets in self.by_k.items():
                g, at = T.grams(w.hash, w.doc, k)
                hit, place = buckets.look(g)
                doc = w.doc[at]
                for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(doc[hit])) + 1) if len(hit) else ():
                    d = int(doc[hit[part[0]]])
                    low, high = (int(x) for x in np.searchsorted(doc, [d, d + 1]))
                    found[first + d] += [(x, s, m + k - 1, sim) for x, s, m, sim in self.windows(g[low:high], hit[part] - low, place[part], buckets)]
        for leaks in found:
            leaks.sort(key=lambda r: (r[1], r[0]))
        return found

    def windows(self, g: np.ndarray, hit: np.ndarray, place: np.ndarray, buckets: Buckets) -> Iterator[tuple[int, int, int, float]]:
        """(item, start, shingles, similarity) of a text's windows that pass; of overlapping ones for an item, the best.

        g: the text's shingles, hit: which of them are filed, place: under which key.
        """
        count = buckets.of[place + 1] - buckets.of[place]
        b = np.repeat(buckets.of[place] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        p, n = np.repeat(hit, count), buckets.n[b]
        for size in np.unique(n).tolist():
            m = min(size, len(g))
            if m < SIMILARITY * size - 1e-6:
                continue
            mine = np.flatnonzero(n == size)
            start = covering(p[mine], m, len(g))
            fps, pairs = simhashes(g, start, m), []
            order = mine[np.argsort(b[mine], kind="stable")]
            for some in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                own = np.searchsorted(start, covering(p[some], m, len(g)))
                q, x = buckets.near(int(b[some[0]]), fps[own])
                pairs.append(x * len(start) + own[q])
            pair = np.unique(np.concatenate(pairs))
            passed: dict[int, list[tuple[float, int]]] = defaultdict(list)
            for x, s in zip((pair // len(start)).tolist(), start[pair % len(start)].tolist()):
                both = self.shared(x, g[s : s + m])
                if both >= SIMILARITY * (size + m - both) - 1e-9:
                    passed[x].append((-both / (size + m - both), s))
            for x, ws in passed.items():
                kept: list[int] = []
                for sim, s in sorted(ws):
                    i = bisect(kept, s)
                    if (i == 0 or s - kept[i - 1] >= m) and (i == len(kept) or kept[i] - s >= m):
                        insort(kept, s)
                        yield x, s, m, -sim

    def shared(self, x: int, g: np.ndarray) -> int:
        """Sum of the minima of the counts of item x and of shingles g."""
        keys, counts = self.shingles[x]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return int(np.minimum(np.bincount(at[keys[at] == g], minlength=len(keys)), counts).sum())


def covering(p: np.ndarray, m: int, n: int) -> np.ndarray:
    """Starts of the windows of m of n shingles that hold one of the places p, ascending."""
    edge = np.zeros(n - m + 2, np.int64)
    np.add.at(edge, np.maximum(p - m + 1, 0), 1)
    np.add.at(edge, np.minimum(p, n - m) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


_FINDERS: dict[tuple[str, int], Finder] = {}


def finder(ids: pa.Array, texts: pa.Array, kind: str, plan: str, number: int):
    """The search for a pack as a function on columns; a worker builds it once and keeps all packs of a plan."""
    one = pa.struct([("item_id", ids.type), ("start", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())])

    @F.arrow_udf(f"array<{kind}>")
    def find(x: pa.Array) -> pa.Array:
        if (plan, number) not in _FINDERS:
            for other in [k for k in _FINDERS if k[0] != plan]:
                del _FINDERS[other]
            _FINDERS[plan, number] = Finder(texts)
        found = _FINDERS[plan, number](x)
        item, start, words, sim = ([r[c] for leaks in found for r in leaks] for c in range(4))
        rows = pa.StructArray.from_arrays([ids.take(pa.array(item, pa.int64())), pa.array(start, pa.int32()), pa.array(words, pa.int32()), pa.array(sim, pa.float64())], fields=list(one))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)

    return find


def leaks(benchmark: DataFrame, text: Column, pack: int = PACK) -> Column:
    """An array of the benchmark items found in a text: item_id, first word, words, similarity, by first word and item_id.

    Words are lower-cased (A-Z) runs of letters and digits. Null and empty texts have no leaks, items without words
    are never found, equal items are all found. item_id has any type that sorts and may be null or repeat. Texts are
    searched whole, however long; a text shorter than an item is one window. Of overlapping windows for an item the most
    similar stays, of equally similar ones the first. Other columns of benchmark are ignored.

    The benchmark, not the documents, is held in memory: by the driver, and as an index by each worker, which took 20 KB
    an item while it was built for 20,000 items of 100 words.
    """
    arrow(benchmark.sparkSession)
    items = benchmark.select("item_id", "text").sort("item_id", "text").toArrow()
    ids, texts = items["item_id"].combine_chunks(), items["text"].combine_chunks()
    plan = xxhash.xxh64_hexdigest(repr((ids.to_pylist(), texts.to_pylist())).encode("utf-8", "replace"))
    kind = f"struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},start:int,words:int,similarity:double>"
    found = [finder(ids.slice(k, pack), texts.slice(k, pack), kind, plan, k)(text) for k in range(0, len(texts), pack)]
    if not found:
        return F.when(F.lit(False), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    return F.concat(*found) if len(found) > 1 else found[0]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with the columns of docs, whatever these are called besides text.

    A null or empty text has no leak and stays; rows that repeat are judged alike. An empty benchmark keeps all.
    """
    return docs.where(F.size(leaks(benchmark, F.col("text"))) == 0)


def op3_simhash_windows(spark, sf_dir: str) -> DataFrame:
    """A row for each item found in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(leaks(table(spark, sf_dir, "benchmark"), F.col("text"))).alias("leak"))
    return found.select("doc_id", "leak.*")
