"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

A string of SPAN bytes repeats if it starts anywhere else, in the same text or another; so does a string of WORDS
words, which is reported and not removed. All windows of one length whose smallest gram hash sits at the same place
share an anchor there, so equal windows have equal anchors, and only anchors whose gram repeats matter. Of these,
windows of an anchor whose whole context (from its first window's start to its last one's end) repeats are all repeats;
that is told by a hash of the context. What is left, the contexts at the edges of repeats, is dealt out by anchor hash,
and each task keeps a family of sparse suffix arrays over anchored contexts: a new batch is sorted into an array of its
own, merge-scanned against the arrays there are for long matches, and arrays of equal class are merged, so there are
only logarithmically many. Matches are read off the neighbours in suffix order: a window that starts b units before the
anchor is equal in two contexts if they agree in b units before it and in the rest of the span after it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, cut, table


class Unit(NamedTuple):
    """What windows are made of: their length and that of grams in units, bytes of a unit in contexts."""

    span: int
    gram: int
    width: int

    @property
    def back(self) -> int:
        """Units from a window's start to its anchor, at most."""
        return self.span - self.gram


SPAN, WORDS = 400, 50
#: Windows of bytes, and of words as 64-bit hashes. Long windows of few grams make anchors rare: one in 150 bytes, or 21 words.
UNITS = (Unit(SPAN, 100, 1), Unit(WORDS, 9, 8))
#: Contexts in a batch of the family, and in a family before it gives its results.
BATCH, FAMILY = 4096, 16_384
#: Bytes of text that are scanned for anchors together; arrays take some hundred times that.
CHUNK = 1 << 18
#: An anchor with more different contexts than that is compared by window hashes, spread over all tasks: in one task it
#: would be a group without a bound.
HOT = 1 << 15
_PLACE = np.uint64((1 << 28) - 1)


class Prefix:
    """Hashes of ranges of units."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        self.up, self.down = T.powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((T.mix(values + np.uint64(salt)) if salt else values) * self.up[: len(values)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix((self.total[end] - self.total[start]) * self.down[start])


def pack(low: np.ndarray, windows: np.ndarray, anchor: np.ndarray, unit: int) -> np.ndarray:
    """One long of a context: first window, windows after it, the anchor's place after it, the unit."""
    return (low.astype(np.int64) << 22) | (windows.astype(np.int64) << 12) | (anchor.astype(np.int64) << 2) | unit


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 22, (at >> 12) & 1023, (at >> 2) & 1023, at & 3


def anchors(values: np.ndarray, offsets: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, context hash, packed place from the text's start) of a chunk of texts in units."""
    span, gram, _ = unit = UNITS[kind]
    n, w = len(values), unit.back + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 4
    prefix = Prefix(values)
    at = np.arange(n - gram + 1)
    h = T.mix(prefix(at, at + gram) + np.uint64(kind))
    key = np.full(-(-len(at) // w) * w, ~np.uint64(0))
    key[: len(at)] = (h & ~_PLACE) | at.astype(np.uint64)
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - span + 1], ahead[w - 1 : w + n - span])
    inside = np.zeros(n + 2, np.int64)
    first, stop = offsets[:-1], offsets[1:] - span + 1
    long = stop > first
    np.add.at(inside, first[long], 1)
    np.add.at(inside, stop[long], -1)
    p = np.flatnonzero(np.cumsum(inside)[: n - span + 1])
    a = (least[p] & _PLACE).astype(np.int64)
    doc = np.searchsorted(offsets, p, "right") - 1
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    low, high, a, doc = p[run], p[np.r_[run[1:], len(p)] - 1] if len(p) else p, a[run], doc[run]
    c = T.mix(prefix(low, high + span) + ((a - low) << 32).astype(np.uint64) + (high - low).astype(np.uint64))
    return doc, h[a], c, pack(low - offsets[doc], high - low, a - low, kind)


class Family:
    """Sparse suffix arrays of anchored contexts. A level is a sorted array of context numbers."""

    def __init__(self, unit: Unit):
        self.unit, self.levels = unit, []
        # Units from the anchor on, and units before it from the anchor back; how many of each.
        self.right, self.left = np.zeros(0, f"S{unit.span * unit.width}"), np.zeros(0, f"S{unit.back * unit.width}")
        self.after, self.before = np.zeros(0, int), np.zeros(0, int)
        self.hit = np.zeros((0, unit.back + 1), bool)  # by units from the window's start to the anchor

    def add(self, batch: list[tuple[bytes, int]]) -> None:
        """Contexts as (bytes, anchor's place in units)."""
        if not batch:
            return
        (span, _, w), since = self.unit, len(self.after)
        self.right = np.concatenate([self.right, np.array([c[a * w : (a + span) * w] for c, a in batch], self.right.dtype)])
        self.left = np.concatenate([self.left, np.array([c[: a * w][::-1] for c, a in batch], self.left.dtype)])
        self.after = np.r_[self.after, [min(span, len(c) // w - a) for c, a in batch]]
        self.before = np.r_[self.before, [a for _, a in batch]]
        self.hit = np.concatenate([self.hit, np.zeros((len(batch), self.unit.back + 1), bool)])
        new = self.sort(np.arange(since, len(self.after)))
        self.scan(new)
        for level in self.levels:
            both = self.sort(np.concatenate([level, new]))
            run = np.r_[0, np.cumsum(self.common(self.right, self.after, both) < self.unit.gram)]
            fresh = np.bincount(run, both >= since)
            mixed = (fresh > 0) & (fresh < np.bincount(run))
            self.scan(both[mixed[run]])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [self.sort(np.concatenate(self.levels[-2:]))]

    def sort(self, ids: np.ndarray) -> np.ndarray:
        return ids[np.lexsort((self.after[ids], self.right[ids]))]

    def common(self, values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Units that neighbours in an order agree in."""
        rows = np.ascontiguousarray(values[order]).view(np.uint8).reshape(len(order), -1)
        out = np.zeros(max(0, len(order) - 1), int)
        for i in range(0, len(out), BATCH):
            same = rows[i : i + BATCH + 1]
            same = same[1:] == same[:-1]
            out[i : i + BATCH] = np.where(same.all(1), same.shape[1], same.argmin(1)) // self.unit.width
        return np.minimum(out, np.minimum(sizes[order][1:], sizes[order][:-1]))

    def scan(self, order: np.ndarray) -> None:
        """Marks the windows that some two contexts of a suffix order share."""
        if len(order) < 2:
            return
        linked = self.common(self.right, self.after, order) >= self.unit.gram
        some = np.r_[linked, False] | np.r_[False, linked]
        if not some.any():
            return
        # Dropping contexts without a partner parts no others: a run of agreement has no such context in it.
        order, n = order[some], int(some.sum())
        after = self.common(self.right, self.after, order)
        back = np.lexsort((self.before[order], self.left[order]))
        before = self.common(self.left, self.before, order[back])
        side = np.empty(n, np.int64)
        for b in range(self.unit.back + 1):
            side[back] = np.r_[0, np.cumsum(before < b)]
            at = np.flatnonzero((self.after[order] >= self.unit.span - b) & (self.before[order] >= b))
            if not len(at):
                continue
            code = np.r_[0, np.cumsum(after < self.unit.span - b)][at] * n + side[at]
            by = np.argsort(code)
            same = code[by][1:] == code[by][:-1]
            self.hit[order[at[by[np.r_[same, False] | np.r_[False, same]]]], b] = True


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def in_units(data: np.ndarray, offsets: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a chunk of texts in units: a number for each byte, a hash for each word (case counts)."""
    if not kind:
        return T._TABLE[data], offsets
    w = T.words(data, offsets, table=None)
    return w.hash, np.searchsorted(w.doc, np.arange(len(offsets)))


def find(docs: DataFrame) -> DataFrame:
    """(__key, text) -> (__key, spans): packed runs of starts of repeated windows of both units, for each key."""
    arrow(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            for first, data, offsets in T.chunks(b.column(1), CHUNK):
                for kind in range(len(UNITS)):
                    doc, h, c, at = anchors(*in_units(data, offsets, kind), kind)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([pa.array(key[doc + first]), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at)], ["__key", "h", "c", "at"])

    found = cut(docs.mapInArrow(scan, "__key long, h long, c long, at long"), "anchors")
    # Written apart, so the joins have two plain shuffles and adaptive execution can split a hot hash.
    again = cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-grams")
    seen = cut(found.join(again, "h", "left_semi"), "repeated-anchors")
    kinds = cut(seen.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("__key", "at")).alias("one")), "contexts")
    whole = seen.join(kinds.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("__key", "at")
    # A kind that has rows enough is only there for others to match; its own windows are known to repeat.
    edges = cut(kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("h", (F.col("m") > HOT).alias("hot")), "mixed-grams")
    want = kinds.join(edges, "h").select("one.__key", F.struct("h", "one.at", "hot", (F.col("n") == 1).alias("open")).alias("want"))
    want = want.groupBy("__key").agg(F.collect_list("want").alias("wants"))
    shape = {"h": pa.int64(), "__key": pa.int64(), "at": pa.int64(), "hot": pa.bool_(), "open": pa.bool_(), "context": pa.binary()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = defaultdict(list)
            for key, text, wants in zip(*(b.column(i) for i in range(3))):
                raw, words = (text.as_py() or "").encode(), None
                for w in wants.as_py():
                    low, windows, _, kind = unpack(w["at"])
                    if kind and words is None:
                        words = in_units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), kind)[0]
                    end = low + windows + UNITS[kind].span
                    for c, x in (("h", w["h"]), ("__key", key.as_py()), ("at", w["at"]), ("hot", w["hot"]), ("open", w["open"]), ("context", words[low:end].tobytes() if kind else raw[low:end])):
                        out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in shape.items()], list(shape))

    contexts = docs.join(want, "__key").select("__key", "text", "wants").mapInArrow(cut_out, "h long, __key long, at long, hot boolean, open boolean, context binary")
    contexts = cut(contexts, "edges")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Task:
            def __init__(self, kind: int):
                self.kind, self.family, self.rows, self.batch = kind, Family(UNITS[kind]), [], []

            def close(self) -> pa.RecordBatch:
                self.family.add(self.batch)
                unit, keys, spans = UNITS[self.kind], [], []
                for i, (key, low, anchor, open_) in enumerate(self.rows):
                    if open_ and self.family.hit[i].any():
                        for a, b in runs(self.family.hit[i][::-1]):  # starts from anchor - back on
                            keys.append(key)
                            spans.append(int(pack(np.int64(low + anchor - unit.back + a), np.int64(b - a - 1), np.int64(0), self.kind)))
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, pa.int64())], ["__key", "at"])

        tasks, last = [Task(k) for k in range(len(UNITS))], None
        for b in batches:
            for h, key, at, open_, context in zip(*(b.column(c).to_pylist() for c in ("h", "__key", "at", "open", "context"))):
                low, _, anchor, kind = unpack(at)
                # Anchors come in order of their hash, so once they change a full family can give its results.
                if h != last and len(tasks[kind].rows) >= FAMILY:
                    yield tasks[kind].close()
                    tasks[kind] = Task(kind)
                t, last = tasks[kind], h
                if len(t.batch) >= BATCH:
                    t.family.add(t.batch)
                    t.batch = []
                t.batch.append((context, anchor))
                t.rows.append((key, low, anchor, open_))
        for t in tasks:
            yield t.close()

    edge = contexts.where("NOT hot").repartition("h").sortWithinPartitions("h", "__key", "at").mapInArrow(families, "__key long, at long")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, key, at, open_, context in zip(*(b.column(c).to_pylist() for c in ("h", "__key", "at", "open", "context"))):
                low, windows, anchor, kind = unpack(at)
                values = np.frombuffer(context, np.uint64) if kind else T._TABLE[np.frombuffer(context, np.uint8)]
                start = np.arange(windows + 1)
                one, two = (Prefix(values, s)(start, start + UNITS[kind].span) for s in (0, 77))
                one = T.mix(one + np.uint64(h & (2**64 - 1)) + (anchor - start).astype(np.uint64))
                place = pack(start + low, np.zeros_like(start), np.zeros_like(start), kind)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(start), key)), pa.array(place), pa.array(np.full(len(start), open_))], ["w1", "w2", "__key", "at", "open"])

    windows = contexts.where("hot").mapInArrow(hashes, "w1 long, w2 long, __key long, at long, open boolean")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spread = windows.where("open").join(cut(twice, "hot-windows"), ["w1", "w2"], "left_semi").select("__key", "at")
    every = whole.unionByName(edge).unionByName(spread)
    return every.groupBy("__key").agg(F.collect_set("at").alias("spans"))


def covered(spans: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Which of n units windows of one kind cover, from packed runs of their starts."""
    low, windows, _, of = unpack(spans)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, low[of == kind], 1)
    np.add.at(mark, (low + windows)[of == kind] + UNITS[kind].span, -1)
    return np.cumsum(mark)[:-1] > 0


def remove(docs: DataFrame) -> DataFrame:
    """Returns docs with kept (binary: the bytes that stay), n_bytes, n_removed, n_spans and n_repeated_words; such columns are replaced.

    n_repeated_words counts the words in strings of WORDS words (runs of anything but ASCII white space) that also start
    anywhere else; it finds passages of short words, and passages under other white space, that SPAN bytes miss, and
    removes nothing. Null texts count as empty. Rows that repeat an id and text are occurrences of their own, so their
    strings repeat. Texts under SPAN bytes stay whole; very long ones are taken whole. Judged on the input throughout:
    nothing depends on the order of removal. The bytes kept may part a UTF-8 character, hence binary. An empty table
    gives an empty table.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "n_repeated_words")
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id"), F.col("text")))
    spans = find(keyed.select("__key", "text"))

    @F.arrow_udf("struct<kept:binary,n_removed:bigint,n_spans:bigint,n_repeated_words:bigint>")
    def keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, removed, parts, words = [], [], [], []
        for text, span in zip(texts, spans):
            raw = (text.as_py() or "").encode()
            at = span.values.to_numpy() if span.is_valid else np.zeros(0, np.int64)
            gone = covered(at, len(raw), 0) if len(at) else np.zeros(0, bool)
            out.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw)
            removed.append(int(gone.sum()))
            parts.append(len(runs(gone)))
            ends = [x >> 22 for x in at.tolist() if x & 3]
            words.append(int(covered(at, max(ends) + 1024 + WORDS, 1).sum()) if ends else 0)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), *(pa.array(x, pa.int64()) for x in (removed, parts, words))], ["kept", "n_removed", "n_spans", "n_repeated_words"])

    joined = keyed.join(spans, "__key", "left").withColumn("__k", keep("text", "spans"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__k.kept", size, "__k.n_removed", "__k.n_spans", "__k.n_repeated_words")


def op4_suffix_array_family(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: bytes, bytes removed, removed runs, digest of the bytes kept, repeated words. See remove()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")
