"""A Katz backoff language model of word pairs over words.

Counts are discounted by Good-Turing up to a count of CUT. A pair seen in training has its discounted share of its
first word's count; any other pair has the second word's probability times the first word's backoff weight, which
hands out exactly what the discounts saved. Words themselves are discounted alike, and what that saves is the
probability of one unknown word, so both levels sum to 1.

Texts become chunks of word ids. Words are counted in partitions by hash and numbered there by falling count, so a
short table of counts gives any number's count. Pairs go to partitions by first word (very common first words:
by both words), where one table holds the pairs' counts and where each chunk's documents have them; scores are
summed there for each document and joined by chunk. All stored arrays are byte planes under zstd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import tokens as T
from isohyet.llm.common import arrow, cut, table

CUT = 5
#: Tokens in a chunk, about.
CHUNK = 1_500_000
#: Partitions of the tables, at most; below that as many as chunks, as a power of 2.
PARTS = 1024
END = np.uint64(0xE5D0F7E47)
#: The first word of a text follows this number; a word's number as a first word is one more than its own.
BEGIN = 0


def squeeze(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 3)


def swell(b: bytes, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def batch(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], list(schema))


def ddl(schema: dict) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.binary()): "array<binary>", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {names[t]}" for n, t in schema.items())


CHUNKS = {"chunk": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.binary(), "lengths": pa.binary(), "vocabulary": pa.binary(), "counts": pa.binary(), "tokens": pa.binary()}


def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) -> chunks; vocabulary: word hashes by falling count, tokens: places in it."""
    part, n = TaskContext.get().partitionId(), 0
    ids, held, lengths, hashes, size = [], [], [], [], 0

    def close() -> pa.RecordBatch:
        flag, long, h = np.concatenate(held), np.concatenate(lengths), np.concatenate(hashes)
        words, inverse, total = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-total, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[inverse]
        trained = np.bincount(tokens[np.repeat(~flag, long)], minlength=len(order))
        return batch(CHUNKS, [((part << 32) + n, [x for y in ids for x in y], squeeze(flag.astype(np.uint8)), squeeze(long), squeeze(words[order]), squeeze(trained), squeeze(tokens.astype(np.int32)))])

    for b in batches:
        flags = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, data, offsets in T.chunks(b.column(1)):
            w = T.words(data, offsets)
            m = len(offsets) - 1
            count = np.bincount(w.doc, minlength=m)
            h = np.full(len(w.hash) + m, END)
            h[np.arange(len(w.hash)) + w.doc] = w.hash
            ids.append(b.column(0).slice(first, m).to_pylist())
            held.append(flags[first : first + m])
            lengths.append(count + 1)
            hashes.append(h)
            size += len(h)
            if size >= CHUNK:
                yield close()
                n += 1
                ids, held, lengths, hashes, size = [], [], [], [], 0
    if ids:
        yield close()


class Counts:
    """Count of a word by its number: number = place by falling count in its part * parts + part."""

    def __init__(self, parts: int, steps: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.parts = parts
        self.start = np.concatenate([(np.int64(p) << 40) + steps[p][1] for p in sorted(steps)]) if steps else np.zeros(0, np.int64)
        self.count = np.concatenate([steps[p][0] for p in sorted(steps)]) if steps else np.zeros(0, np.int64)

    def __call__(self, number: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.start, (number % self.parts << 40) + number // self.parts, "right") - 1]


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to CUT (place 0 is unused), from the numbers n[r] of events of count r; 1 where they don't exist."""
    d = np.ones(CUT + 1)
    if n[1] > 0 and n[CUT + 1] >= 0:
        common = (CUT + 1) * n[CUT + 1] / n[1]
        for r in range(1, CUT + 1):
            if n[r] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class Unigrams:
    def __init__(self, total: int, n: np.ndarray):
        self.d, self.total = discounts(n), total
        saved = float(((1 - self.d[1:]) * np.arange(1, CUT + 1) * n[1 : CUT + 1]).sum())
        self.scale, self.unknown = (1 / total, saved / total) if saved > 0 else (1 / (total + 1), 1 / (total + 1))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        p = count * self.d[np.where(count > CUT, 0, count)] * self.scale
        return np.where(count > 0, p, self.unknown)


def in_order(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns of whole numbers from 0, sorted by the first, then the next; packed into one key where they fit."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    if sum(bits) > 64:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns, bits):
        key = (key << np.uint64(b)) | c.astype(np.uint64)
    key.sort()
    out = []
    for b in bits[::-1]:
        out.append((key & np.uint64((1 << b) - 1)).astype(np.int64))
        key = key >> np.uint64(b)
    return out[::-1]


def spread(x: np.ndarray, parts: int) -> np.ndarray:
    return (T.mix(x.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Learns from the rows where held is false. A null or empty text is one end token. Rows that repeat are rows of
    their own. If nothing is held for training, train_tokens is 0, every token is unknown with probability 1 and scores
    0. An empty table gives an empty table; columns besides doc_id, text and held are ignored.
    """
    spark = docs.sparkSession
    arrow(spark)
    chunks = cut(docs.select("doc_id", "text", "held").mapInArrow(to_chunks, ddl(CHUNKS)), "chunks")
    n_chunks = chunks.count()
    parts = min(PARTS, 1 << max(2, (n_chunks - 1).bit_length() if n_chunks else 0))

    # Words: counts by part, and each chunk's words' numbers.
    piece = {"part": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "counts": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                words, counts = swell(words, np.uint64), swell(counts)
                to = (words >> np.uint64(20)) % np.uint64(parts)
                yield batch(piece, [(p, chunk, squeeze(words[to == p]), squeeze(counts[to == p])) for p in range(parts)])

    numbers = {"part": pa.int32(), "chunk": pa.int64(), "a": pa.binary(), "b": pa.binary()}

    def number(t: pa.Table) -> pa.Table:
        words = [swell(x, np.uint64) for x in t["words"].to_pylist()]
        kinds, inverse = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([swell(x) for x in t["counts"].to_pylist()]), len(kinds)).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = np.cumsum([0, *map(len, words)])
        part = t["part"][0].as_py()
        rows = [(part, c, squeeze(place[inverse[i:j]] * parts + part), None) for c, i, j in zip(t["chunk"].to_pylist(), ends, ends[1:])]
        falling = count[order]
        first = np.flatnonzero(np.r_[True, falling[1:] != falling[:-1]]) if len(falling) else np.zeros(0, np.int64)
        rows.append((part, -1, squeeze(falling[first]), squeeze(np.r_[first, len(falling)])))
        return pa.Table.from_batches([batch(numbers, rows)])

    words = chunks.select("chunk", "vocabulary", "counts").mapInArrow(deal, ddl(piece)).groupBy("part").applyInArrow(number, ddl(numbers))
    words = cut(words, "words")
    steps, total, kinds, n1 = {}, 0, 0, np.zeros(CUT + 2)
    for r in words.where("chunk = -1").collect():
        count, first = swell(bytes(r.a)), swell(bytes(r.b))
        steps[r.part] = count, first[:-1]
        size = np.diff(first)
        total, kinds = total + int((count * size).sum()), kinds + int(size[count > 0].sum())
        for k in range(1, CUT + 2):
            n1[k] += size[count == k].sum()
    counts, unigrams = Counts(parts, steps), Unigrams(max(total, 1), n1) if total else Unigrams(0.5, np.r_[0, 0.5, np.zeros(CUT)])
    if not total:
        unigrams.unknown = 1.0
    common = max(1000, total // (4 * parts))  # first words above that go to partitions by both words
    begun = chunks.select("held").mapInArrow(_begun, "n long").agg(F.sum("n")).first()[0] or 0

    def times(h: np.ndarray) -> np.ndarray:
        """Training count of a first word."""
        return np.where(h == BEGIN, begun, counts(np.maximum(h - 1, 0)) if len(counts.count) else 0)

    own = words.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "a")).alias("numbers"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [squeeze(((swell(x, np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int16)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to, pa.binary())], ["chunk", "places"])

    # Only the part of each word goes along to where the numbers meet the tokens, an eighth of its hash.
    places = chunks.select("chunk", "vocabulary").mapInArrow(place, "chunk long, places binary")
    joined = chunks.select("chunk", "held", "lengths", "tokens", "ids").join(own, "chunk").join(places, "chunk")
    packs = {"part": pa.int32(), "chunk": pa.int64(), "data": pa.list_(pa.binary()), "ids": pa.list_(pa.int64())}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, held, lengths, to, tokens, ids = (b.column(c)[i].as_py() for c in ("chunk", "held", "lengths", "places", "tokens", "ids"))
                held, lengths, to, tokens = swell(held, np.uint8).astype(bool), swell(lengths), swell(to, np.int16), swell(tokens, np.int32).astype(np.int64)
                number = np.empty(len(to), np.int64)
                for x in b.column("numbers")[i].as_py():
                    number[to == x["part"]] = swell(x["a"])
                count = counts(number)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                known, base = count > 0, np.log10((count + 1) / (total + kinds + 1))
                yield batch(packs, [(-1, chunk, [squeeze(held.astype(np.uint8)), squeeze(lengths), squeeze(np.bincount(doc, known[tokens]).astype(np.int64)), squeeze(np.bincount(doc, base[tokens]))], ids)])
                first = np.r_[0, tokens[:-1] + 1]
                first[np.r_[0, np.cumsum(lengths)[:-1]]] = 0
                first, tokens, doc = in_order(first, tokens, doc)
                new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])])
                n, first, tokens, doc = np.diff(np.r_[new, len(doc)]), first[new], tokens[new], doc[new]
                kind = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (tokens[1:] != tokens[:-1])])
                size = np.diff(np.r_[kind, len(doc)])
                trained = np.add.reduceat(n * ~held[doc], kind)
                h, w = np.r_[BEGIN, number + 1][first[kind]], number[tokens[kind]]
                part = np.where(times(h) > common, spread(h * 1_000_003 + w, parts), spread(h, parts))
                order = np.argsort(part.astype(np.uint16), kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                where = np.repeat(part, size)
                inner = np.argsort(where.astype(np.uint16), kind="stable")
                inner_ends = np.searchsorted(where[inner], np.arange(parts + 1))
                for p in range(parts):
                    k, o = order[ends[p] : ends[p + 1]], inner[inner_ends[p] : inner_ends[p + 1]]
                    if len(k):
                        yield batch(packs, [(p, chunk, [squeeze(h[k]), squeeze(w[k]), squeeze(size[k].astype(np.int32)), squeeze(trained[k].astype(np.int32)), squeeze(doc[o].astype(np.int32)), squeeze(n[o].astype(np.int32))], None)])

    tables = {"part": pa.int32(), "seen": pa.list_(pa.int64()), "pairs": pa.list_(pa.binary()), "common": pa.list_(pa.binary()), "chunks": pa.list_(pa.int64()), "uses": pa.list_(pa.binary()), "ids": pa.list_(pa.int64())}

    def merge(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        if part < 0:
            return pa.Table.from_batches([batch(tables, [(part, None, r, None, [c], None, i) for c, r, i in zip(t["chunk"].to_pylist(), t["data"].to_pylist(), t["ids"].to_pylist())])])
        data = t["data"].to_pylist()
        h, w = (np.concatenate([swell(r[k]) for r in data]) for k in (0, 1))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        h, w = h[new], w[new]
        c = np.bincount(inverse, np.concatenate([swell(r[3], np.int32) for r in data]), len(h)).astype(np.int64)
        seen = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[: CUT + 2]
        hot = np.flatnonzero((times(h) > common) & (c > 0))
        u, k = np.unique(h[hot], return_inverse=True)
        small = [np.bincount(k, c[hot] == r, len(u)) for r in range(1, CUT + 1)]
        sums = [*small, np.bincount(k, np.where(c[hot] > CUT, c[hot], 0), len(u)), np.bincount(k, unigrams(counts(w[hot])), len(u))]
        ends = np.cumsum([0, *(len(swell(r[2], np.int32)) for r in data)])
        uses = [x for r, i, j in zip(data, ends, ends[1:]) for x in (squeeze(inverse[i:j].astype(np.int32)), r[2], r[4], r[5])]
        return pa.Table.from_batches([batch(tables, [(part, seen.tolist(), [squeeze(h), squeeze(w), squeeze(c)], [squeeze(u), *map(squeeze, np.array(sums, float).reshape(CUT + 2, -1))], t["chunk"].to_pylist(), uses, None)])])

    # Rows of chunks' own figures (part -1) are dealt by chunk, so they don't meet in one task.
    packed = joined.mapInArrow(pair, ddl(packs)).withColumn("of", F.when(F.col("part") < 0, F.col("chunk")).otherwise(-1))
    merged = cut(packed.groupBy("part", "of").applyInArrow(merge, ddl(tables)), "pairs")
    n2 = np.zeros(CUT + 2)
    for i, r in enumerate(merged.where("part >= 0").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).sort("pos").collect()):
        n2[i] = r.n
    d2 = discounts(n2)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                u, sums = swell(x[0]), np.array([swell(y, np.float64) for y in x[1:]])
                yield pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, sums)], ["h", *(f"s{i}" for i in range(CUT + 2))])

    hot = merged.where("part >= 0").select("common").mapInArrow(unpack, "h long, " + ", ".join(f"s{i} double" for i in range(CUT + 2)))
    rows = hot.groupBy("h").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(CUT + 2)]).sort("h").collect()  # at most 4 * parts
    hot_h, hot_s = np.array([r.h for r in rows], np.int64), np.array([tuple(r)[1:] for r in rows], float).reshape(len(rows), CUT + 2).T

    def weights(h: np.ndarray, small: np.ndarray, large: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scale of seen pairs, backoff weight) of first words, from their seen pairs: numbers by count, rest of the count, sum of the second words' probabilities."""
        c = np.maximum(times(h), 1)
        used = (small * (d2[1:] * np.arange(1, CUT + 1))[:, None]).sum(0) + large
        saved = 1 - used / c
        none = saved <= 1e-12
        scale = np.where(none, 1 / (used + 1), 1 / c)
        return scale, np.where(times(h) > 0, np.where(none, 1 / (used + 1), saved) / np.maximum(1 - p, 1e-300), 1.0)

    scored = {"chunk": pa.int64(), "docs": pa.binary(), "sums": pa.binary()}

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, w, c = map(swell, b.column("pairs")[i].as_py())
                cw = counts(w)
                p, seen = unigrams(cw), c > 0
                u, k = np.unique(h, return_inverse=True)
                small = np.array([np.bincount(k, c == r, len(u)) for r in range(1, CUT + 1)])
                large, mass = np.bincount(k, np.where(c > CUT, c, 0), len(u)), np.bincount(k, np.where(seen, p, 0), len(u))
                if len(hot_h):
                    at = np.minimum(np.searchsorted(hot_h, u), len(hot_h) - 1)
                    is_hot = hot_h[at] == u
                    small[:, is_hot], large[is_hot], mass[is_hot] = hot_s[:CUT, at[is_hot]], hot_s[CUT, at[is_hot]], hot_s[CUT + 1, at[is_hot]]
                scale, back = weights(u, small, large, mass)
                logp = np.log10(np.where(seen, c * np.where(c > CUT, 1.0, d2[np.minimum(c, CUT)]) * scale[k], back[k] * p))
                uses = b.column("uses")[i].as_py()
                for j, chunk in enumerate(b.column("chunks")[i].as_py()):
                    inverse, size, doc, n = (swell(x, np.int32) for x in uses[4 * j : 4 * j + 4])
                    sums = np.bincount(doc, np.repeat(logp[inverse], size) * n)
                    at = np.flatnonzero(sums)
                    yield batch(scored, [(chunk, squeeze(at.astype(np.int32)), squeeze(sums[at]))])

    sums = merged.where("part >= 0").select("pairs", "chunks", "uses").mapInArrow(evaluate, ddl(scored))
    sums = sums.groupBy("chunk").agg(F.collect_list(F.struct("docs", "sums")).alias("parts"))
    figures = merged.where("part < 0").select(F.col("chunks")[0].alias("chunk"), F.col("pairs").alias("figures"), "ids")
    out = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held, lengths, known, base = b.column("figures")[i].as_py()
                held = swell(held, np.uint8).astype(bool)
                s = np.zeros(len(held))
                for x in sorted(b.column("parts")[i].as_py(), key=lambda x: x["docs"]):
                    s[swell(x["docs"], np.int32)] += swell(x["sums"], np.float64)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(held), pa.array(swell(lengths)), pa.array(swell(known)), pa.array(np.full(len(s), total)), pa.array(swell(base, np.float64)), pa.array(s)], list(out))

    return figures.join(sums, "chunk").mapInArrow(finish, ddl(out))


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int((swell(x, np.uint8) == 0).sum()) for x in b.column(0).to_pylist()], pa.int64())], ["n"])


def op6_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: token counts, base score and the model's score. See score()."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held")))
