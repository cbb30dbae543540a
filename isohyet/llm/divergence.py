"""How far the sources of a language are from each other, and which terms make a source stand out.

Terms are found on UTF-8 bytes: a lookup table over the joined texts of a chunk gives their boundaries, XXH64 groups
equal slices, and each slice is compared with its group's first one, so equal hashes alone never join terms. Counts
become compressed rows (source x term) of one block of terms; the divergences are sums over these rows by reduceat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm.common import arrow, cut, table
from isohyet.llm.tokens import CHUNK, LOWER, chunks, xxh64

#: Bytes of terms: letters of ASCII and all beyond ASCII.
TERM = np.array([x >= 128 or chr(x).isalpha() for x in range(256)])
#: Counts of (group, term) that a task holds before it gives them away, and those of a block of terms.
HELD, BLOCK = 1 << 20, 200_000
SCALE = 1_000_000_000


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end between terms; a longer term stays whole."""
    a = 0
    while a < len(data):
        b = a + CHUNK
        if b < len(data):
            ends = np.flatnonzero(~TERM[data[b : b + CHUNK]])
            while not len(ends) and b < len(data):
                b += CHUNK
                ends = np.flatnonzero(~TERM[data[b : b + CHUNK]])
            b = b + int(ends[0]) if len(ends) else len(data)
        yield data[a:b]
        a = b


def same_bytes(data: np.ndarray, a: np.ndarray, size: np.ndarray, other: np.ndarray, b: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether slices of data are byte for byte those of other; both have 8 spare bytes."""
    same = size == other_size
    x, y = (np.ndarray(len(d) - 7, "<u8", d, strides=(1,)) for d in (data, other))
    left = np.flatnonzero(same)
    k = 0
    while len(left := left[size[left] > k]):
        n = np.minimum(size[left] - k, 8).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n * np.uint64(8))
        same[left] = ((x[a[left] + k] ^ y[b[left] + k]) & keep) == 0
        left, k = left[same[left]], k + 8
    return same


class Terms:
    """Numbers of terms: found by hash, compared byte for byte, one after another in one array of bytes."""

    def __init__(self) -> None:
        self.hash, self.id = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.ends, self.count = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), 0
        self.odd: dict[bytes, int] = {}

    def bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.where(k > 0, self.ends[k - 1], 0)
        return start, self.ends[k] - start

    def append(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        used, n = int(self.ends[self.count - 1]) if self.count else 0, len(start)
        ends = used + np.cumsum(size)
        stop = int(ends[-1]) if n else used
        if stop + 8 > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(stop + 8 - len(self.data), len(self.data)), np.uint8)])
        if self.count + n > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(n, len(self.ends)), np.int64)])
        self.data[used:stop] = data[np.arange(stop - used) + np.repeat(start - (ends - size - used), size)]
        self.ends[self.count : self.count + n] = ends
        self.count += n
        return np.arange(self.count - n, self.count)

    def numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each slice; h are their hashes."""
        kinds, first, group = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, kinds)
        old = self.hash[np.minimum(at, len(self.hash) - 1)] == kinds if len(self.hash) else np.zeros(len(kinds), bool)
        ids = np.empty(len(kinds), np.int64)
        ids[old] = self.id[at[old]]
        fresh = first[~old]
        ids[~old] = self.append(data, start[fresh], size[fresh])
        self.hash, self.id = np.insert(self.hash, at[~old], kinds[~old]), np.insert(self.id, at[~old], ids[~old])
        out = ids[group]
        for i in np.flatnonzero(~same_bytes(data, start, size, self.data, *self.bounds(out))).tolist():  # other terms of the same hash
            term = data[start[i] : start[i] + size[i]].tobytes()
            if term not in self.odd:
                self.odd[term] = int(self.append(data, start[i : i + 1], size[i : i + 1])[0])
            out[i] = self.odd[term]
        return out

    def array(self) -> pa.Array:
        offsets = np.r_[0, self.ends[: self.count]]
        return pa.Array.from_buffers(pa.large_string(), self.count, [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])


def slices(data: np.ndarray, offsets: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of every term of a chunk."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = LOWER[data]
    part = np.ones(len(data) + 2, bool)
    part[1:-1] = ~TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~part[1:-1] & (part[:-2] | edge[:-1]))
    end = np.flatnonzero(~part[1:-1] & (part[2:] | edge[1:])) + 1
    return np.searchsorted(offsets, start, "right") - 1, terms.numbers(low, start, end - start, xxh64(low, start, end, 0))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


class Counts:
    """Occurrences and documents of the terms of each group of documents that a task has seen."""

    SPAN = 1 << 40

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms = Terms()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, texts: pa.Array, group: np.ndarray) -> None:
        for i, data, offsets in chunks(texts, CHUNK):
            if len(offsets) == 2 and len(data) > 2 * CHUNK:  # one long text
                got = [slices(p, np.array([0, len(p)]), self.terms)[1] for p in pieces(data)]
                term, n = np.unique(np.concatenate(got), return_counts=True)
                keys = group[i] * self.SPAN + term
            else:
                doc, term = slices(data, offsets, self.terms)
                keys, n = np.unique(doc * self.SPAN + term, return_counts=True)
                keys = group[i + keys // self.SPAN] * self.SPAN + keys % self.SPAN
            self.parts.append(summed(keys, n, np.ones(len(n), np.int64)))
            self.size += len(self.parts[-1][0])
            if self.size > 2 * HELD:
                self.pack()

    def pack(self) -> None:
        if self.parts:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def given(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """All counts so far, and a row without term for each group; forgets the terms."""
        self.pack()
        names = list(self.groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), *[pa.array(np.zeros(len(names), np.int64))] * 2], schema=schema)
        if self.parts:
            keys, n, docs = self.parts[0]
            terms = self.terms.array()
            for a in range(0, len(keys), 65536):
                k = keys[a : a + 65536]
                g = pa.array(k // self.SPAN)
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), terms.take(pa.array(k % self.SPAN)).cast(pa.string()), pa.array(n[a : a + 65536]), pa.array(docs[a : a + 65536])], schema=schema)
        self.clear()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it. A row without term tells of each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for p in parts:
            pairs = zip(p.column("lang").to_pylist(), p.column("source").to_pylist())
            group = np.array([held.groups.setdefault(g, len(held.groups)) for g in pairs], np.int64)
            held.add(p.column("text"), group)
            if held.size > HELD:
                held.pack()
                if held.size > HELD:
                    yield from held.given(schema)
        yield from held.given(schema)

    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return each.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact while total is below 4 * 10^15: a long division by three digits at a time."""
    by = np.broadcast_to(total + 2 * terms, np.shape(count)).astype(np.int64)
    rest, out = count.astype(np.int64) + 2, np.zeros(np.shape(count), np.int64)
    out, rest = rest // by, rest % by
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // by, rest % by
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block(t: pa.Table, top: int, schema: pa.Schema) -> pa.Table:
    """The part of one lang's divergences that a block of terms makes: sums of pairs once each, and each source's first terms."""
    lang = t.column("lang")[0].as_py()
    groups = t.filter(pa.compute.is_null(t.column("term"))).sort_by("source")
    cells = t.filter(pa.compute.is_valid(t.column("term")))
    sources = groups.column("source").to_pylist()
    total, kinds, all_ = (groups.column(c).to_numpy() for c in ("total", "kinds", "lang_total"))
    place = {s: i for i, s in enumerate(sources)}
    row = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
    words = cells.column("term").combine_chunks().dictionary_encode() if cells.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = [w.encode() for w in words.dictionary.to_pylist()]
    byte_rank = np.empty(len(names), np.int64)
    byte_rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    column = byte_rank[words.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    n, lang_n = (cells.column(c).to_numpy()[order] for c in ("n", "lang_n"))
    size = len(sources)
    start = np.searchsorted(row, np.arange(size + 1))
    full = np.flatnonzero(np.diff(start))
    sums = np.zeros((size, size), np.int64)
    out: list[tuple] = []
    if len(names):
        p, none = share(n, total[row], kinds[row]), share(np.zeros(size), total, kinds)
        for g in range(size):
            mine = slice(start[g], start[g + 1])
            dense = np.full(len(names), none[g])
            dense[column[mine]] = p[mine]
            # Against a source without any of the terms; then what changes where it has them.
            values, times = np.unique(p[mine], return_counts=True)
            for a in range(0, len(values), 4096):
                sums[g] += (gap(values[a : a + 4096, None], none[None]) * times[a : a + 4096, None]).sum(0)
            sums[g] += (len(names) - (start[g + 1] - start[g])) * gap(none[g], none)
            change = gap(p, dense[column]) - gap(none[row], dense[column])
            sums[g, full] += np.add.reduceat(change, start[full])
        q = share(lang_n, all_[row], kinds[row])
        above = np.flatnonzero(p > q)
        f = gap(p[above], q[above])
        best = np.lexsort((column[above], -f, row[above]))
        r = row[above][best]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        spelt = sorted(names)
        out = [(sources[row[i]], "term", spelt[column[i]].decode(), int(v)) for i, v, k in zip(above[best], f[best], nth) if k < top]
    out += [(sources[a], "pair", sources[b], int(sums[a, b])) for a in range(size) for b in range(a + 1, size)]
    columns = [list(c) for c in zip(*out)] or [[], [], [], []]
    return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))]], schema=schema)


def audit(docs: DataFrame, least: int = 10, top: int = 10, cells: int = BLOCK) -> DataFrame:
    """(lang, source, text) -> (lang, source, part, item, value, rank): see the module.

    Nulls are empty text, lang or source. A lang keeps the terms that occur in `least` of its rows; each row is a document
    of its own, repeated or not. Part pair has, for each source, every other source of its lang and the divergence
    between them; part term the `top` terms that the source has oftener than its lang, by divergence. Equal values go by
    item in bytes. Long texts are cut between terms and counted whole. A source without kept terms has its pairs. An
    empty table gives an empty table; further columns are ignored. Blocks of about `cells` counts share the work; `cells`
    decides no value.
    """
    spark = docs.sparkSession
    arrow(spark)
    counts = cut(term_counts(docs), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
    have = cut(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "divergence-kept")
    blocks = max(1, -(-have.count() // cells))
    langs = have.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    totals = have.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kinds", "lang_total"])
    none = F.lit(None)
    rows = have.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "source", "term", "n", "lang_n", *[none.cast("long").alias(c) for c in ("total", "kinds", "lang_total")])
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "source", none.cast("string").alias("term"), none.cast("long").alias("n"), none.cast("long").alias("lang_n"), "total", "kinds", "lang_total")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    parts = cut(rows.unionByName(heads).groupBy("lang", "block").applyInArrow(lambda t: block(t, top, schema), "lang string, source string, part string, item string, value long"), "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = pairs.select("lang", "part", "value", ways.alias("w")).select("lang", "w.source", "part", "w.item", "value")
    every = both.unionByName(parts.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each lang of all documents. See audit()."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0)::HUGEINT + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total::HUGEINT + 2 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
