"""Exact deduplication by Grace hashing.

Every task first combines the equal texts that it reads. What is left is dealt by hash to the files of a shuffle, and
each of these buckets is read into an open-addressing table of bounded size that compares whole texts. What a table has
no room for is spilled to a written table and dealt anew by another hash, until nothing is left. A text is in the table
from its first row on or never, so a text that is taken up is settled in that round with all its copies.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import arrow, cut, table

#: Bytes of distinct text that a table holds.
ROOM = 64 << 20
#: Rows of a batch that a task returns.
BATCH = 4096


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Table:
    """An open-addressing hash table of texts, with linear probing and comparison of whole contents."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.slots, self.hashes, self.texts, self.size = array("q", [-1]) * 1024, [], [], 0

    def find(self, h: int, text: bytes) -> int:
        """Number of the text's entry, or -1 and a fresh place at self.place."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return k
            at = (at + 1) & mask
        self.place = at
        return -1

    def fits(self, text: bytes) -> bool:
        return not self.texts or self.size + len(text) <= self.room

    def add(self, h: int, text: bytes) -> int:
        """Puts a text at self.place."""
        k = len(self.texts)
        self.slots[self.place] = k
        self.hashes.append(h)
        self.texts.append(text)
        self.size += len(text)
        if 2 * len(self.texts) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for j, x in enumerate(self.hashes):
                at = (x ^ (x >> 29)) & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = j
        return k


def rank(key, row: int) -> tuple:
    """Smallest ids first, null last, rows of one id by their number."""
    return (True, 0, row) if key is None else (False, key, row)


def batches(columns: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for a in range(0, size, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][a : a + BATCH], f.type) if f.name in columns else pa.nulls(min(BATCH, size - a), f.type) for f in schema], schema=schema)


def combined(docs: DataFrame, room: int) -> DataFrame:
    """(id, sha, h, text, carry) -> the rows without text, numbered and with the entry that has their text (rep), and these entries.

    A task that runs out of room gives its entries away and begins anew, so a text that many rows share goes on once
    for each `room` bytes of distinct text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen, schema = TaskContext.get().partitionId() << 36, Table(room), None
        first, n, best = [], [], []

        def given() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(first), 256):
                b = slice(a, a + 256)
                yield from batches({"rep": first[b], "h": seen.hashes[b], "n": n[b], "id": [x[0] for x in best[b]], "best_row": [x[1] for x in best[b]], "text": seen.texts[b]}, schema)

        for p in parts:
            schema = schema or pa.schema([("row", pa.int64()), p.schema.field("id"), p.schema.field("sha"), p.schema.field("carry"), *[(c, pa.int64()) for c in ("rep", "h", "n", "best_row")], ("text", pa.binary())])
            rows, reps = range(row, row + p.num_rows), []
            for key, h, text in zip(p.column("id").to_pylist(), p.column("h").to_pylist(), p.column("text").cast(pa.binary()).to_pylist()):
                k = seen.find(h, text)
                if k < 0:
                    if not seen.fits(text):
                        yield from given()
                        seen.clear()
                        first, n, best = [], [], []
                        seen.find(h, text)
                    k = seen.add(h, text)
                    first.append(row)
                    n.append(0)
                    best.append((key, row))
                n[k] += 1
                if rank(key, row) < rank(*best[k]):
                    best[k] = (key, row)
                reps.append(first[k])
                row += 1
            have = {"row": pa.array(rows, pa.int64()), "id": p.column("id"), "sha": p.column("sha"), "carry": p.column("carry"), "rep": pa.array(reps, pa.int64())}
            yield pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(p.num_rows, f.type) for f in schema], schema=schema)
        yield from given()

    simple = lambda c: docs.schema[c].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {simple('id')}, sha string, carry {simple('carry')}, rep long, h long, n long, best_row long, text binary")


def settled(entries: DataFrame, room: int) -> DataFrame:
    """(rep, h, n, id, best_row, text), dealt by hash -> (rep, id, best_row, n) of the whole group, or the row as it was where the table had no room."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, schema = Table(room), None
        n, best, reps = [], [], []
        for p in parts:
            schema = p.schema
            left = []
            columns = [p.column(c).to_pylist() for c in ("rep", "h", "n", "id", "best_row", "text")]
            for i, (rep, h, m, key, row, text) in enumerate(zip(*columns)):
                k = seen.find(h, text)
                if k < 0:
                    if not seen.fits(text):
                        left.append(i)
                        continue
                    k = seen.add(h, text)
                    n.append(0)
                    best.append((key, row))
                    reps.append(array("q"))
                n[k] += m
                reps[k].append(rep)
                if rank(key, row) < rank(*best[k]):
                    best[k] = (key, row)
            if left:
                yield p.take(pa.array(left))
        owner = [k for k, r in enumerate(reps) for _ in r]
        flat = [rep for r in reps for rep in r]
        for a in range(0, len(flat), BATCH):
            own = owner[a : a + BATCH]
            yield from batches({"rep": flat[a : a + BATCH], "n": [n[k] for k in own], "id": [best[k][0] for k in own], "best_row": [best[k][1] for k in own]}, schema)

    return entries.mapInArrow(run, f"rep long, h long, n long, id {entries.schema["id"].dataType.simpleString()}, best_row long, text binary")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, room: int = ROOM, buckets: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; carry adds a struct of further columns, named carry.

    Texts are equal when they are the same after each run of ASCII white space became one space; null counts as empty. Of
    equal texts the row with the smallest id stays. Null ids come last; among rows of one id and text one stays. Equal
    hashes alone never make texts equal. A text larger than `room` has a table for itself while it is read. An empty
    table gives an empty table; columns not asked for are ignored, whatever their names. `room` bounds the bytes of
    text in a task's memory, `buckets` is the number of a level's buckets (by default enough for half of `room` each);
    neither decides a result.
    """
    spark = docs.sparkSession
    arrow(spark)
    at = lambda c: F.col(f"`{c}`")
    more = F.struct(*[at(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(at(id).alias("id"), normalised(at(text)).alias("text"), more.alias("carry"))
    rows = rows.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("h"), "text", "carry")
    read = cut(combined(rows, room), "grace-read")
    left = read.where("text IS NOT NULL").select("rep", "h", "n", "id", "best_row", "text")
    done, level = [], 0
    while True:
        size = left.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        if not size[0] and done:
            break
        many = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * int(size[1] or 0) // room))
        # Each level deals by a hash of its own, or what went to one bucket would stay together.
        dealt = left.withColumn("spill", F.xxhash64("h", F.lit(level))).repartition(many, "spill").drop("spill")
        out = cut(settled(dealt, room), f"grace-level{level}")
        done.append(out.where("text IS NULL").select(F.col("rep").alias("__rep"), F.col("id").alias("keep_id"), F.col("best_row").alias("__best"), F.col("n").alias("group_size")))
        left, level = out.where("text IS NOT NULL"), level + 1
    groups = done[0]
    for d in done[1:]:
        groups = groups.unionByName(d)
    got = read.where("row IS NOT NULL").join(groups, F.col("rep") == F.col("__rep"))
    own = [F.col("carry")] if carry else []
    return got.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("row") == F.col("__best")).alias("kept"), F.col("sha").alias("text_sha256"), *own)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", room: int = ROOM) -> DataFrame:
    """The rows of docs that stay, with all their columns. See classes()."""
    return classes(docs, id, text, docs.columns, room).where("kept").select("carry.*")


def op12_grace_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for its text. See classes()."""
    return classes(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
