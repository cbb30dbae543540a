"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by a key made of a hash of their text and a hash of their id, so equal texts stand
together. A size-weighted sample of the keys gives quantile boundaries; the exact weight of each range is then
counted, overfull ranges are sampled again and subdivided, and runs of ranges of equal weight become shards; the ranges
of one heavy text go to a shard together.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm.common import cut, table

#: Ranges for each shard; a shard's weight is off by about one range.
RANGES = 64
#: Keys drawn in a round, at most about this many: what the driver gathers.
SAMPLE = 16_000
#: A range above so many times the mean range is subdivided.
OVERFULL = 1.5
ROUNDS = 5
#: Low bits of the key, from the id; they cut a text that alone fills a range.
LOW = 24
TOP = (1 << 63) - 1


def sort_key(doc_id: Column, text: Column) -> Column:
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(-(1 << LOW)))
    return high.bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << LOW) - 1)))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by a search of two levels over constant arrays."""
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    flat = bounds + [TOP] * (-len(bounds) % k)
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    heads = flat[::k]
    block = F.greatest(F.size(F.filter(array(heads), lambda b: b <= key)) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(array(flat), block * k + 1, F.lit(k)), lambda b: b <= key))
    return F.least(block * k + inside, F.lit(len(bounds))).cast("int")


def draw(keys: DataFrame, weight: float, n: int, seed: int) -> list[int]:
    """A sample in which a record of size s stands about s * n / weight times; the same one in each run."""
    share = F.col("size") * F.lit(n / max(weight, 1.0))
    unit = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) / F.lit(float(1 << 53))
    times = F.floor(share + unit)
    return [r.key for r in keys.select("key", times.alias("times")).where("times > 0").select(F.explode(F.array_repeat("key", F.col("times").cast("int"))).alias("key")).sort("key").collect()]


def quantiles(sample: list[int], parts: int) -> list[int]:
    """Boundaries between parts. A boundary goes back to where its text begins, unless that text alone spans parts."""
    at = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    high = [x >> LOW for x in at]
    alone = {h for h, n in zip(high, high[1:]) if h == n}
    ends = {e << LOW for h in alone for e in (h, h + 1) if e << LOW <= TOP}
    return sorted({x if h in alone else h << LOW for x, h in zip(at, high)} | ends)


def deal(bounds: list[int], totals: dict[int, tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """(shard, slots before it) of each range from its (weight, rows).

    Ranges that one text fills stay together if they are no more than a shard: such texts come first, the heaviest to
    the emptiest shard. All other ranges then fill the shards in order of their keys.
    """
    weight = sum(size for size, _ in totals.values())
    room, n = weight / shards, len(bounds) + 1
    texts: dict[int, list[int]] = {}
    for k in range(1, n - 1):
        low, high = bounds[k - 1] >> LOW, (bounds[k] - 1) >> LOW
        if low == high:
            texts.setdefault(low, []).append(k)
    size_of_text = {h: sum(totals.get(k, (0, 0))[0] for k in ks) for h, ks in texts.items()}
    shard, load, placed = [0] * n, [0.0] * shards, set()
    for h in sorted(texts, key=lambda h: (-size_of_text[h], h)):
        if size_of_text[h] <= room:
            s = min(range(shards), key=lambda s: (load[s], s))
            load[s] += size_of_text[h]
            for k in texts[h]:
                shard[k] = s
            placed.update(texts[h])
    left = [max(0.0, room - x) for x in load]
    rest = sorted(set(totals) - placed)
    scale = sum(totals[k][0] for k in rest) / (sum(left) or 1)
    ends = list(accumulate(x * scale for x in left))
    done, last = 0, max((s for s in range(shards) if left[s] > 0), default=shards - 1)
    for k in rest:
        shard[k] = min(bisect_right(ends, done + totals[k][0] / 2), last)
        done += totals[k][0]
    first, filled = [0] * n, [0] * shards
    for k in range(n):
        first[k] = filled[shard[k]]
        filled[shard[k]] += totals.get(k, (0, 0))[1]
    return shard, first


def split(docs: DataFrame, shards: int = 24, ranges: int = RANGES, seed: int = 7, key: Column | None = None, size: Column | None = None) -> DataFrame:
    """Returns docs with shard (0 to shards - 1) and slot (gapless from 0 in its shard), near equal in bytes.

    A record weighs its text's UTF-8 bytes plus 8 (null text: 8; a null and an empty text are equal). Equal texts share a
    shard unless they outgrow one; then they fill whole ranges of several. Rows that agree in id and text are kept apart
    as rows, with a slot each, but share a key and thus a shard. Very long texts are no special case: only sizes and
    digests are moved. An empty table gives an empty table; columns of docs named shard or slot are replaced. key and size are sort_key() and size_of()
    of the text, unless docs has them already and no longer its text.
    """
    docs = docs.drop("shard", "slot")
    with_key = docs.withColumns({"__key": sort_key(F.col("doc_id"), F.col("text")) if key is None else key, "__size": size_of("text") if size is None else size})
    keys = cut(with_key.select(F.col("__key").alias("key"), F.col("__size").alias("size")), "shard-keys")
    weight = keys.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges
    mean = weight / parts
    bounds = quantiles(draw(keys, weight, SAMPLE, seed), parts)
    for i in range(ROUNDS):
        sizes = {r.range: r.size for r in keys.groupBy(range_of(F.col("key"), bounds).alias("range")).agg(F.sum("size").alias("size")).collect()}
        over = {k: n for k, n in sizes.items() if n > OVERFULL * mean}
        inside = keys.withColumn("range", range_of(F.col("key"), bounds)).where(F.col("range").isin([*over]))
        more: set[int] = set()
        if over:
            edges = [-TOP - 1, *bounds]
            found: dict[int, list[int]] = {}
            for x in draw(inside, sum(over.values()), min(SAMPLE, 64 * len(over) + 256), seed + i + 1):
                found.setdefault(bisect_right(bounds, x), []).append(x)
            for k, xs in found.items():
                more |= {x for x in quantiles(xs, max(2, round(2 * over.get(k, 0) / max(mean, 1)))) if x > edges[k]}
        if not more - set(bounds):
            break
        bounds = sorted(more | set(bounds))
    totals = {r.range: (r.size, r.n) for r in keys.groupBy(range_of(F.col("key"), bounds).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    shard, first = deal(bounds, totals, shards)
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__key", "doc_id"))
    placed = with_key.withColumn("__range", range_of(F.col("__key"), bounds)).withColumn("__rank", rank)
    at = F.col("__range") + 1
    return placed.withColumns({"shard": F.element_at(constant(shard), at).cast("int"), "slot": F.element_at(constant(first), at) + F.col("__rank") - 1}).drop("__key", "__size", "__range", "__rank")


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def op10_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: size, digest, shard and slot under the law of near equal bytes. See split()."""
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = docs.select("doc_id", size_of("text").alias("size"), crc.alias("text_crc32"), sort_key(F.col("doc_id"), F.col("text")).alias("key"))
    out = split(docs, 24, key=F.col("key"), size=F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
