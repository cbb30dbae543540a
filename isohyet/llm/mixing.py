"""Mixing sources to target weights by systematic sampling.

All documents of a source have the same expected number of copies, target / size of the source. Along an order
within the source (by size class, then by a hash of the id) these expectations are prefix-summed from one random
offset, and a document is emitted once for each integer that the sum crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm.common import cut, n_words, table

#: No source's target, and no document, exceeds so many times its size.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Buckets by hash in each size class, as hex digits: they bound the rows that one task orders.
HEX = 2


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with weight and target (double).

    Sources come by code point, null last; weights repeat. The targets sum to the sum of the sizes; none is above
    most times its source's size, and what is cut off goes to the others by weight. The table has one row for each
    source, so ordering it in one task is cheap.
    """
    one = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("cap").cast("double")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    order = one.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    total, cut_off = F.sum("source_size").over(one), F.coalesce(F.sum("cap").over(below), F.lit(0))
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    level = ranked.withColumn("level", (total - cut_off).cast("double") / rest.cast("double"))
    # The level that holds is the first that its own source's cap does not stop, which is also the largest such;
    # sources before it stay at their caps.
    held = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(one)
    first = F.min(F.when(F.col("level") * F.col("weight") <= cap, cap / F.col("weight"))).over(one)
    return level.withColumn("target", F.when(first.isNotNull() & (cap / F.col("weight") >= first), F.least(held * F.col("weight"), cap)).otherwise(cap)).select("source", "source_size", "weight", "target")


def hash_hex(x: Column) -> Column:
    return F.md5(F.coalesce(x.cast("string"), F.lit("")).cast("binary"))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Returns docs with size, source_size, target and copies (0 to most); columns of docs so named are replaced.

    Null text has size 0; null source is a source of its own. Equal rows are rows of their own. The same input gives
    the same result. Sources of size 0 get target 0 and no copies. An empty table gives an empty table.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    h = hash_hex(F.col("doc_id"))
    size = F.col("size")
    level = F.floor(F.log2(size + 1.0) * 4 + 1e-9).cast("int")
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumns({"__h": h, "__t": hash_hex(F.col("text")), "__bin": F.concat(F.lpad(level.cast("string"), 4, "0"), F.substring(h, 1, HEX))})
    # One key without nulls serves the ranking and the join, so documents move once.
    sized = sized.withColumn("__g", F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "__bin"))
    bins = cut(sized.groupBy("source", "__bin", "__g").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mix-bins")
    rates = targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(rates.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "n", "size", "weight")
    starts = cut(starts.select("__g", F.col("before").alias("__before"), "source_size", "target"), "mix-starts")
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("size", "__h", "__t"))
    placed = sized.withColumn("__rank", rank).join(starts, "__g")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(hash_hex(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    reach = lambda i: F.floor(F.lit(1.0) * i * rate + offset)
    i = F.col("__before") + F.col("__rank")
    return placed.withColumn("copies", (reach(i) - reach(i - 1)).cast("int")).drop("__h", "__t", "__bin", "__rank", "__g", "__before")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with the columns of docs."""
    return copies(docs, **how).where("copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "copies")], F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__copy")).drop("__copy")


def op2_systematic_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (
  SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS held,
         min(CASE WHEN level * weight <= cap THEN CAST(cap AS DOUBLE) / weight END) OVER () AS first_free FROM l),
t AS (
  SELECT source, source_size, CASE WHEN first_free IS NOT NULL AND CAST(cap AS DOUBLE) / weight >= first_free
         THEN least(held * weight, CAST(cap AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target FROM h),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(d.size + 1.0) * 4 + 1e-9), substr(h, 1, 2), d.size, h, md5(coalesce(d.text, ''))) AS i,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix|' || coalesce(d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(i * rate + off) - floor((i - 1) * rate + off)) AS BIGINT) AS taken FROM r
"""
