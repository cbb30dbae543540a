"""Monotone trends of rolling series (keys, n-th value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions import kernels


def pieces(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s, var_s, slope, intercept) from (keys, i, v): the Mann-Kendall sum, its variance with ties, Sen's line."""
    a, b = series.select(*keys, F.col("i").alias("ia"), F.col("v").alias("va")), series.select(*keys, "i", "v")
    pair = a.join(b, keys).where("ia < i").groupBy(*keys).agg(F.sum(F.signum(F.col("v") - F.col("va"))).cast("long").alias("s"), F.percentile((F.col("v") - F.col("va")) / (F.col("i") - F.col("ia")), F.lit(0.5)).alias("slope"))
    ties = series.groupBy(*keys, "v").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    mid = series.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("median"))
    n = F.col("n")
    out = pair.join(ties, keys).join(mid, keys)
    return out.select(*keys, "n", "s", ((n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18).alias("var_s"), "slope", (F.col("median") - (n - 1) / 2 * F.col("slope")).alias("intercept"))


def mann_kendall(series: DataFrame, keys: list[str]) -> DataFrame:
    """Hamed and Rao's test for each key; a rolling series has some tens of values, so a group is small."""
    kinds = dict(series.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, s double, slope double, intercept double, z double, p double, trend string, significant boolean"

    def test(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: t[k].iloc[0] for k in keys} | kernels.mann_kendall(t.sort_values("i").v.to_numpy(float))])

    return series.groupBy(*keys).applyInPandas(test, schema)


def trend_table(series: DataFrame, keys: list[str], periods: list[tuple[int, int]]) -> DataFrame:
    """(keys, period, slope, slope_rel_pct, slope_z, intercept, p, trend, significant) from (keys, time, v).

    The period "full" and half-open periods of years; slopes are per step and scaled by the full series.
    """
    s = series.where(F.col("v").isNotNull())
    whole = s.groupBy(*keys).agg(F.avg("v").alias("__m"), F.stddev_samp("v").alias("__sd"))
    inside = [F.when((F.year("time") >= a) & (F.year("time") < b), F.lit(f"{a}-{b}")) for a, b in periods]
    spans = F.array_compact(F.array(F.lit("full"), *inside))
    each = s.withColumn("period", F.explode(spans))
    each = each.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "period").orderBy("time")) - 1)
    got = mann_kendall(each.select(*keys, "period", "i", "v"), [*keys, "period"]).join(whole, keys)
    return got.withColumns({"slope_rel_pct": 100 * F.col("slope") / F.nullif(F.col("__m"), F.lit(0.0)), "slope_z": F.col("slope") / F.nullif(F.col("__sd"), F.lit(0.0))}).drop("__m", "__sd", "s", "z")
