"""Windows of a fixed number of rows, and the rolling series over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(time) -> (time, pos, total): places of the distinct times from 0. The time axis is small beside the cube."""
    keys = keys or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.select(*keys, "time").distinct().withColumns({"pos": F.row_number().over(w.orderBy("time")) - 1, "total": F.count(F.lit(1)).over(w)})


def row_windows(times: DataFrame, size: int, step: int) -> DataFrame:
    """Positions -> one row for each window (win) that holds them, with rel from 0; windows start at multiples of step and are whole."""
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("total") - size) / step))
    wins = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    out = times.withColumn("win", F.explode(wins))
    return out.withColumn("rel", F.col("pos") - F.col("win") * step)


def step_of(size: int, overlap: float) -> int:
    """Overlap below 1 is a share of the window, else rows."""
    return max(1, size - int(size * overlap if 0 < overlap < 1 else overlap))


def midpoints(windows: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """(win, time, label): the time of row size // 2, and the first and last month."""
    label = F.concat(F.date_format(F.min("time"), "yyyy-MM"), F.lit(" – "), F.date_format(F.max("time"), "yyyy-MM"))
    return windows.groupBy(*(keys or []), "win").agg(F.max(F.when(F.col("rel") == size // 2, F.col("time"))).alias("time"), label.alias("label"))


def daily(cube: DataFrame, keys: list[str], dry: float = 0.0) -> DataFrame:
    """Mean and median over cells, share of dry cells, whether all are dry, for each day."""
    v = F.col("value")
    return cube.groupBy(*keys, "time").agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg((v <= dry).cast("double")).alias("dry_node_fraction"), F.bool_and(v <= dry).cast("double").alias("dry_day"))


def rain_rolling(days: DataFrame, size: int, step: int, keys: list[str] | None = None) -> DataFrame:
    """Median of the daily means, share of dry days and mean share of dry cells in each window."""
    keys = keys or []
    w = days.join(row_windows(positions(days, keys), size, step), [*keys, "time"])
    return w.groupBy(*keys, "win").agg(
        F.max(F.when(F.col("rel") == size // 2, F.col("time"))).alias("time"), F.percentile("mean", F.lit(0.5)).alias("rain"),
        F.avg("dry_day").alias("dry_fraction"), F.avg("dry_node_fraction").alias("dry_node_fraction"),
    )


def smooth(series: DataFrame, value: str, days: int, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Adds <value>_med, _low and _high over the days (t - days/2, t + days/2]."""
    d = F.datediff("time", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__d").rangeBetween(-(days // 2) + 1, days // 2)
    at = lambda p: F.percentile(F.col(value), F.lit(p)).over(w)
    return series.withColumn("__d", d).withColumns({f"{value}_med": at(0.5), f"{value}_low": at(alpha / 2), f"{value}_high": at(1 - alpha / 2)}).drop("__d")


def by_year(days: DataFrame) -> DataFrame:
    """Mean share of dry cells and number of wholly dry days for each calendar year from first to last."""
    low, high = days.agg(F.min(F.year("time")), F.max(F.year("time"))).first()
    years = days.sparkSession.range(low or 0, (high if high is not None else -1) + 1).select(F.col("id").cast("int").alias("year"))
    got = days.groupBy(F.year("time").alias("year")).agg(F.avg("dry_node_fraction").alias("dry_node_fraction"), F.sum("dry_day").alias("dry_days"))
    return years.join(got, "year", "left").withColumn("dry_days", F.coalesce("dry_days", F.lit(0.0)))


def highest_median(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, highest): the largest daily median."""
    return days.groupBy(*keys).agg(F.max("median").alias("highest"))


def padded_limits(series: DataFrame, metrics: list[str], pad: float = 0.1) -> DataFrame:
    """(metric, low, high): range of each metric and its band over all series, widened by a share; 0 to 1 without values.

    A metric's band is in the columns <metric>_low and <metric>_high, where the series has them.
    """
    columns = {m: [c for c in (m, f"{m}_low", f"{m}_high") if c in series.columns] for m in metrics}
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c))
    ends = [f(fine(c).cast("double")).alias(f"{c}__{n}") for cs in columns.values() for c in cs for n, f in (("min", F.min), ("max", F.max))]
    one = series.agg(*ends)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[f(F.array(*[F.col(f"{c}__{n}") for c in cs])).alias(n) for n, f in (("min", F.array_min), ("max", F.array_max))]) for m, cs in columns.items()])
    got = one.select(F.explode(rows).alias("r")).select("r.*")
    margin = (F.col("max") - F.col("min")) * pad
    return got.select("metric", F.coalesce(F.col("min") - margin, F.lit(0.0)).alias("low"), F.coalesce(F.col("max") + margin, F.lit(1.0)).alias("high"))


def first_k(win: Column, k: int) -> Column:
    return win < k


def every_nth(win: Column, n: int) -> Column:
    return F.pmod(win, F.lit(n)) == 0


def period_chunks(first: int, last: int, length: int, least: int | None = None) -> list[tuple[int, int]]:
    """Consecutive periods of years; a tail shorter than least (half the length) is left out."""
    least = length // 2 if least is None else least
    return [(y, min(y + length - 1, last)) for y in range(first, last + 1, length) if min(y + length - 1, last) - y + 1 >= least]


def by_period(df: DataFrame, periods: list[tuple[int, int]]) -> DataFrame:
    """A row for each (inclusive) period that holds it, so one job serves all periods."""
    each = F.filter(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in periods]), lambda p: F.year("time").between(p["first"], p["last"]))
    return df.withColumn("__p", F.explode(each)).withColumn("period", F.concat_ws("-", "__p.first", "__p.last")).drop("__p")
