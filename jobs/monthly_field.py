"""Extends a gridded daily field by the months that have been completed since the last run.

    python -m jobs.monthly_field --input lineitem.parquet --output results [--config jobs/monthly_field.json]

Observations are summed by day and cell. Each closed month, one that has rows of a later month behind it, is written
once: its daily values and their anomalies against the fixed normals of the baseline years (daily/month=...), and the
recurrence metrics and dryness of the rolling windows that end in it (windows/month=...). Normals are written in the
first run that has the whole baseline; before that a run writes nothing. The table mark says up to which day the output
is whole. A run reads the rows after it, and as much of the output as its windows reach back. A run that failed midway
left the mark as it was, so the next one writes the same months again.

Rows that arrive for closed months later on are not taken; --since YYYY-MM writes the months from then on anew.
"""

from __future__ import annotations

import argparse
import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import cube as C
from isohyet.operators import recurrence as R
from isohyet.operators import windows as W
from jobs.common import config, log, read_if_there, settings

DEFAULT = Path(__file__).with_suffix(".json")
MARK = "first date, through date"
NORMALS = "cell long, calendar_month int, mean double, sd double"
DAILY = "time date, cell long, value double, anomaly double, month string"
WINDOWS = "win long, first date, last date, det double, lam double, entr double, lmean double, rain double, dry_fraction double, dry_node_fraction double, month string"
METRICS = ["det", "lam", "entr", "lmean"]


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def observed(rows: DataFrame, cfg: dict, after: datetime.date | None, through: datetime.date | None = None) -> DataFrame:
    """(time, cell, value): sums by day and cell; the limits reach the scan as filters on the column itself."""
    at = F.expr(cfg["time"])
    if after:
        rows = rows.where(at >= F.lit(str(after + datetime.timedelta(1))).cast("timestamp_ntz"))
    if through:
        rows = rows.where(at < F.lit(str(through + datetime.timedelta(1))).cast("timestamp_ntz"))
    each = rows.select(at.cast("date").alias("time"), F.expr(cfg["cell"]).cast("long").alias("cell"), F.expr(cfg["value"]).cast("double").alias("value"))
    return each.dropna(subset=["time", "cell"]).where(F.col("cell").between(0, cfg["cells"] - 1)).groupBy("time", "cell").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def every_day(found: DataFrame, first: datetime.date, last: datetime.date, cells: int) -> DataFrame:
    """A row for each day and cell of the grid; days without observations have 0."""
    days = found.sparkSession.range(cells).select(F.col("id").alias("cell"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("time"))
    return days.join(found, ["time", "cell"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def run(spark: SparkSession, source: str, output: str, cfg: dict, since: str | None = None) -> dict[str, int]:
    """Takes the months closed since the last run; returns the days and windows written. See the module."""
    rows = spark.read.parquet(source)
    mark = read_if_there(spark, f"{output}/mark", MARK).agg(F.min("first").alias("first"), F.max("through").alias("through")).first()
    first, after = mark.first, mark.through
    if since and after:
        after = min(after, datetime.date.fromisoformat(f"{since}-01") - datetime.timedelta(1))
        if after < first:
            after = None
    span = observed(rows, cfg, after).agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    if span.high is None:
        log.info("%s: no rows after %s, nothing written", source, after)
        return {"days": 0, "windows": 0}
    first = first or span.low.replace(day=1)
    start = after + datetime.timedelta(1) if after else first
    through = span.high.replace(day=1) - datetime.timedelta(1)
    until = datetime.date(cfg["baseline"][1], 12, 31)
    if through < start or (not after and through < until):
        log.info("%s: rows up to %s close no month to be written%s", source, span.high, "" if after else f"; the baseline ends {until}")
        return {"days": 0, "windows": 0}
    with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        field = every_day(observed(rows, cfg, after, through), start, through, cfg["cells"])
        if not after:
            base = C.climatology(C.years_inclusive(field, *cfg["baseline"]))
            base.select("cell", F.col("month").alias("calendar_month"), F.col("clim").alias("mean"), "sd").coalesce(1).write.mode("overwrite").parquet(f"{output}/normals")
        normals = spark.read.schema(NORMALS).parquet(f"{output}/normals")
        z = (F.col("value") - F.col("mean")) / C.one_if_zero(F.col("sd"))
        daily = field.withColumn("calendar_month", F.month("time")).join(normals, ["cell", "calendar_month"])
        daily = daily.select("time", "cell", "value", z.alias("anomaly"), month_of(F.col("time")).alias("month"))
        daily.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{output}/daily")
        found = windows(spark, output, cfg, first, start, through)
        found.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{output}/windows")
    days = (through - start).days + 1
    wins = spark.read.schema(WINDOWS).parquet(f"{output}/windows").where(F.col("month") >= f"{start:%Y-%m}").count()
    if not mark.through or through > mark.through:
        spark.createDataFrame([(first, through)], MARK).coalesce(1).write.mode("append").parquet(f"{output}/mark")
    log.info("%s: read rows from %s to %s, wrote %d days of %d cells and %d windows to %s", source, start, through, days, cfg["cells"], wins, output)
    return {"days": days, "windows": wins}


def windows(spark: SparkSession, output: str, cfg: dict, first: datetime.date, start: datetime.date, through: datetime.date) -> DataFrame:
    """Windows that end from start to through, out of the daily table; windows start every step_days from the first day."""
    size, step = cfg["window_days"], cfg["step_days"]
    back = max(first, start - datetime.timedelta(size))
    daily = spark.read.schema(DAILY).parquet(f"{output}/daily").where((F.col("month") >= f"{back:%Y-%m}") & F.col("time").between(F.lit(back), F.lit(through)))
    place = F.datediff("time", F.lit(first))
    days = daily.select("time").distinct().withColumns({"pos": place, "total": F.lit((through - first).days + 1)})
    own = W.row_windows(days, size, step).where(F.date_add(F.lit(first), (F.col("win") * step + size - 1).cast("int")) >= F.lit(start)).select("win", "time", "rel")
    state = daily.groupBy("time").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "anomaly"))), lambda s: s["anomaly"]).alias("x"))
    counts = R.line_histograms(own.join(state, "time").select("win", F.col("rel").cast("int").alias("i"), "x"), cfg["quantile"], cfg["theiler"])
    lines = R.histogram_metrics(counts, size).select("win", *METRICS)
    rain = own.join(W.daily(daily, [], cfg["dry"]), "time").groupBy("win").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.percentile("mean", F.lit(0.5)).alias("rain"), F.avg("dry_day").alias("dry_fraction"), F.avg("dry_node_fraction").alias("dry_node_fraction"))
    return rain.join(lines, "win", "left").select("win", "first", "last", *METRICS, "rain", "dry_fraction", "dry_node_fraction", month_of(F.col("last")).alias("month"))


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """All of the output as one table, metrics to 6 decimals, with the part that a row is of."""
    r6 = lambda *names: [(F.round(n, 6) + 0.0).alias(n) for n in names]
    daily = read_if_there(spark, f"{output}/daily", DAILY).select(F.lit("daily").alias("part"), "month", F.col("cell").alias("item"), F.col("time").cast("string").alias("first"), *r6("value", "anomaly"))
    wins = read_if_there(spark, f"{output}/windows", WINDOWS).select(F.lit("window").alias("part"), "month", F.col("win").alias("item"), F.col("first").cast("string").alias("first"), *r6(*METRICS, "rain", "dry_fraction", "dry_node_fraction"))
    normals = read_if_there(spark, f"{output}/normals", NORMALS).select(F.lit("normal").alias("part"), F.lpad(F.col("calendar_month").cast("string"), 2, "0").alias("month"), F.col("cell").alias("item"), *r6("mean", "sd"))
    mark = read_if_there(spark, f"{output}/mark", MARK).select(F.lit("mark").alias("part"), month_of(F.col("through")).alias("month"), F.col("first").cast("string").alias("first"))
    return daily.unionByName(wins, True).unionByName(normals, True).unionByName(mark, True)


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    a.add_argument("--input", required=True, help="Parquet table of observations")
    a.add_argument("--output", required=True)
    a.add_argument("--config", default=DEFAULT)
    a.add_argument("--since", help="YYYY-MM: write the months from then on anew")
    o = a.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.input, o.output, config(o.config), o.since)
    finally:
        spark.stop()


if __name__ == "__main__":
    import logging

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    main()
