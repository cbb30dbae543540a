"""Filters, grid geometry and normalisation of a long cube (time, cell, lat, lon, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_cell():
    return Window.partitionBy("cell")


def by_month():
    return Window.partitionBy("cell", "month")


def one_if_zero(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def densify(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Every day from the first to the last for every cell; days without a row get 0."""
    low, high = cube.agg(F.min("time"), F.max("time")).first()
    if low is None:
        return cube.select("time", *keys, value)
    days = cube.select(*keys).distinct().withColumn("time", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return days.join(cube.select("time", *keys, value), ["time", *keys], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def season(cube: DataFrame, months: list[int] | None) -> DataFrame:
    return cube.where(F.month("time").isin(months)) if months else cube


def hydro_year(time: Column, first: int = 6) -> Column:
    return F.when(F.month(time) >= first, F.year(time)).otherwise(F.year(time) - 1)


def year_filter(cube: DataFrame, year: str | None) -> DataFrame:
    """None or "all", "before_1981", "after_1981" (that year included); anything else is an error."""
    if year in (None, "all"):
        return cube
    m = re.fullmatch(r"(before|after)_(\d{4})", year)
    if not m:
        raise ValueError(f"unknown year filter {year!r}")
    y = F.year("time")
    return cube.where(y < int(m[2]) if m[1] == "before" else y >= int(m[2]))


def years_inclusive(cube: DataFrame, first: int, last: int) -> DataFrame:
    return cube.where(F.year("time").between(first, last))


def years_half_open(df: DataFrame, first: int, stop: int) -> DataFrame:
    return df.where((F.col("time") >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col("time") < F.make_date(F.lit(stop), F.lit(1), F.lit(1))))


def grid_index(cells: DataFrame) -> DataFrame:
    """Adds row and col: ranks of latitude and longitude from 0. One row per cell, so one task orders the axes."""
    axis = lambda c, to: cells.select(c).distinct().withColumn(to, F.row_number().over(Window.orderBy(c)) - 1)
    return cells.drop("row", "col").join(axis("lat", "row"), "lat").join(axis("lon", "col"), "lon")


def resolution(cells: DataFrame, how: str = "min") -> DataFrame:
    """(dlat, dlon): smallest or median step of the coordinates."""

    def step(c: str) -> DataFrame:
        d = cells.select(c).distinct().withColumn("d", F.col(c) - F.lag(c).over(Window.orderBy(c))).where("d IS NOT NULL")
        return d.agg((F.min("d") if how == "min" else F.percentile("d", F.lit(0.5))).alias(f"d{c}"), F.lit(1).alias("k"))

    return step("lat").join(step("lon"), "k").drop("k")


def cell_area(lat: Column, dlat: Column, dlon: Column) -> Column:
    """Square kilometres of a cell; summed they are the area of a region."""
    return dlat * 111.32 * dlon * 111.32 * F.cos(F.radians(lat))


Ring = list[tuple[float, float]]


def polygon_edges(spark: SparkSession, polygons: list[Ring | list[Ring]]) -> DataFrame:
    """(poly, ring, ax, ay, bx, by): the edges of closed rings (x, y). A polygon is one ring, or an outer ring (0) and its holes."""
    rows = []
    for k, polygon in enumerate(polygons):
        for n, r in enumerate([polygon] if not polygon or isinstance(polygon[0][0], (int, float)) else polygon):
            closed = [*r, r[0]] if r[0] != r[-1] else list(r)
            rows += [(k, n, *map(float, (*a, *b))) for a, b in zip(closed, closed[1:])]
    return spark.createDataFrame(rows, "poly int, ring int, ax double, ay double, bx double, by double")


def touched(cells: DataFrame, edges: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """Distinct (lat, lon) of cells whose box touches a polygon, the inside of holes apart.

    Cells and edges meet on the rows of the grid that an edge spans, so a cell sees the edges of its own row alone. Their
    crossings of the ray from the cell to the east are counted by aggregation: an odd number means within. A ring runs
    through a box if a vertex is in it or an edge crosses one of its sides.
    """
    x, y = F.col("lon"), F.col("lat")
    row = lambda v: F.floor(v / dlat).cast("long")
    boxes = cells.select("lat", "lon").distinct().withColumn("__r", row(y))
    span = boxes.agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi"))
    low, high = F.greatest(row(F.least("ay", "by") - dlat), "__lo"), F.least(row(F.greatest("ay", "by") + dlat), "__hi")
    near = edges.crossJoin(span).where(low <= high).withColumn("__r", F.explode(F.sequence(low, high)))  # span is one row
    ax, ay, bx, by = map(F.col, ("ax", "ay", "bx", "by"))
    x0, x1, y0, y1 = x - dlon / 2, x + dlon / 2, y - dlat / 2, y + dlat / 2
    ray = (ay != by) & ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
    cuts = (x0 <= ax) & (x1 >= ax) & (y0 <= ay) & (y1 >= ay)
    for at in (x0, x1):
        t = (at - ax) / F.nullif(bx - ax, F.lit(0.0))
        cuts = cuts | F.coalesce(t.between(0, 1) & (ay + t * (by - ay)).between(y0, y1), F.lit(False))
    for at in (y0, y1):
        t = (at - ay) / F.nullif(by - ay, F.lit(0.0))
        cuts = cuts | F.coalesce(t.between(0, 1) & (ax + t * (bx - ax)).between(x0, x1), F.lit(False))
    rings = boxes.join(near, "__r").groupBy("lat", "lon", "poly", "ring").agg(F.count_if(ray).alias("__n"), F.bool_or(cuts).alias("__cut"))
    odd = F.col("__n") % 2 == 1
    parts = rings.groupBy("lat", "lon", "poly").agg(F.bool_or((F.col("ring") == 0) & (odd | F.col("__cut"))).alias("__in"), F.bool_or((F.col("ring") > 0) & odd & ~F.col("__cut")).alias("__out"))
    return parts.where("__in AND NOT __out").select("lat", "lon").distinct()


def clip(cube: DataFrame, polygons: list, dlon: float, dlat: float, cells: DataFrame | None = None) -> DataFrame:
    """Rows of cells whose box touches one of the polygons. cells, if given, has the (lat, lon) of all cells, and the cube is read once."""
    edges = polygon_edges(cube.sparkSession, polygons)
    return cube.join(touched(cube if cells is None else cells, edges, dlon, dlat), ["lat", "lon"], "left_semi")


def valid_cells(cube: DataFrame) -> DataFrame:
    """One row: the number of cells that have any value."""
    return cube.where(F.col("value").isNotNull()).agg(F.countDistinct("cell").alias("valid_cells"))


def roi(cube: DataFrame, least: int = 1) -> DataFrame:
    """Cells with enough values that are not all alike."""
    return cube.groupBy("cell").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("sd")).where((F.col("n") >= least) & (F.col("sd") > 0))


def whole_cells(cube: DataFrame) -> DataFrame:
    """Rows of cells without any missing value."""
    return cube.withColumns({"__n": F.count("value").over(by_cell()), "__m": F.count(F.lit(1)).over(by_cell())}).where("__n = __m").drop("__n", "__m")


def scaled(value: Column, units: str) -> Column:
    """Metres become millimetres."""
    return value * 1000 if units.strip().lower() in ("m", "meter", "meters", "metre", "metres") else value


def wet(value: Column, least: float = 1e-4) -> Column:
    return F.when(value >= least, value).otherwise(0.0)


def zscore(cube: DataFrame) -> DataFrame:
    mean, sd = F.avg("value").over(by_cell()), F.stddev_pop("value").over(by_cell())
    return cube.withColumn("z", (F.col("value") - mean) / one_if_zero(sd))


def matrix_value(z: Column) -> Column:
    """Missing counts as the mean."""
    return F.coalesce(clean(z), F.lit(0.0))


def climatology(cube: DataFrame) -> DataFrame:
    return cube.groupBy("cell", F.month("time").alias("month")).agg(F.avg("value").alias("clim"), F.stddev_pop("value").alias("sd"))


def anomalies(cube: DataFrame) -> DataFrame:
    """Adds anomaly and std_anomaly against each cell's calendar month."""
    c = cube.withColumn("month", F.month("time"))
    c = c.withColumn("anomaly", F.col("value") - F.avg("value").over(by_month()))
    return c.withColumn("std_anomaly", F.col("anomaly") / one_if_zero(F.stddev_pop("anomaly").over(by_month())))


def detrend(df: DataFrame, value: str = "anomaly") -> DataFrame:
    """Adds detrended (least squares in days, by cell) and detrended_norm. The line is fitted by one aggregate per cell."""
    t = F.datediff("time", F.lit("1970-01-01").cast("date")).cast("double")
    fit = df.groupBy("cell").agg(F.regr_slope(F.col(value), t).alias("__b"), F.regr_intercept(F.col(value), t).alias("__a"))
    d = df.join(fit, "cell").withColumn("detrended", F.col(value) - (F.coalesce("__a", F.lit(0.0)) + F.coalesce("__b", F.lit(0.0)) * t)).drop("__a", "__b")
    return d.withColumn("detrended_norm", F.col("detrended") / one_if_zero(F.stddev_pop("detrended").over(by_cell())))


def hydro_totals(cube: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row: mean over cells of the total per hydrological year."""
    years = cube.select(hydro_year(F.col("time")).alias("y")).distinct().agg(F.count("*").alias("years"), F.lit(1).alias("k"))
    total = cube.groupBy("cell").agg((F.sum("value") * scale).alias("total")).agg(F.avg("total").alias("mean_total"), F.lit(1).alias("k"))
    return total.join(years, "k").select((F.col("mean_total") / F.col("years")).alias("mean_total_per_year"), "years")
