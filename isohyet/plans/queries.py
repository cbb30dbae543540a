"""Registered queries of the engine, each with its SQL twin where SQL can express it.

The cube is made of lineitem: one value (summed quantity) per day and cell, 100 cells by part key on a 10 x 10 grid,
days without rows are dry. The state series is made of embeddings, in order of vec_id.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.operators import cube as C
from isohyet.operators import grid as G
from isohyet.operators import recurrence as R
from isohyet.operators import spectral as S
from isohyet.operators import trend as T
from isohyet.operators import windows as W
from isohyet.operators.hold import hold
from isohyet.plans import analysis
from isohyet.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

JJAS = [6, 7, 8, 9]
#: Rows and step of the rolling windows over days, and over the state series; quantile and Theiler window there.
SIZE, STEP = 732, 122
STATE, STATE_STEP, Q, THEILER = 100, 50, 0.1, 2

BASE = """
b AS (SELECT CAST(l_shipdate AS DATE) AS time, l_partkey % 100 AS cell, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(time) FROM b) AS TIMESTAMP), CAST((SELECT max(time) FROM b) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time),
cells AS (SELECT DISTINCT cell, cell // 10 AS "row", cell % 10 AS col, CAST(10 + (cell // 10) * 0.25 AS DOUBLE) AS lat, CAST(75 + (cell % 10) * 0.25 AS DOUBLE) AS lon FROM b),
cube AS (SELECT d.time, c.*, coalesce(b.value, 0) AS value FROM days d CROSS JOIN cells c LEFT JOIN b ON b.time = d.time AND b.cell = c.cell)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_cube(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{',' + more if more else ''}\n{select}"


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def sparse(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_shipdate").cast("date").alias("time"), (F.col("l_partkey") % 100).alias("cell")).agg(F.sum("l_quantity").alias("value"))


def placed(df: DataFrame) -> DataFrame:
    row, col = F.floor(F.col("cell") / 10).cast("int"), (F.col("cell") % 10).cast("int")
    return df.withColumns({"row": row, "col": col, "lat": F.lit(10.0) + row * 0.25, "lon": F.lit(75.0) + col * 0.25})


def cube(spark, d: str) -> DataFrame:
    return placed(C.densify(sparse(spark, d), ["cell"]))


def cells(spark, d: str) -> DataFrame:
    return placed(spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 100).alias("cell")).distinct())


@query("cube_melt", on_cube("SELECT lat, lon, CAST(make_date(year(time), 1, 1) AS VARCHAR) AS time, sum(value) AS rainfall FROM cube GROUP BY 1, 2, 3"))
def cube_melt(spark, d):
    c = cube(spark, d)
    wide = c.withColumn("y", F.concat(F.year("time"), F.lit("/01/01"))).groupBy("lat", "lon").pivot("y").sum("value")
    return tables.melt(wide).select("lat", "lon", F.col("time").cast("string").alias("time"), "rainfall")


@query("season_filter", on_cube("SELECT cell, count(*) AS n, sum(value) AS total FROM cube WHERE month(time) IN (6, 7, 8, 9) GROUP BY 1"))
def season_filter(spark, d):
    return C.season(cube(spark, d), JJAS).groupBy("cell").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("hydro_year_total", on_cube("SELECT round(avg(total) / (SELECT count(DISTINCT CASE WHEN month(time) >= 6 THEN year(time) ELSE year(time) - 1 END) FROM cube), 6) AS mean_total_per_year, (SELECT count(DISTINCT CASE WHEN month(time) >= 6 THEN year(time) ELSE year(time) - 1 END) FROM cube) AS years FROM (SELECT cell, sum(value) AS total FROM cube GROUP BY 1)"))
def hydro_year_total(spark, d):
    return C.hydro_totals(cube(spark, d)).select(*r6("mean_total_per_year"), *long("years"))


@query("year_filter", on_cube("SELECT 'before' AS part, count(*) AS n, sum(value) AS total FROM cube WHERE year(time) < 1998 UNION ALL SELECT 'after', count(*), sum(value) FROM cube WHERE year(time) >= 1998"))
def year_filter(spark, d):
    c = cube(spark, d)
    one = lambda part: C.year_filter(c, f"{part}_1998").agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return one("before").unionByName(one("after"))


@query("period_filters", on_cube("SELECT 'inclusive' AS kind, count(*) AS n, sum(value) AS total FROM cube WHERE year(time) BETWEEN 1996 AND 1999 UNION ALL SELECT 'half_open', count(*), sum(value) FROM cube WHERE time >= DATE '1996-01-01' AND time < DATE '1999-01-01'"))
def period_filters(spark, d):
    c = cube(spark, d)
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return one(C.years_inclusive(c, 1996, 1999), "inclusive").unionByName(one(C.years_half_open(c, 1996, 1999), "half_open"))


@query("zscore_cell", on_cube("SELECT CAST(time AS VARCHAR) AS time, cell, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 6) + 0.0 AS z FROM cube WHERE month(time) IN (6, 7, 8, 9) WINDOW w AS (PARTITION BY cell)"))
def zscore_cell(spark, d):
    return C.zscore(C.season(cube(spark, d), JJAS)).select(F.col("time").cast("string").alias("time"), "cell", (F.round(C.matrix_value(F.col("z")), 6) + 0.0).alias("z"))


@query("climatology", on_cube("SELECT cell, month(time) AS month, round(avg(value), 6) AS clim, round(stddev_pop(value), 6) AS sd FROM cube GROUP BY 1, 2"))
def climatology(spark, d):
    return C.climatology(cube(spark, d)).select("cell", *long("month"), *r6("clim", "sd"))


@query("month_anomaly", on_cube("SELECT CAST(time AS VARCHAR) AS time, cell, round(anomaly, 6) + 0.0 AS anomaly, round(anomaly / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS std_anomaly FROM a", " a0 AS (SELECT *, value - avg(value) OVER (PARTITION BY cell, month(time)) AS anomaly FROM cube), a AS (SELECT *, stddev_pop(anomaly) OVER (PARTITION BY cell, month(time)) AS sd FROM a0)"))
def month_anomaly(spark, d):
    return C.anomalies(cube(spark, d)).select(F.col("time").cast("string").alias("time"), "cell", (F.round("anomaly", 6) + 0.0).alias("anomaly"), (F.round("std_anomaly", 6) + 0.0).alias("std_anomaly"))


@query("detrend_cell", on_cube("SELECT cell, round(sum(abs(r)), 4) AS size, round(stddev_pop(r), 6) AS sd, round(max(r / s), 6) AS top FROM (SELECT *, stddev_pop(r) OVER (PARTITION BY cell) AS s FROM (SELECT cell, anomaly - (regr_intercept(anomaly, t) OVER w + regr_slope(anomaly, t) OVER w * t) AS r FROM a WINDOW w AS (PARTITION BY cell))) GROUP BY 1", " a AS (SELECT cell, CAST(date_diff('day', DATE '1970-01-01', time) AS DOUBLE) AS t, value - avg(value) OVER (PARTITION BY cell, month(time)) AS anomaly FROM cube)"))
def detrend_cell(spark, d):
    return C.detrend(C.anomalies(cube(spark, d))).groupBy("cell").agg(F.round(F.sum(F.abs("detrended")), 4).alias("size"), F.round(F.stddev_pop("detrended"), 6).alias("sd"), F.round(F.max("detrended_norm"), 6).alias("top"))


@query("grid_geometry", on_cube("SELECT cell, \"row\", col, round(cos(radians(lat)) * 0.25 * 111.32 * 0.25 * 111.32, 6) AS area FROM cells"))
def grid_geometry(spark, d):
    c = cells(spark, d)
    step = C.resolution(c).first()
    return C.grid_index(c).select("cell", *long("row", "col"), F.round(C.cell_area(F.col("lat"), F.lit(step.dlat), F.lit(step.dlon)), 6).alias("area"))


@query("grid_resolution", on_cube("SELECT how, round(CASE how WHEN 'min' THEN (SELECT min(d) FROM y) ELSE (SELECT median(d) FROM y) END, 9) AS dlat, round(CASE how WHEN 'min' THEN (SELECT min(d) FROM x) ELSE (SELECT median(d) FROM x) END, 9) AS dlon FROM (VALUES ('min'), ('median')) h(how)", " y AS (SELECT lat - lag(lat) OVER (ORDER BY lat) AS d FROM (SELECT DISTINCT lat + 0.01 * \"row\" * \"row\" AS lat FROM cells)), x AS (SELECT lon - lag(lon) OVER (ORDER BY lon) AS d FROM (SELECT DISTINCT lon + 0.02 * col * col AS lon FROM cells))"))
def grid_resolution(spark, d):
    # Axes with uneven steps, so the smallest and the median differ.
    c = cells(spark, d).select((F.col("lat") + 0.01 * F.col("row") * F.col("row")).alias("lat"), (F.col("lon") + 0.02 * F.col("col") * F.col("col")).alias("lon"))
    one = lambda how: C.resolution(c, how).select(F.lit(how).alias("how"), F.round("dlat", 9).alias("dlat"), F.round("dlon", 9).alias("dlon"))
    return one("min").unionByName(one("median"))


@query("grid_area", on_cube("SELECT count(*) AS cells, round(sum(cos(radians(lat)) * 0.25 * 111.32 * 0.25 * 111.32), 4) AS square_km FROM cells"))
def grid_area(spark, d):
    return cells(spark, d).agg(F.count("*").alias("cells"), F.round(F.sum(C.cell_area(F.col("lat"), F.lit(0.25), F.lit(0.25))), 4).alias("square_km"))


#: A triangle and a smaller one within it, and by separating axes whether a cell's box touches or lies within them.
TRIANGLE, HOLE = [(75.31, 10.22), (77.13, 10.91), (75.87, 12.14)], [(75.7, 10.6), (76.7, 10.95), (76.0, 11.6)]


def apart(points, within: bool = False) -> str:
    """SQL: whether box and triangle are apart (or, within, whether the box is not wholly inside)."""
    tests = []
    (ax, ay), (bx, by), (cx, cy) = points
    for (px, py), (qx, qy), (rx, ry) in (((ax, ay), (bx, by), (cx, cy)), ((bx, by), (cx, cy), (ax, ay)), ((cx, cy), (ax, ay), (bx, by))):
        nx, ny = qy - py, px - qx
        if nx * (rx - px) + ny * (ry - py) < 0:
            nx, ny = -nx, -ny
        side = f"({nx} * (lon - {px}) + {ny} * (lat - {py}))"
        tests.append(f"{side} {'-' if within else '+'} {0.125 * (abs(nx) + abs(ny))} < 0")
    if not within:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        tests += [f"lon + 0.125 < {min(xs)}", f"lon - 0.125 > {max(xs)}", f"lat + 0.125 < {min(ys)}", f"lat - 0.125 > {max(ys)}"]
    return "(" + " OR ".join(tests) + ")"


@query("clip_polygon", on_cube(f"SELECT cell, sum(value) AS total FROM cube WHERE NOT {apart(TRIANGLE)} GROUP BY 1"))
def clip_polygon(spark, d):
    return C.clip(cube(spark, d), [TRIANGLE], 0.25, 0.25).groupBy("cell").agg(F.sum("value").alias("total"))


@query("clip_with_hole", on_cube(f"SELECT cell, sum(value) AS total FROM cube WHERE NOT {apart(TRIANGLE)} AND {apart(HOLE, True)} GROUP BY 1"))
def clip_with_hole(spark, d):
    return C.clip(cube(spark, d), [[TRIANGLE, HOLE]], 0.25, 0.25).groupBy("cell").agg(F.sum("value").alias("total"))


#: A concave coast of 180 vertices around most of the grid, with a hole of 120, to 6 decimals.
COAST, LAKE = ([(round(x + r * math.cos(a), 6), round(y + r * math.sin(a), 6)) for a, r in ((2 * math.pi * k / n, size * (0.65 + 0.35 * math.sin(waves * 2 * math.pi * k / n))) for k in range(n))] for x, y, size, n, waves in ((76.1, 11.15, 1.3, 180, 5), (76.2, 11.1, 0.6, 120, 3)))
EDGES = ", ".join(f"({ring}, {ax}, {ay}, {bx}, {by})" for ring, points in enumerate((COAST, LAKE)) for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]))


@query("clip_coast", on_cube("""SELECT cell, sum(value) AS total FROM cube JOIN kept USING (cell) GROUP BY 1""", f""" edges(ring, px, py, qx, qy) AS (SELECT * FROM (VALUES {EDGES})),
meets AS (SELECT cell, ring, ((py > lat) <> (qy > lat)) AND lon < (qx - px) * (lat - py) / nullif(qy - py, 0) + px AS crossed,
  greatest(0, CASE WHEN qx = px THEN CASE WHEN abs(px - lon) <= 0.125 THEN 0 ELSE 2 END ELSE least((lon - 0.125 - px) / (qx - px), (lon + 0.125 - px) / (qx - px)) END,
    CASE WHEN qy = py THEN CASE WHEN abs(py - lat) <= 0.125 THEN 0 ELSE 2 END ELSE least((lat - 0.125 - py) / (qy - py), (lat + 0.125 - py) / (qy - py)) END)
  <= least(1, CASE WHEN qx = px THEN 1 ELSE greatest((lon - 0.125 - px) / (qx - px), (lon + 0.125 - px) / (qx - px)) END,
    CASE WHEN qy = py THEN 1 ELSE greatest((lat - 0.125 - py) / (qy - py), (lat + 0.125 - py) / (qy - py)) END) AS cut FROM cells, edges),
rings AS (SELECT cell, ring, count(*) FILTER (WHERE crossed) % 2 = 1 AS odd, bool_or(cut) AS cut FROM meets GROUP BY 1, 2),
kept AS (SELECT cell FROM rings GROUP BY 1 HAVING bool_or(ring = 0 AND (odd OR cut)) AND NOT bool_or(ring = 1 AND odd AND NOT cut))"""))
def clip_coast(spark, d):
    return C.clip(cube(spark, d), [[COAST, LAKE]], 0.25, 0.25, cells(spark, d)).groupBy("cell").agg(F.sum("value").alias("total"))


#: The cube with gaps: some values of cells 0 to 29 are missing, cells whose number ends in 4 are dry throughout.
GAPS = " gaps AS (SELECT time, cell, \"row\", col, lat, lon, CASE WHEN cell < 30 AND (cell * 31 + date_diff('day', DATE '1970-01-01', time)) % 97 = 0 THEN NULL WHEN cell % 10 = 4 THEN 0 WHEN cell = 37 AND time > (SELECT min(time) FROM cube) THEN NULL ELSE value END AS value FROM cube)"


def gaps(spark, d: str) -> DataFrame:
    c, day = cube(spark, d), F.datediff("time", F.lit("1970-01-01").cast("date"))
    first = F.min("time").over(Window.partitionBy("cell"))
    gone = ((F.col("cell") < 30) & ((F.col("cell") * 31 + day) % 97 == 0)) | ((F.col("cell") == 37) & (F.col("time") > first))
    return c.withColumn("value", F.when(gone, None).when(F.col("cell") % 10 == 4, 0.0).otherwise(F.col("value")))


@query("whole_cells", on_cube("SELECT cell, sum(value) AS total FROM gaps GROUP BY 1 HAVING count(value) = count(*)", GAPS))
def whole_cells(spark, d):
    return C.whole_cells(gaps(spark, d)).groupBy("cell").agg(F.sum("value").alias("total"))


@query("valid_cells", on_cube("SELECT 'read' AS step, count(DISTINCT cell) FILTER (WHERE value IS NOT NULL) AS valid_cells FROM g2 UNION ALL SELECT 'clipped', count(DISTINCT cell) FILTER (WHERE value IS NOT NULL) FROM g2 WHERE NOT " + apart(TRIANGLE), GAPS + ", g2 AS (SELECT cell, lat, lon, CASE WHEN cell % 9 = 5 THEN NULL ELSE value END AS value FROM gaps)"))
def valid_cells(spark, d):
    g = gaps(spark, d).withColumn("value", F.when(F.col("cell") % 9 != 5, F.col("value")))
    one = lambda step, df: C.valid_cells(df).select(F.lit(step).alias("step"), "valid_cells")
    return one("read", g).unionByName(one("clipped", C.clip(g, [TRIANGLE], 0.25, 0.25)))


@query("roi_cells", on_cube("SELECT cell, count(value) AS n, round(stddev_pop(value), 6) AS sd FROM gaps GROUP BY 1 HAVING count(value) >= 2 AND stddev_pop(value) > 0", GAPS))
def roi_cells(spark, d):
    return C.roi(gaps(spark, d), 2).select("cell", "n", *r6("sd"))


@query("wet_and_scaled", on_cube("SELECT cell, round(sum(CASE WHEN value * 4e-9 * 1000 >= 0.0001 THEN value * 4e-9 * 1000 ELSE 0 END), 6) AS total, count(*) FILTER (WHERE value > 0 AND value * 4e-9 * 1000 < 0.0001) AS cut FROM cube GROUP BY 1"))
def wet_and_scaled(spark, d):
    v = C.scaled(F.col("value") * 4e-9, "m")
    return cube(spark, d).groupBy("cell").agg(F.round(F.sum(C.wet(v)), 6).alias("total"), F.count_if((v > 0) & (C.wet(v) == 0)).alias("cut"))


WINDOWS = f"""
 pos AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS total FROM days),
 wins AS (SELECT pos.*, w.win, pos - w.win * {STEP} AS rel FROM pos, (SELECT unnest(generate_series(0, (SELECT (count(*) - {SIZE}) // {STEP} FROM days))) AS win) w WHERE pos BETWEEN w.win * {STEP} AND w.win * {STEP} + {SIZE} - 1)"""


@query("row_windows", on_cube(f"SELECT win, count(*) AS n, CAST(max(CASE WHEN rel = {SIZE} // 2 THEN time END) AS VARCHAR) AS time, strftime(min(time), '%Y-%m') || ' – ' || strftime(max(time), '%Y-%m') AS label FROM wins GROUP BY 1", WINDOWS))
def row_windows(spark, d):
    w = W.row_windows(W.positions(cube(spark, d)), SIZE, STEP)
    return W.midpoints(w, SIZE).join(w.groupBy("win").agg(F.count("*").alias("n")), "win").select("win", "n", F.col("time").cast("string").alias("time"), "label")


DAILY = " daily AS (SELECT time, avg(value) AS mean, median(value) AS med, avg(CAST(value <= 0 AS DOUBLE)) AS dry_node_fraction, CAST(bool_and(value <= 0) AS DOUBLE) AS dry_day FROM cube GROUP BY 1)"


@query("dry_stats", on_cube("SELECT CAST(time AS VARCHAR) AS time, round(mean, 6) AS mean, round(med, 6) AS median, round(dry_node_fraction, 6) AS dry_node_fraction, dry_day FROM daily", DAILY))
def dry_stats(spark, d):
    return W.daily(cube(spark, d), []).select(F.col("time").cast("string").alias("time"), *r6("mean", "median", "dry_node_fraction"), "dry_day")


@query("rain_rolling", on_cube(f"SELECT win, CAST(max(CASE WHEN rel = {SIZE} // 2 THEN time END) AS VARCHAR) AS time, round(quantile_cont(mean, 0.5), 6) AS rain, round(avg(dry_day), 6) AS dry_fraction, round(avg(dry_node_fraction), 6) AS dry_node_fraction FROM wins JOIN daily USING (time) GROUP BY 1", WINDOWS + "," + DAILY))
def rain_rolling(spark, d):
    return W.rain_rolling(W.daily(cube(spark, d), []), SIZE, STEP).select("win", F.col("time").cast("string").alias("time"), *r6("rain", "dry_fraction", "dry_node_fraction"))


@query("smooth_band", on_cube("SELECT CAST(time AS VARCHAR) AS time, round(quantile_cont(mean, 0.5) OVER w, 6) AS mean_med, round(quantile_cont(mean, 0.025) OVER w, 6) AS mean_low, round(quantile_cont(mean, 0.975) OVER w, 6) AS mean_high FROM daily WINDOW w AS (ORDER BY date_diff('day', DATE '1970-01-01', time) RANGE BETWEEN 29 PRECEDING AND 30 FOLLOWING)", DAILY))
def smooth_band(spark, d):
    return W.smooth(W.daily(cube(spark, d), []), "mean", 60).select(F.col("time").cast("string").alias("time"), *r6("mean_med", "mean_low", "mean_high"))


@query("highest_median", on_cube("SELECT cell % 4 AS k, round(max(med), 6) AS highest FROM (SELECT cell % 4 AS cell, time, median(value) AS med FROM cube GROUP BY 1, 2) GROUP BY 1"))
def highest_median(spark, d):
    return W.highest_median(W.daily(cube(spark, d).withColumn("k", F.col("cell") % 4), ["k"]), ["k"]).select("k", *r6("highest"))


@query("padded_limits", on_cube("SELECT m AS metric, round(lo - 0.1 * (hi - lo), 6) AS low, round(hi + 0.1 * (hi - lo), 6) AS high FROM (SELECT 'mean' AS m, least(min(mean), min(b)) AS lo, greatest(max(mean), max(b)) AS hi FROM x UNION ALL SELECT 'dry_node_fraction', min(dry_node_fraction), max(dry_node_fraction) FROM x) UNION ALL SELECT 'none', 0, 1", DAILY + ", x AS (SELECT mean, mean + 1 AS b, dry_node_fraction FROM daily)"))
def padded_limits(spark, d):
    x = W.daily(cube(spark, d), []).withColumns({"mean_high": F.col("mean") + 1, "none": F.lit(float("nan"))})
    return W.padded_limits(x, ["mean", "dry_node_fraction", "none"]).select("metric", *r6("low", "high"))


@query("window_selection", on_cube("SELECT win, win < 4 AS first, win % 3 = 0 AS nth FROM (SELECT DISTINCT win FROM wins) WHERE win < 4 OR win % 3 = 0", WINDOWS))
def window_selection(spark, d):
    w = W.row_windows(W.positions(cube(spark, d)), SIZE, STEP).select("win").distinct()
    first, nth = W.first_k(F.col("win"), 4), W.every_nth(F.col("win"), 3)
    return w.where(first | nth).select("win", first.alias("first"), nth.alias("nth"))


@query("overlapping_windows", on_cube("SELECT w AS win, count(*) AS n, CAST(min(time) AS VARCHAR) AS first FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM days), (SELECT unnest(generate_series(0, ((SELECT count(*) FROM days) - 365) // 274)) AS w) WHERE pos BETWEEN w * 274 AND w * 274 + 364 GROUP BY 1"))
def overlapping_windows(spark, d):
    w = W.row_windows(W.positions(cube(spark, d)), 365, W.step_of(365, 0.25))
    return w.groupBy("win").agg(F.count("*").alias("n"), F.min("time").cast("string").alias("first"))


@query("annual_resample", on_cube("SELECT year(time) AS year, round(avg(dry_node_fraction), 6) AS dry_node_fraction, sum(dry_day) AS dry_days FROM daily GROUP BY 1", DAILY))
def annual_resample(spark, d):
    return W.by_year(W.daily(cube(spark, d), [])).select(*long("year"), *r6("dry_node_fraction"), "dry_days")


@query("period_expand", on_cube("SELECT p.a || '-' || p.b AS period, cell, count(*) AS n, sum(value) AS total FROM cube, (VALUES (1995, 1997), (1998, 2000)) p(a, b) WHERE year(time) BETWEEN p.a AND p.b GROUP BY 1, 2"))
def period_expand(spark, d):
    return W.by_period(cube(spark, d), W.period_chunks(1995, 2001, 3, 2)).groupBy("period", "cell").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# Recurrence of the state series, in windows of STATE rows.


def state(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("time"), "embedding")
    return W.row_windows(W.positions(e), STATE, STATE_STEP).join(e, "time").select("win", F.col("rel").cast("int").alias("i"), F.col("embedding").alias("x"))


def rec(spark, d: str, cosine: bool = True) -> DataFrame:
    return R.recurrences(state(spark, d), Q, THEILER, cosine)


def rqa(spark, d: str, cosine: bool = True) -> DataFrame:
    return R.histogram_metrics(R.line_histograms(state(spark, d), Q, THEILER, cosine), STATE)


VECTORS = f"""
v0 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1e-6) AS e, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v1 AS (SELECT *, sqrt(list_sum(list_transform(e, lambda z: z * z))) AS n FROM v0),
v AS (SELECT pos, x, list_transform(e, lambda z: z / n) AS u FROM v1),
st AS (SELECT w.win, pos - w.win * {STATE_STEP} AS i, x, u FROM v, (SELECT unnest(generate_series(0, (SELECT (count(*) - {STATE}) // {STATE_STEP} FROM embeddings))) AS win) w WHERE pos BETWEEN w.win * {STATE_STEP} AND w.win * {STATE_STEP} + {STATE} - 1),
pairs AS (SELECT a.win, a.i, b.i AS j, round(least(greatest(1 - list_dot_product(a.u, b.u), 0), 2), 9) AS d, round(list_distance(a.x, b.x), 9) AS de FROM st a JOIN st b ON a.win = b.win WHERE abs(a.i - b.i) > {THEILER}),
eps AS (SELECT win, quantile_cont(d, {Q}) AS eps, quantile_cont(de, {Q}) AS epse FROM pairs GROUP BY 1)"""


def lines(metric: str = "p.d <= e.eps") -> str:
    return f"""WITH {VECTORS},
rec AS (SELECT p.win, p.i, p.j FROM pairs p JOIN eps e USING (win) WHERE {metric}),
c AS (SELECT win, 'diag' AS kind, j - i AS line, i AS place FROM rec UNION ALL SELECT win, 'vert', j, i FROM rec),
g AS (SELECT *, place - row_number() OVER (PARTITION BY win, kind, line ORDER BY place) AS g FROM c),
runs AS (SELECT win, kind, count(*) AS len FROM g GROUP BY win, kind, line, g),
h AS (SELECT win, kind, len, count(*) AS n FROM runs GROUP BY ALL),
p AS (SELECT *, n * 1.0 / sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n END) OVER (PARTITION BY win) AS p FROM h)
"""


METRICS = f"""SELECT win,
 round(coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n * len END), 0) / (coalesce(sum(CASE WHEN kind = 'diag' THEN n * len END), 0) + 1e-8), 6) AS det,
 round(coalesce(sum(CASE WHEN kind = 'vert' AND len >= 2 THEN n * len END), 0) / (coalesce(sum(CASE WHEN kind = 'vert' THEN n * len END), 0) + 1e-8), 6) AS lam,
 round(coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN -p * ln(p + 1e-8) END), 0) / ln({STATE} - 1), 6) AS entr,
 round(coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n * len END) / sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n END), 0), 6) AS lmean,
 round(coalesce(1 / (max(CASE WHEN kind = 'diag' AND len >= 2 THEN len END) + 1e-8), 0), 6) AS div,
 round(sum(CASE WHEN kind = 'diag' THEN n * len END) / CAST({STATE} * {STATE} AS DOUBLE), 6) AS rr
FROM p GROUP BY 1"""


@query("rolling_rqa", lines() + METRICS)
def rolling_rqa(spark, d):
    return rqa(spark, d).select("win", *r6("det", "lam", "entr", "lmean", "div", "rr"))


@query("euclid_rqa", lines("p.de <= e.epse") + METRICS)
def euclid_rqa(spark, d):
    return rqa(spark, d, False).select("win", *r6("det", "lam", "entr", "lmean", "div", "rr"))


@query("det_lam_ratio", f"SELECT win, round(det / (lam + 1e-8), 4) AS det_lam FROM ({lines() + METRICS})")
def det_lam_ratio(spark, d):
    m = rqa(spark, d).select("win", *r6("det", "lam"))
    return m.select("win", F.round(F.col("det") / (F.col("lam") + 1e-8), 4).alias("det_lam"))


@query("recurrence_eps", f"WITH {VECTORS} SELECT win, round(eps, 8) AS eps FROM eps")
def recurrence_eps(spark, d):
    return R.epsilons(state(spark, d), Q, THEILER).select("win", F.round("eps", 8).alias("eps"))


@query("diag_hist", lines() + "SELECT win, len, n FROM h WHERE kind = 'diag' AND len >= 2 AND win % 3 = 0")
def diag_hist(spark, d):
    return R.diagonal_histogram(rec(spark, d)).where(W.every_nth(F.col("win"), 3)).select("win", *long("len", "n"))


@query("theiler_curve", f"WITH {VECTORS}, l AS (SELECT b.pos - a.pos AS dt, round(least(greatest(1 - list_dot_product(a.u, b.u), 0), 2), 9) AS d FROM v a JOIN v b ON b.pos - a.pos BETWEEN 1 AND 30) SELECT dt, " + ", ".join(f"round(quantile_cont(d, {p / 100}), 6) AS p{p}" for p in (1, 10, 50, 90, 99)) + " FROM l WHERE d > 1e-5 GROUP BY 1")
def theiler_curve(spark, d):
    e = series(spark, d)
    return R.lag_percentiles(e, 30).select(*long("dt"), *r6("p1", "p10", "p50", "p90", "p99"))


def series(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("time"), F.col("embedding").alias("x"))
    return W.positions(e).join(e, "time").select(F.col("pos").cast("int").alias("i"), "x")


@query("theiler_window")
def theiler_window(spark, d):
    return R.theiler_windows(R.lag_percentiles(series(spark, d), 60).withColumn("community", F.lit(1)), ["community"])


@query("surrogate_rank_test")
def surrogate_rank_test(spark, d):
    s = state(spark, d)
    got = R.histogram_metrics(R.line_histograms(s, Q, THEILER), STATE)
    metrics = ["det", "lam", "entr", "lmean"]
    got, surr = hold(R.nulled(got, metrics)), hold(R.surrogates(s, 99, Q, THEILER))
    tests = [R.rank_test(got.where(F.col(m).isNotNull()), surr, m, ["win"]).select("win", F.lit(m).alias("metric"), F.col(m).alias("value"), "low", "high", "p", "significant") for m in metrics]
    return functools.reduce(DataFrame.unionByName, tests)


# Trends of the cells' yearly totals.

YEARLY = " yearly AS (SELECT cell, year(time) AS y, sum(value) AS v FROM cube GROUP BY 1, 2), ys AS (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY y) - 1 AS i FROM yearly)"


def yearly(spark, d: str) -> DataFrame:
    y = cube(spark, d).groupBy("cell", F.year("time").alias("y")).agg(F.sum("value").alias("v"))
    return y.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("y")) - 1)


@query("mk_pieces", on_cube("""SELECT cell, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, round((n * (n - 1) * (2 * n + 5) - ties) / 18.0, 6) AS var_s, round(slope, 6) AS slope, round(med - (n - 1) / 2.0 * slope, 6) AS intercept
 FROM (SELECT a.cell, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM ys a JOIN ys b ON a.cell = b.cell AND a.i < b.i GROUP BY 1)
 JOIN (SELECT cell, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT cell, v, count(*) AS t FROM ys GROUP BY 1, 2) GROUP BY 1) USING (cell)
 JOIN (SELECT cell, median(v) AS med FROM ys GROUP BY 1) USING (cell)""", YEARLY))
def mk_pieces(spark, d):
    return T.pieces(yearly(spark, d), ["cell"]).select("cell", *long("n", "s"), *r6("var_s", "slope", "intercept"))


def trend_sql(series: str, keys: str, periods) -> str:
    """CTEs up to mk(keys, period, n, slope, slope_rel_pct, slope_z, intercept, p) for a CTE `series` of (keys, y, v)."""
    spans = " ".join(f"UNION ALL SELECT '{a}-{b}', * FROM {series} WHERE y >= {a} AND y < {b}" for a, b in periods)
    k = f"{keys}, period"
    return f""" per AS (SELECT 'full' AS period, * FROM {series} {spans}),
 ps AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY y) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM per),
 pr AS (SELECT {k}, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM ps a JOIN ps b USING ({k}) WHERE a.i < b.i GROUP BY ALL),
 ti AS (SELECT {k}, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT {k}, v, count(*) AS t FROM ps GROUP BY ALL) GROUP BY ALL),
 md AS (SELECT {k}, median(v) AS med FROM ps GROUP BY ALL),
 wh AS (SELECT {keys}, avg(v) AS m, stddev_samp(v) AS sd FROM {series} GROUP BY ALL),
 dt AS (SELECT {k}, i, n, round(v - slope * i, 12) AS r FROM ps JOIN pr USING ({k})),
 rk AS (SELECT {k}, i, n, rank() OVER (PARTITION BY {k} ORDER BY r) + (count(*) OVER (PARTITION BY {k}, r) - 1) / 2.0 - (n + 1) / 2.0 AS c FROM dt),
 c0 AS (SELECT {k}, sum(c * c) AS c0 FROM rk GROUP BY ALL),
 ac AS (SELECT {k}, a.n, b.i - a.i AS lag, sum(a.c * b.c) AS g FROM rk a JOIN rk b USING ({k}) WHERE b.i > a.i GROUP BY ALL),
 co AS (SELECT {k}, sum(CASE WHEN abs(g / c0) > 1.959963984540054 / sqrt(n) THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * g / c0 ELSE 0 END) AS x FROM ac JOIN c0 USING ({k}) WHERE c0 > 0 GROUP BY ALL),
 vr AS (SELECT {k}, ti.n, s, slope, med, m, sd, CASE WHEN ti.n >= 3 AND c0 > 0 THEN (ti.n * (ti.n - 1) * (2 * ti.n + 5) - ties) / 18.0 * (1 + 2 / CAST(ti.n * (ti.n - 1) * (ti.n - 2) AS DOUBLE) * x) END AS var
   FROM ti JOIN md USING ({k}) JOIN wh USING ({keys}) LEFT JOIN pr USING ({k}) LEFT JOIN co USING ({k}) LEFT JOIN c0 USING ({k})),
 zz AS (SELECT *, CASE WHEN var > 0 THEN abs(s - sign(s)) / sqrt(var) END AS z FROM vr),
 mk AS (SELECT {k}, n, s, slope, 100 * slope / nullif(m, 0) AS slope_rel_pct, slope / nullif(sd, 0) AS slope_z, med - (n - 1) / 2.0 * slope AS intercept,
   1 - sqrt(2 / pi()) * z / 1200 * list_sum(list_transform(range(0, 401), lambda k: (CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (z * k / 400) * (z * k / 400)))) AS p FROM zz)"""


TREND = "CASE WHEN n < 2 THEN NULL WHEN p < 0.05 THEN CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'no trend' END AS trend, coalesce(p < 0.05, false) AS significant"


@query("mk_trend", on_cube(f"SELECT cell, period, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(slope_rel_pct, 6) AS slope_rel_pct, round(slope_z, 6) AS slope_z, round(intercept, 6) AS intercept, round(p, 5) AS p, {TREND} FROM mk", YEARLY + "," + trend_sql("yearly", "cell", [(1993, 1997), (1994, 1999), (2001, 2004)])))
def mk_trend(spark, d):
    y = yearly(spark, d).withColumn("time", F.make_date("y", F.lit(7), F.lit(1)))
    got = T.trend_table(y.select("cell", "time", "v"), ["cell"], [(1993, 1997), (1994, 1999), (2001, 2004)])
    return got.select("cell", "period", *long("n"), *r6("slope", "slope_rel_pct", "slope_z", "intercept"), F.round("p", 5).alias("p"), "trend", F.coalesce("significant", F.lit(False)).alias("significant"))


@query("neg_log_p", on_cube("SELECT cell, round(-log10(greatest(total / 1e6, 1e-10)), 6) AS neg_log_p, total / 1e6 < 0.05 AS significant FROM (SELECT cell, sum(value) AS total FROM cube GROUP BY 1)"))
def neg_log_p(spark, d):
    t = cube(spark, d).groupBy("cell").agg((F.sum("value") / 1e6).alias("p")).withColumns({"slope": F.lit(1.0), "period": F.lit("full"), "metric": F.lit("RAIN")})
    return tables.dot_plot_rows(t, ["full"], ["RAIN"]).select("cell", *r6("neg_log_p"), "significant")


# Spectra of the cells' monthly totals.

MONTHLY = " m0 AS (SELECT cell, date_trunc('month', time) AS m, sum(value) AS v FROM cube GROUP BY 1, 2), m AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n, v - avg(v) OVER (PARTITION BY cell) AS v FROM m0), f AS (SELECT unnest(generate_series(0, (SELECT max(n) // 2 FROM m))) AS f), cs AS (SELECT cell, f, n, sum(v * cos(2 * pi() / n * ((f * i) % n))) AS c, sum(v * sin(2 * pi() / n * ((f * i) % n))) AS s FROM m, f WHERE f <= n // 2 GROUP BY ALL), p0 AS (SELECT cell, f, n, (c * c + s * s) / n * CASE WHEN f > 0 AND f < n // 2 THEN 2 ELSE 1 END AS p FROM cs), sp AS (SELECT cell, f, n, p / CASE WHEN max(p) OVER (PARTITION BY cell) = 0 THEN 1 ELSE max(p) OVER (PARTITION BY cell) END AS p FROM p0)"
BANDS = " q0 AS (SELECT cell, f, n, round(p, 9) AS p FROM sp), pk AS (SELECT cell, max(p) AS top, min(f) FILTER (WHERE p = 1.0) AS peak FROM q0 GROUP BY 1), bd AS (SELECT q0.*, top, peak, p < top / 2 OR f IN (0, n // 2) AS low FROM q0 JOIN pk USING (cell)), lr AS (SELECT cell, any_value(peak) AS peak, coalesce(max(f) FILTER (WHERE low AND f < peak) + 1, any_value(peak)) AS l, coalesce(min(f) FILTER (WHERE low AND f > peak) - 1, any_value(peak)) AS r FROM bd GROUP BY 1), sc AS (SELECT cell, lr.peak, l, r, sum(p) FILTER (WHERE f BETWEEN l AND r) / sum(p) AS sc FROM q0 JOIN lr USING (cell) GROUP BY ALL)"


def spectra(spark, d: str) -> DataFrame:
    m = cube(spark, d).groupBy("cell", F.trunc("time", "month").alias("m")).agg(F.sum("value").alias("v"))
    i = F.row_number().over(Window.partitionBy("cell").orderBy("m")) - 1
    return S.power(m.withColumns({"i": i, "v": F.col("v") - F.avg("v").over(Window.partitionBy("cell"))}), ["cell"])


@query("power_spectrum", on_cube("SELECT cell, f, round(p, 6) AS p FROM sp", MONTHLY))
def power_spectrum(spark, d):
    return spectra(spark, d).select("cell", *long("f"), *r6("p"))


@query("spectral_concentration", on_cube("SELECT cell, peak, l AS \"left\", r AS \"right\", round(sc, 6) AS sc FROM sc", MONTHLY + "," + BANDS))
def spectral_concentration(spark, d):
    return S.concentration(spectra(spark, d), ["cell"]).select("cell", *long("peak", "left", "right"), *r6("sc"))


@query("sc_curve", on_cube("SELECT t, (SELECT count(*) FROM r WHERE r.t > x.t) AS n, round((SELECT count(*) FROM r WHERE r.t > x.t) / (SELECT CAST(count(*) AS DOUBLE) FROM r), 6) AS fraction FROM (SELECT DISTINCT t FROM r UNION ALL SELECT 1.0) x", MONTHLY + "," + BANDS + ", r AS (SELECT round(sc, 3) AS t FROM sc)"))
def sc_curve(spark, d):
    sc = S.concentration(spectra(spark, d), ["cell"]).select(F.round("sc", 3).alias("sc"))
    return S.threshold_curve(sc).select("t", *long("n"), *r6("fraction"))


LOADINGS = " ld0 AS (SELECT cell, month(time) AS pc, avg(value) AS a FROM cube GROUP BY 1, 2), ld AS (SELECT cell, pc, a - avg(a) OVER (PARTITION BY pc) AS a FROM ld0), rl AS (SELECT DISTINCT cell FROM (SELECT cell, abs(a) AS a, stddev_pop(abs(a)) OVER (PARTITION BY pc) AS sd FROM ld WHERE pc <= 4) WHERE a > 3 * sd)"


def month_loadings(spark, d: str) -> DataFrame:
    load = cube(spark, d).groupBy("cell", F.month("time").alias("pc")).agg(F.avg("value").alias("a"))
    return load.withColumns({"a": F.col("a") - F.avg("a").over(Window.partitionBy("pc")), "k": F.lit(0)}).where("pc <= 4")


@query("relevant_cells", on_cube("SELECT cell FROM rl", LOADINGS))
def relevant_cells(spark, d):
    return S.relevant(month_loadings(spark, d), ["k"]).select("cell")


@query("loading_communities", on_cube("SELECT cell, comp FROM (SELECT cell, min(other) AS comp, count(*) AS size FROM lr GROUP BY 1) WHERE size >= 2", LOADINGS + ", rc AS (SELECT cell, \"row\", col FROM rl JOIN cells USING (cell)), lr AS (SELECT cell, cell AS other FROM rc UNION SELECT lr.cell, b.cell FROM lr JOIN rc a ON a.cell = lr.other JOIN rc b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1)"))
def loading_communities(spark, d):
    return G.components(placed(S.relevant(month_loadings(spark, d), ["k"])), ["k"]).select("cell", "comp")


# Graphs: in each year, the cells whose total is above 1.03 times the year's mean.

ACTIVE = YEARLY + ", act AS (SELECT y AS win, yearly.cell, \"row\", col FROM (SELECT *, avg(v) OVER (PARTITION BY y) AS m FROM yearly) yearly JOIN cells USING (cell) WHERE v > 1.03 * m), nb AS (SELECT a.win, a.cell, b.cell AS other FROM act a JOIN act b ON a.win = b.win AND abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 AND a.cell <> b.cell)"
COMP = ACTIVE + ", reach AS (SELECT win, cell, cell AS other FROM act UNION SELECT r.win, r.cell, n.other FROM reach r JOIN nb n ON r.win = n.win AND r.other = n.cell), comp AS (SELECT * FROM (SELECT win, cell, min(other) AS comp, count(*) AS size FROM reach GROUP BY 1, 2) WHERE size >= 2), sz AS (SELECT win, comp, count(*) AS size FROM comp GROUP BY 1, 2)"


def active(spark, d: str) -> DataFrame:
    y = yearly(spark, d).withColumn("m", F.avg("v").over(Window.partitionBy("y"))).where(F.col("v") > 1.03 * F.col("m"))
    return placed(y.select(F.col("y").alias("win"), "cell"))


def parts(spark, d: str, tile: int | None = None) -> DataFrame:
    return G.components(active(spark, d), ["win"], tile=tile)


@query("neighbours_queen", on_cube("SELECT win, cell, other FROM nb", ACTIVE))
def neighbours_queen(spark, d):
    return G.neighbours(active(spark, d), ["win"]).select(*long("win"), "cell", "other")


@query("neighbours_rook", on_cube("SELECT a.win, a.cell, b.cell AS other FROM act a JOIN act b ON a.win = b.win AND abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) = 1", ACTIVE))
def neighbours_rook(spark, d):
    return G.neighbours(active(spark, d), ["win"], G.ROOK).select(*long("win"), "cell", "other")


@query("components", on_cube("SELECT win, cell, comp FROM comp", COMP))
def components(spark, d):
    return parts(spark, d).select(*long("win"), "cell", "comp")


@query("components_tiled", on_cube("SELECT win, cell, comp FROM comp", COMP))
def components_tiled(spark, d):
    return parts(spark, d, 3).select(*long("win"), "cell", "comp")


@query("component_sizes", on_cube("SELECT win, comp, size FROM sz", COMP))
def component_sizes(spark, d):
    return G.sizes(parts(spark, d), ["win"]).select(*long("win"), "comp", "size")


@query("size_figures", on_cube("SELECT count(*) AS total, count(*) FILTER (WHERE size = 2) AS pairs, count(*) FILTER (WHERE size >= 10) AS large, CAST(median(size) AS DOUBLE) AS median, max(size) AS largest FROM sz", COMP))
def size_figures(spark, d):
    return G.size_figures(G.sizes(parts(spark, d), ["win"]))


@query("size_ccdf", on_cube("SELECT s, round((SELECT count(*) FROM sz WHERE size >= s) / (SELECT CAST(count(*) AS DOUBLE) FROM sz), 6) AS fraction FROM (SELECT unnest(generate_series(3, (SELECT max(size) FROM sz))) AS s)", COMP))
def size_ccdf(spark, d):
    return G.size_ccdf(G.sizes(parts(spark, d), ["win"])).select("s", *r6("fraction"))


@query("heatmap_fraction", on_cube("SELECT cells.cell, n, round(n / (SELECT CAST(count(DISTINCT win) AS DOUBLE) FROM act), 6) AS fraction FROM cells LEFT JOIN (SELECT cell, count(DISTINCT win) AS n FROM comp JOIN sz USING (win, comp) WHERE sz.size >= 3 GROUP BY 1) USING (cell)", COMP))
def heatmap_fraction(spark, d):
    return G.heatmap(parts(spark, d), cells(spark, d), active(spark, d), 3).select("cell", "n", *r6("fraction"))


@query("heatmap_export", on_cube("SELECT lat, lon, round(n / (SELECT CAST(count(DISTINCT win) AS DOUBLE) FROM act), 6) AS rec_frac FROM cells JOIN (SELECT cell, count(DISTINCT win) AS n FROM comp GROUP BY 1) USING (cell)", COMP))
def heatmap_export(spark, d):
    h = G.heatmap(parts(spark, d), cells(spark, d), active(spark, d)).join(cells(spark, d), "cell").withColumn("rec_frac", F.col("fraction"))
    return tables.heatmap_rows(h).select("lat", "lon", *r6("rec_frac"))


# Labels: quadrants of the grid, a diagonal band without label.

QUAD = " lab AS (SELECT cell, \"row\", col, lat, lon, CAST((\"row\" >= 5) AS BIGINT) * 2 + CAST((col >= 5) AS BIGINT) AS label, (\"row\" * 7 + col * 3) % 5 AS rough FROM cells), tot AS (SELECT cell, sum(value) AS z FROM cube GROUP BY 1)"


def quadrants(spark, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.withColumns({"label": (F.col("row") >= 5).cast("long") * 2 + (F.col("col") >= 5).cast("long"), "rough": ((F.col("row") * 7 + F.col("col") * 3) % 5).cast("long")})


@query("q_statistic", on_cube("SELECT n, round(sst, 4) AS sst, round(ssw, 4) AS ssw, round(q, 6) AS q, round(f, 5) AS f, round((sst - ssw) / (2 * ssw / (n - 4)), 5) AS lam, round(exp(lgamma(a + b) - lgamma(a) - lgamma(b)) * x / 12000 * list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * (x * k / 4000) ** (a - 1) * (1 - x * k / 4000) ** (b - 1))), 5) AS p FROM (SELECT *, (n - 4) / 2.0 AS a, 1.5 AS b, (n - 4) / (n - 4 + 3 * f) AS x FROM (SELECT *, 1 - ssw / sst AS q, (n - 4) / 3.0 * (1 - ssw / sst) / (ssw / sst) AS f FROM (SELECT count(*) AS n, var_pop(z) * count(*) AS sst FROM tot), (SELECT sum(w) AS ssw FROM (SELECT label, var_pop(z) * count(*) AS w FROM lab JOIN tot USING (cell) GROUP BY 1))))", QUAD))
def q_statistic(spark, d):
    z = cube(spark, d).groupBy("cell").agg(F.sum("value").alias("z")).join(quadrants(spark, d), "cell")
    return G.q_statistic(z, []).select("n", F.round("sst", 4).alias("sst"), F.round("ssw", 4).alias("ssw"), *r6("q"), *[F.round(c, 5).alias(c) for c in ("f", "lam", "p")])


@query("nearest_fill", on_cube("SELECT cell, label FROM lab WHERE \"row\" <> col UNION ALL SELECT a.cell, arg_min(b.label, [(a.\"row\" - b.\"row\") ** 2 + (a.col - b.col) ** 2, b.\"row\", b.col]) FROM lab a, lab b WHERE a.\"row\" = a.col AND b.\"row\" <> b.col GROUP BY 1", QUAD))
def nearest_fill(spark, d):
    lab = quadrants(spark, d).withColumn("label", F.when(F.col("row") != F.col("col"), F.col("label")))
    return G.nearest_fill(lab.select("cell", "row", "col", "label")).select("cell", "label")


@query("majority_filter", on_cube("SELECT cell, arg_max(rough, [n, -rough]) AS label FROM (SELECT a.cell, b.rough, count(*) AS n FROM lab a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS x) x CROSS JOIN (SELECT unnest([-1, 0, 1]) AS y) y JOIN lab b ON b.\"row\" = least(greatest(a.\"row\" + x.x, 0), 9) AND b.col = least(greatest(a.col + y.y, 0), 9) GROUP BY 1, 2) GROUP BY 1", QUAD))
def majority_filter(spark, d):
    lab = quadrants(spark, d).select("cell", "row", "col", F.col("rough").alias("label"))
    return G.majority(lab).select("cell", "label")


SPLIT = QUAD + ", lb AS (SELECT cell, \"row\", col, lat, lon, CAST(CASE WHEN rough IN (0, 1) THEN 1 ELSE 0 END AS BIGINT) AS label FROM lab), rc AS (SELECT cell, cell AS other FROM lb UNION SELECT r.cell, b.cell FROM rc r JOIN lb a ON a.cell = r.other JOIN lb b ON b.label = a.label AND abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1), pt AS (SELECT cell, min(other) AS part0 FROM rc GROUP BY 1), sp AS (SELECT lb.*, dense_rank() OVER (ORDER BY label, part0) - 1 AS part FROM lb JOIN pt USING (cell))"


def rough_labels(spark, d: str) -> DataFrame:
    return quadrants(spark, d).withColumn("label", F.when(F.col("rough").isin(0, 1), 1).otherwise(0).cast("long"))


@query("split_components", on_cube("SELECT cell, label, part FROM sp", SPLIT))
def split_components(spark, d):
    return G.split_parts(rough_labels(spark, d)).select("cell", *long("label", "part"))


@query("merge_small", on_cube("SELECT cell, coalesce(m.root, rough) AS label FROM lab LEFT JOIN (SELECT label, min(other) AS root FROM r2 GROUP BY 1) m ON m.label = lab.rough", QUAD + ", sm AS (SELECT rough AS label FROM lab GROUP BY 1 HAVING count(*) < 21), ad AS (SELECT DISTINCT a.rough AS label, b.rough AS other FROM lab a JOIN lab b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 WHERE a.rough IN (SELECT label FROM sm) AND b.rough IN (SELECT label FROM sm)), r2 AS (SELECT label, label AS other FROM sm UNION SELECT r2.label, ad.other FROM r2 JOIN ad ON ad.label = r2.other)"))
def merge_small(spark, d):
    lab = quadrants(spark, d).select("cell", "row", "col", F.col("rough").alias("label"))
    return G.merge_small(lab, 21).select("cell", *long("label"))


@query("relabel_south", on_cube("SELECT cell, rough AS label, dense_rank() OVER (ORDER BY y, x, rough) - 1 AS rank FROM (SELECT *, round(avg(lat) OVER (PARTITION BY rough), 9) AS y, round(avg(lon) OVER (PARTITION BY rough), 9) AS x FROM lab)", QUAD))
def relabel_south(spark, d):
    return G.relabel(quadrants(spark, d).withColumn("label", F.col("rough"))).select("cell", *long("label", "rank"))


@query("relabel_north", on_cube("SELECT cell, label, dense_rank() OVER (ORDER BY top DESC, west, label) - 1 AS rank FROM (SELECT *, max(lat) OVER (PARTITION BY label) AS top, min(lon) OVER (PARTITION BY label) AS west FROM lab)", QUAD))
def relabel_north(spark, d):
    return G.relabel(quadrants(spark, d), "north").select("cell", *long("label", "rank"))


@query("cell_polygons", on_cube("SELECT cell, label AS community, 'POLYGON ((' || printf('%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f', lon - 0.125, lat - 0.125, lon + 0.125, lat - 0.125, lon + 0.125, lat + 0.125, lon - 0.125, lat + 0.125, lon - 0.125, lat - 0.125) || '))' AS geometry FROM lab", QUAD))
def cell_polygons(spark, d):
    return quadrants(spark, d).select("cell", F.col("label").alias("community"), tables.cell_wkt(F.col("lat"), F.col("lon"), F.lit(0.25), F.lit(0.25)).alias("geometry"))


@query("community_outlines", on_cube("SELECT label AS community, count(*) AS cells, CAST(1 AS INTEGER) AS rings, round(count(*) * 0.0625, 6) AS area, 'MULTIPOLYGON (((' || printf('%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f', min(lon) - 0.125, min(lat) - 0.125, max(lon) + 0.125, min(lat) - 0.125, max(lon) + 0.125, max(lat) + 0.125, min(lon) - 0.125, max(lat) + 0.125, min(lon) - 0.125, min(lat) - 0.125) || ')))' AS geometry FROM lab GROUP BY 1", QUAD))
def community_outlines(spark, d):
    got = G.outlines(quadrants(spark, d).withColumn("community", F.col("label")), 0.25, 0.25, 10.0, 75.0)
    return got.select("community", "cells", "rings", *r6("area"), "geometry")


@query("mask_selection", on_cube("SELECT label AS community, CAST(time AS VARCHAR) AS time, round(avg(value), 6) AS mean FROM cube JOIN lab USING (cell) GROUP BY 1, 2", QUAD))
def mask_selection(spark, d):
    mask = G.masks_from_points(quadrants(spark, d).select(F.col("label").alias("id"), "lat", "lon"), cells(spark, d))
    return W.daily(cube(spark, d).join(mask, "cell"), ["community"]).select("community", F.col("time").cast("string").alias("time"), *r6("mean"))


@query("bilinear_grid", on_cube("SELECT y, x, round(sum(w * z) / sum(w), 6) AS value FROM (SELECT y, x, z, (1 - abs(y / 2.0 - \"row\")) * (1 - abs(x / 2.0 - col)) AS w FROM (SELECT unnest(generate_series(0, 18)) AS y) CROSS JOIN (SELECT unnest(generate_series(0, 18)) AS x) CROSS JOIN lab JOIN tot USING (cell) WHERE abs(y / 2.0 - \"row\") < 1 AND abs(x / 2.0 - col) < 1) GROUP BY 1, 2", QUAD))
def bilinear_grid(spark, d):
    z = cube(spark, d).groupBy("cell").agg(F.sum("value").alias("value"))
    return G.bilinear(placed(z).select("row", "col", "value")).select(*long("y", "x"), *r6("value"))


#: Some cells are missing: single ones, two side by side, one on the border, a corner.
MISSING = [22, 25, 47, 48, 74, 93, 99]
TRIANGLES = f""" h AS (SELECT "row" AS r, col AS c, sum(value) AS z FROM cube WHERE cell NOT IN ({", ".join(map(str, MISSING))}) GROUP BY 1, 2),
g AS (SELECT r.range AS r, c.range AS c FROM range(10) r, range(10) c),
sq AS (SELECT g.r, g.c, a.z AS a, b.z AS b, e.z AS e, f.z AS f FROM g LEFT JOIN h a ON a.r = g.r AND a.c = g.c LEFT JOIN h b ON b.r = g.r AND b.c = g.c + 1 LEFT JOIN h e ON e.r = g.r + 1 AND e.c = g.c LEFT JOIN h f ON f.r = g.r + 1 AND f.c = g.c + 1 WHERE g.r < 9 AND g.c < 9),
tri(y1, x1, z1, y2, x2, z2, y3, x3, z3) AS (
  SELECT r, c, a, r, c + 1, b, r + 1, c + 1, f FROM sq WHERE a + b + f IS NOT NULL UNION ALL
  SELECT r, c, a, r + 1, c, e, r + 1, c + 1, f FROM sq WHERE a + e + f IS NOT NULL UNION ALL
  SELECT r, c + 1, b, r + 1, c, e, r + 1, c + 1, f FROM sq WHERE a IS NULL AND b + e + f IS NOT NULL UNION ALL
  SELECT r, c, a, r, c + 1, b, r + 1, c, e FROM sq WHERE f IS NULL AND a + b + e IS NOT NULL UNION ALL
  SELECT w.r, w.c, w.z, e.r, e.c, e.z, v.r, v.c, v.z FROM g JOIN h w ON w.r = g.r AND w.c = g.c - 1 JOIN h e ON e.r = g.r AND e.c = g.c + 1 JOIN h v ON v.c = g.c AND abs(v.r - g.r) = 1
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.r = g.r AND h.c = g.c) AND (SELECT count(*) FROM h WHERE h.c = g.c AND abs(h.r - g.r) = 1) = 2),
pt AS (SELECT y.range AS y, x.range AS x, y.range / 3.0 AS py, x.range / 3.0 AS px FROM range(28) y, range(28) x),
bary AS (SELECT y, x, z1, z2, z3, ((x2 - px) * (y3 - py) - (x3 - px) * (y2 - py)) / ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) AS l1,
  ((x3 - px) * (y1 - py) - (x1 - px) * (y3 - py)) / ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) AS l2 FROM pt, tri)"""


@query("triangle_grid", on_cube("SELECT y, x, round(min(l1 * z1 + l2 * z2 + (1 - l1 - l2) * z3), 6) AS value FROM bary WHERE l1 >= -1e-9 AND l2 >= -1e-9 AND l1 + l2 <= 1 + 1e-9 GROUP BY 1, 2", TRIANGLES))
def triangle_grid(spark, d):
    z = cube(spark, d).where(~F.col("cell").isin(MISSING)).groupBy("cell").agg(F.sum("value").alias("value"))
    return G.triangulated(placed(z).select("row", "col", "value"), 3).select(*long("y", "x"), *r6("value"))


@query("distance_mask", on_cube("SELECT y, x FROM (SELECT unnest(generate_series(0, 14)) AS y) CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS x) WHERE NOT EXISTS (SELECT 1 FROM lab WHERE sqrt((y - \"row\") ** 2 + (x - col) ** 2) <= 2.5)", QUAD))
def distance_mask(spark, d):
    points = spark.range(15).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("x"))
    return G.far_points(points, cells(spark, d), 2.5).select("y", "x")


@query("series_with_trend", on_cube("SELECT community, CAST(make_date(CAST(y AS BIGINT), 7, 1) AS VARCHAR) AS time, 'rain' AS metric, round(v, 6) AS value, NULL AS mk_slope, NULL AS mk_intercept, NULL AS mk_p, NULL AS mk_trend_direction FROM cy UNION ALL SELECT community, 'MK_full', 'rain', NULL, round(slope, 6), round(intercept, 6), round(p, 5), trend FROM (SELECT *, " + TREND + " FROM mk) WHERE period = 'full' AND slope IS NOT NULL", YEARLY + "," + QUAD + ", cy AS (SELECT label AS community, y, sum(v) AS v FROM yearly JOIN lab USING (cell) GROUP BY 1, 2)," + trend_sql("cy", "community", [])))
def series_with_trend(spark, d):
    y = yearly(spark, d).join(quadrants(spark, d).select("cell", F.col("label").alias("community")), "cell").groupBy("community", F.make_date("y", F.lit(7), F.lit(1)).alias("time")).agg(F.sum("v").alias("rain"))
    trends = T.trend_table(y.select("community", "time", F.lit("rain").alias("metric"), F.col("rain").alias("v")), ["community", "metric"], [])
    rows = tables.series_rows(y, trends, ["rain"])
    return rows.select("community", "time", "metric", *r6("value", "mk_slope", "mk_intercept"), F.round("mk_p", 5).alias("mk_p"), "mk_trend_direction")


@query("rqa_with_rain", f"WITH RECURSIVE {BASE.strip()},{WINDOWS},{DAILY}, rain AS (SELECT win, round(quantile_cont(mean, 0.5), 6) AS rain FROM wins JOIN daily USING (time) GROUP BY 1) SELECT m.win, det, rain FROM ({lines() + METRICS}) m LEFT JOIN rain ON m.win = rain.win")
def rqa_with_rain(spark, d):
    rain = W.rain_rolling(W.daily(cube(spark, d), []), SIZE, STEP).select("win", *r6("rain"))
    return rqa(spark, d).select("win", *r6("det")).join(rain, "win", "left")


@query("rank_test", on_cube("SELECT cell, obs, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round((count(*) FILTER (WHERE v >= obs) + 1) / (count(*) + 1.0), 6) AS p, (count(*) FILTER (WHERE v >= obs) + 1) / (count(*) + 1.0) <= 0.3 AS significant FROM yearly JOIN (SELECT cell, v AS obs FROM yearly WHERE y = 1998) USING (cell) GROUP BY 1, 2", YEARLY))
def rank_test(spark, d):
    y = yearly(spark, d)
    got = R.rank_test(y.where("y = 1998"), y, "v", ["cell"], 0.3)
    return got.select("cell", F.col("v").alias("obs"), *r6("low", "high", "p"), "significant")


@query("dedupe_partitions", "SELECT label, q, k_req FROM (SELECT label, q, k_req, row_number() OVER (PARTITION BY label ORDER BY q DESC, k_req) AS r FROM (SELECT l_linenumber AS k_req, round(avg(l_discount), 6) AS q, array_to_string(list_transform(range(0, 10), lambda x: (x * l_linenumber) % 3), ',') AS label FROM lineitem GROUP BY 1)) WHERE r = 1")
def dedupe_partitions(spark, d):
    found = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("k_req")).agg(F.round(F.avg("l_discount"), 6).alias("q"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: (x * F.col("k_req")) % 3)
    found = found.withColumns({"labels": labels, "linkage": F.lit("ward"), "metric": F.lit("euclidean")})
    return G.distinct_partitions(found).select(F.array_join("labels", ",").alias("label"), "q", "k_req")


@query("ranked_partitions", "SELECT k_req, q FROM (SELECT k_req, q, row_number() OVER (PARTITION BY label ORDER BY q DESC, k_req) AS r FROM (SELECT l_linenumber AS k_req, round(avg(l_discount), 6) AS q, array_to_string(list_transform(range(0, 10), lambda x: (x * l_linenumber) % 4), ',') AS label FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1)) WHERE r = 1 ORDER BY q DESC, k_req LIMIT 2")
def ranked_partitions(spark, d):
    found = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("k_req")).agg(F.round(F.avg("l_discount"), 6).alias("q"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: (x * F.col("k_req")) % 4)
    found = found.withColumns({"labels": labels, "linkage": F.lit("ward"), "metric": F.lit("euclidean"), "k_found": F.when(F.col("k_req") % 4 == 0, 1).otherwise(4)})
    return G.ranked_partitions(found, 2).select("k_req", "q")


@query("zero_counts", lines() + "SELECT count(*) FILTER (WHERE det = 0) AS det, count(*) FILTER (WHERE lam = 0) AS lam FROM (" + METRICS + ")")
def zero_counts(spark, d):
    return R.zero_counts(rqa(spark, d), ["det", "lam"])


# Without an SQL twin: factorisations, knees, clusterings. tests/test_values.py holds their values.


def matrix(spark, d: str, size: int = 122) -> DataFrame:
    z = C.zscore(C.season(cube(spark, d), JJAS))
    return W.row_windows(W.positions(z), size, size).join(z, "time").select("win", "cell", "row", "col", F.col("rel").cast("int").alias("i"), C.matrix_value(F.col("z")).alias("z"))


@query("svd_window")
def svd_window(spark, d):
    return S.svd_by_window(matrix(spark, d).select("win", "cell", "i", "z"))


@query("window_communities")
def window_communities(spark, d):
    return S.communities(matrix(spark, d), 0.05)


@query("community_heatmap")
def community_heatmap(spark, d):
    m = matrix(spark, d)
    got = hold(S.communities(m, 0.05))
    return G.heatmap(got, cells(spark, d), m.select("win").distinct(), G.least_sizes(G.sizes(got, ["win"])))


@query("period_heatmaps")
def period_heatmaps(spark, d):
    z = hold(C.zscore(C.season(cube(spark, d), JJAS)))
    cfg = analysis.Config(sc_threshold=0.05, min_community_size=2, heatmap_periods=[(1992, 1995), (1994, 1998)])
    return analysis.period_cells(analysis.heatmaps_by_period(z, cells(spark, d), cfg), cells(spark, d))


def swept(spark, d: str, ks) -> DataFrame:
    z = cube(spark, d).groupBy("cell").agg(F.sum("value").alias("value"))
    return G.cluster_configs(placed(z), ks)


@query("k_sweep")
def k_sweep(spark, d):
    return G.distinct_partitions(swept(spark, d, range(2, 15))).select("linkage", "metric", "k_req", "k_found", "q", "p")


@query("k_choice")
def k_choice(spark, d):
    found = hold(swept(spark, d, range(2, 15)))
    return G.k_frequency(found).withColumn("chosen", F.lit(G.choose_k(found)))


@query("auto_k")
def auto_k(spark, d):
    return swept(spark, d, [0]).select("linkage", "metric", "k_found", "q")


@query("smooth_clusters")
def smooth_clusters(spark, d):
    return G.smooth_labels(rough_labels(spark, d), 0.1)


def flagship(spark, d: str) -> DataFrame:
    return rolling_rqa(spark, d)
