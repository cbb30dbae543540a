"""The whole analysis: load, clip, filter, normalise, find communities, cluster and smooth them, and follow each one's
recurrence and rain with trends. All communities, windows and periods are rows of the same tables."""

from __future__ import annotations

import argparse
import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.operators import cube as C
from isohyet.operators import grid as G
from isohyet.operators import recurrence as R
from isohyet.operators import spectral as S
from isohyet.operators import trend as T
from isohyet.operators import windows as W
from isohyet.operators.hold import hold
from isohyet.sources import netcdf, tables

#: Window size in days and months of the named runs, inclusive periods of heatmaps, half-open ones of
#: trends as (first, last) year, names of metrics and command-line options.
PRESETS = {"JJAS_full": (122, [6, 7, 8, 9]), "OND_full": (91, [10, 11, 12])}
HEATMAP_PERIODS = [(1951, 2023), (1951, 1981), (1961, 1991), (1971, 2001), (1981, 2011), (1991, 2021)]
TREND_PERIODS = [(1951, 1981), (1961, 1991), (1971, 2001), (1981, 2011), (1991, 2021)]
METRICS = ["det", "lam", "entr", "lmean"]
RAIN = ["rain", "dry_fraction", "dry_node_fraction"]


@dataclass
class Config:
    window: int = 122
    months: list[int] | None = field(default_factory=lambda: [6, 7, 8, 9])
    year: str | None = None
    overlap: float = 0
    sc_threshold: float | None = None
    min_community_size: int | str = "auto"
    ks: range = range(2, 15)
    cluster_fraction: float = 0.0
    least_cluster: float = 0.1
    sort_by: str = "south"
    use_theiler_window: bool = True
    q: float = 0.1
    surrogates: int = 99
    median_days: int = 2190
    units: str = "mm"
    polygons: list | None = None
    heatmap_periods: list = field(default_factory=lambda: HEATMAP_PERIODS)
    trend_periods: list = field(default_factory=lambda: TREND_PERIODS)


def preset(name: str, **more) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    window, months = PRESETS[name]
    return Config(window=window, months=months, **more)


def prepare(cube: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """(time, lat, lon, rainfall) -> the season's cube with cells, its z-scores, anomalies and figures."""
    cells = C.grid_index(cube.select("lat", "lon").distinct()).withColumn("cell", F.col("row").cast("long") * 100_000 + F.col("col"))
    c = cube.join(cells, ["lat", "lon"]).withColumn("value", C.scaled(C.clean(F.col("rainfall").cast("double")), cfg.units)).drop("rainfall")
    valid = [C.valid_cells(c).withColumn("step", F.lit("read"))]
    step = hold(C.resolution(cells)).first()
    if cfg.polygons:
        c = C.clip(c, cfg.polygons, step.dlon or 1.0, step.dlat or 1.0, cells)
        valid.append(C.valid_cells(c).withColumn("step", F.lit("clipped")))
    c = hold(C.year_filter(C.season(c, cfg.months), cfg.year))
    area = c.select("cell", "lat").distinct().agg(F.sum(C.cell_area(F.col("lat"), F.lit(step.dlat), F.lit(step.dlon))).alias("square_km"))
    figures = functools.reduce(DataFrame.unionByName, valid).select("step", "valid_cells").crossJoin(area)
    return {"cube": c, "cells": c.select("cell", "row", "col", "lat", "lon").distinct(), "z": hold(C.zscore(c)), "anomalies": C.detrend(C.anomalies(c)), "hydro": C.hydro_totals(c), "figures": figures}


def heatmap(z: DataFrame, cells: DataFrame, cfg: Config, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cell, n, fraction) over windows of cfg.window rows, for cells with values that differ."""
    step = W.step_of(cfg.window, cfg.overlap)
    w = hold(W.row_windows(W.positions(z, list(keys)), cfg.window, step))
    m = w.join(z, [*keys, "time"]).select(*keys, "win", "cell", "row", "col", F.col("rel").cast("int").alias("i"), C.matrix_value(F.col("z")).alias("z"))
    large = cells.count() > G.TILE * G.TILE
    found = hold(S.communities(m, cfg.sc_threshold, (*keys, "win"), G.TILE if large else None))
    least = G.least_sizes(G.sizes(found, [*keys, "win"]), keys) if cfg.min_community_size == "auto" else int(cfg.min_community_size)
    return G.heatmap(found, cells.join(C.roi(z.select("cell", F.col("value")), 1).select("cell"), "cell", "left_semi"), w, least, keys)


def heatmaps_by_period(z: DataFrame, cells: DataFrame, cfg: Config) -> DataFrame:
    """(period, cell, n, fraction): the heatmap within each period, after a z-score of its own. All periods are one job."""
    own = W.by_period(z.withColumn("value", C.matrix_value(F.col("z"))).drop("z"), cfg.heatmap_periods)
    by_cell = Window.partitionBy("period", "cell")
    own = own.withColumn("z", (F.col("value") - F.avg("value").over(by_cell)) / C.one_if_zero(F.stddev_pop("value").over(by_cell)))
    return heatmap(hold(own), cells, cfg, ("period",))


def period_cells(heat: DataFrame, cells: DataFrame, upsample: int = 2) -> DataFrame:
    """(period, rf, geometry): boxes of the period's heatmap, interpolated on a grid of 1/upsample steps; no community counts as 0."""
    at = cells.agg(F.min(F.struct("row", "lat")).alias("y0"), F.max(F.struct("row", "lat")).alias("y1"), F.min(F.struct("col", "lon")).alias("x0"), F.max(F.struct("col", "lon")).alias("x1"))
    size = lambda a, b, k, v: (F.col(f"{b}.{v}") - F.col(f"{a}.{v}")) / F.greatest(F.col(f"{b}.{k}") - F.col(f"{a}.{k}"), F.lit(1)) / upsample
    at = at.select((F.col("y0.lat") - F.col("y0.row") * upsample * size("y0", "y1", "row", "lat")).alias("lat0"), size("y0", "y1", "row", "lat").alias("dlat"), (F.col("x0.lon") - F.col("x0.col") * upsample * size("x0", "x1", "col", "lon")).alias("lon0"), size("x0", "x1", "col", "lon").alias("dlon"))
    fine = G.triangulated(heat.join(cells.select("cell", "row", "col"), "cell").withColumn("value", F.coalesce("fraction", F.lit(0.0))), upsample, ("period",))
    boxes = fine.crossJoin(at)  # one row
    return boxes.select("period", F.col("value").alias("rf"), tables.cell_wkt(F.col("lat0") + F.col("y") * F.col("dlat"), F.col("lon0") + F.col("x") * F.col("dlon"), F.col("dlat"), F.col("dlon")).alias("geometry"))


def communities(heat: DataFrame, cells: DataFrame, z: DataFrame, cfg: Config) -> DataFrame:
    """(cell, label, rank): clusters of the heatmap at the k of the knee, smoothed and ordered.

    Cells with fewer than two values, or all alike, take no part.
    """
    values = cells.join(C.roi(z.select("cell", "value"), 2).select("cell"), "cell", "left_semi").join(heat, "cell", "left")
    values = hold(values.select("cell", "row", "col", F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    found = hold(G.cluster_configs(values, cfg.ks, cfg.cluster_fraction))
    k = G.choose_k(found)
    best = G.ranked_partitions(found.where(F.col("k_req") == k), 1)
    order = values.agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    pairs = best.select("labels").crossJoin(order).select(F.explode(F.arrays_zip("cells", "labels")).alias("p"))  # one row each
    labels = cells.join(pairs.select(F.col("p.cells").alias("cell"), F.col("p.labels").cast("long").alias("label")), "cell")
    return G.smooth_labels(labels, cfg.least_cluster, order=cfg.sort_by)


def state_series(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, time, x): the z-scores of each community's cells without missing values, in order of the cell."""
    full = C.whole_cells(z.withColumn("value", F.col("z"))).join(labels.select("cell", F.col("rank").alias("community")), "cell")
    return full.groupBy("community", "time").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "z"))), lambda s: s["z"]).alias("x"))


def recurrence_series(z: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """(community, win, time, det ... and surrogate bands): all communities' windows of 6 times cfg.window days."""
    size, step = 6 * cfg.window, cfg.window
    state = hold(state_series(z, labels))
    pos = W.positions(z)
    lags = R.lag_percentiles(state.join(pos, "time").select("community", F.col("pos").cast("int").alias("i"), "x"), 90, keys=("community",))
    tw = R.theiler_windows(lags, ["community"]) if cfg.use_theiler_window else state.select("community", F.lit(1).alias("theiler")).distinct()
    w = W.row_windows(pos, size, step)
    rows = w.join(state, "time").select("community", "win", F.col("rel").cast("int").alias("i"), "x").join(tw, "community")
    keys = ("community", "win")
    got = R.nulled(R.histogram_metrics(R.line_histograms(rows, cfg.q, keys=keys), size, keys=keys), METRICS)
    got = got.join(W.midpoints(w, size), "win")
    if cfg.surrogates:
        surr = hold(R.surrogates(rows, cfg.surrogates, cfg.q, keys=keys))
        got = hold(got)
        for m in METRICS:
            test = R.rank_test(got.where(F.col(m).isNotNull()), surr, m, list(keys)).drop(m)
            got = got.join(test.withColumnsRenamed({"low": f"{m}_surr_low", "high": f"{m}_surr_high", "p": f"{m}_p", "significant": f"{m}_rank_sig"}), list(keys), "left")
    for m in METRICS:
        got = W.smooth(got, m, cfg.median_days, keys=["community"])
    return got


def rain_series(cube: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """Rain and dryness of each community's cells without missing values."""
    c = C.whole_cells(cube).join(labels.select("cell", F.col("rank").alias("community")), "cell").withColumn("value", C.wet(F.col("value")))
    got = W.rain_rolling(W.daily(c, ["community"]), 6 * cfg.window, cfg.window, ["community"])
    for m in RAIN:
        got = W.smooth(got, m, cfg.median_days, keys=["community"])
    return got


def trends(series: DataFrame, metrics: list[str], cfg: Config) -> DataFrame:
    long = series.select("community", "time", *metrics).unpivot(["community", "time"], metrics, "metric", "v")
    return T.trend_table(long, ["community", "metric"], cfg.trend_periods)


def run_pipeline(spark: SparkSession, cube: DataFrame, cfg: Config, out_dir: str | None = None) -> dict[str, DataFrame]:
    """All results by name; written as Parquet under out_dir if it is given, series also as CSV."""
    p = prepare(cube, cfg)
    heat = hold(heatmap(p["z"], p["cells"], cfg))
    labels = communities(heat, p["cells"], p["z"], cfg)
    rqa, rain = hold(recurrence_series(p["z"], labels, cfg)), hold(rain_series(p["cube"], labels, cfg))
    both = rqa.join(rain.drop("time"), ["community", "win"], "left")
    found = {
        "figures": p["figures"], "heatmap": heat.join(p["cells"], "cell"), "communities": labels, "rqa": both, "rain": rain,
        "trends": hold(trends(rqa, METRICS, cfg).unionByName(trends(rain, RAIN, cfg))), "limits": W.padded_limits(both, [*METRICS, *RAIN]),
        "period_cells": period_cells(heatmaps_by_period(p["z"], p["cells"], cfg), p["cells"]),
    }
    axes = C.resolution(p["cells"]).crossJoin(p["cells"].agg(F.min("row").alias("r"), F.min("col").alias("c"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))).first()
    if axes:
        dlat, dlon = axes.dlat or 1.0, axes.dlon or 1.0
        found["outlines"] = G.outlines(labels.join(p["cells"], "cell").select(F.col("rank").alias("community"), "row", "col"), dlat, dlon, axes.lat - axes.r * dlat, axes.lon - axes.c * dlon)
    if out_dir:
        for name, df in found.items():
            tables.write_table(df, f"{out_dir}/{name}")
        tables.write_heatmap(found["heatmap"], f"{out_dir}/heatmap_csv", "fraction")
        tables.write_table(found["trends"], f"{out_dir}/trends_csv", "csv")
        tables.write_features(found["period_cells"], f"{out_dir}/period_cells_geojson", by=("period",))
        if "outlines" in found:
            tables.write_features(found["outlines"], f"{out_dir}/outlines_geojson")
        tables.write_series(both, found["trends"], [*METRICS, *RAIN], f"{out_dir}/series_csv")
    return found


def parse_months(text: str | None) -> list[int] | None:
    return None if text is None or text.strip().lower() in ("", "none", "all") else [int(x) for x in text.split(",")]


def parse_year(text: str | None) -> str | None:
    return None if text is None or text.strip().lower() in ("", "none", "all") else text.strip()


def parse_bool(text: str) -> bool:
    word = text.strip().lower()
    if word in ("1", "true", "yes", "y", "on"):
        return True
    if word in ("0", "false", "no", "n", "off"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


def parse_size(text: str) -> int | str:
    return "auto" if text.strip().lower() == "auto" else int(text)


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Communities and recurrence dynamics of a gridded field.")
    a.add_argument("--path", help="wide CSV, long Parquet cube, or classic NetCDF (.nc)")
    a.add_argument("--variable", default="tp", help="variable of a NetCDF file")
    a.add_argument("--shapefile", help="GeoJSON or .shp polygons to clip to")
    a.add_argument("--out_dir", default="results")
    a.add_argument("--mode", choices=["preset", "single", "all"], default="preset")
    a.add_argument("--preset", default="JJAS_full")
    a.add_argument("--only", help="comma-separated presets of mode all")
    a.add_argument("--list", action="store_true")
    a.add_argument("--window", type=int, help="rows of a window, in mode single")
    a.add_argument("--months", type=parse_months)
    a.add_argument("--year", type=parse_year)
    a.add_argument("--units", default="mm")
    a.add_argument("--min_community_size", type=parse_size, default="auto")
    a.add_argument("--cluster_fraction", type=float, default=0.0, help="least share of the cells in a cluster")
    a.add_argument("--surrogates", type=int, default=99)
    a.add_argument("--quantile", type=float, default=0.1, help="share of distances that are recurrences")
    a.add_argument("--sort_by", choices=["south", "north"], default="south")
    a.add_argument("--use_theiler_window", type=parse_bool, default=True)
    o = a.parse_args(args)
    if o.list:
        print("\n".join(f"{n}: window {w}, months {m}" for n, (w, m) in PRESETS.items()))
        return
    if not o.path:
        a.error("--path is needed: a wide CSV or a long Parquet cube")
    if o.mode == "single" and not o.window:
        a.error("mode single needs --window")
    unknown = [n for n in ([o.preset] if o.mode == "preset" else o.only.split(",") if o.mode == "all" and o.only else []) if n not in PRESETS]
    if unknown:
        a.error(f"unknown preset {', '.join(unknown)}; there are {', '.join(PRESETS)}")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.path.endswith((".nc", ".cdf")):
        cube = netcdf.read_netcdf(spark, o.path, o.variable).withColumn("time", F.col("time").cast("date"))
    else:
        cube = tables.read_wide_csv(spark, o.path) if o.path.endswith(".csv") else tables.read_cube(spark, o.path)
    more = dict(year=o.year, units=o.units, min_community_size=o.min_community_size, cluster_fraction=o.cluster_fraction, surrogates=o.surrogates, q=o.quantile, sort_by=o.sort_by, use_theiler_window=o.use_theiler_window, polygons=tables.read_polygons(spark, o.shapefile) if o.shapefile else None)
    names = [o.preset] if o.mode == "preset" else (o.only.split(",") if o.only else list(PRESETS)) if o.mode == "all" else ["custom"]
    for name in names:
        cfg = Config(window=o.window, months=o.months, **more) if name == "custom" else preset(name, **more)
        run_pipeline(spark, cube, cfg, f"{o.out_dir}/{name}")


if __name__ == "__main__":
    main()
