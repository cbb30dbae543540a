"""Readers and writers: long and wide cubes, polygons, result tables."""

from __future__ import annotations

import csv
import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import projections
from isohyet.functions.kernels import ring_area

#: Date forms of the input, least p of dot plots, column names of results.
DROPPED = ("Unnamed: 0", "geometry", "_c0")
DATES = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd")


def read_cube(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """A long Parquet cube (time, lat, lon, rainfall); names as in common exports are put right. NaN becomes null."""
    df = spark.read.parquet(path).withColumnsRenamed({"tp": "rainfall", "valid_time": "time", "latitude": "lat", "longitude": "lon"} | (rename or {}))
    return df.withColumn("rainfall", F.nanvl("rainfall", F.lit(None).cast("double")))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with one row for each cell and one column for each date -> (lat, lon, time, rainfall).

    A line is kept as one array of text and exploded with the dates, so the plan has a few columns however many days
    there are. Fields hold no commas but for the column geometry, which is dropped with its quotes. A line with another
    number of fields than the first one is an error.
    """
    lines = spark.read.text(path)
    head = lines.first().value
    names = [n.strip().strip('"') for n in split_csv(head)]
    n, geometry = len(names), r'"[^"]*"'
    fields = F.split(F.regexp_replace("value", geometry, ""), ",", -1)
    others = [k for k, c in enumerate(names) if not c or c in ("lat", "lon", *DROPPED)]
    dates = F.split(F.lit("\n".join(names)), "\n")
    broken = F.raise_error(F.concat(F.lit(f"{path}: a line has not {n} fields: "), F.substring("value", 1, 80)))
    rows = lines.where((F.col("value") != F.lit(head)) & (F.trim("value") != "")).select(F.when(F.size(fields) == n, fields).otherwise(broken).alias("f"))
    at = lambda c: F.try_element_at("f", F.lit(names.index(c) + 1)).cast("double").alias(c)
    each = rows.select(at("lat"), at("lon"), F.posexplode("f").alias("k", "v")).where(~F.col("k").isin(others))
    long = each.select("lat", "lon", F.element_at(dates, F.col("k") + 1).alias("time"), F.expr("try_cast(v AS double)").alias("rainfall"))
    return long.withColumns({"time": parsed_date(F.col("time")), "rainfall": F.nanvl("rainfall", F.lit(None).cast("double"))})


def split_csv(line: str) -> list[str]:
    return next(csv.reader([line]))


def parsed_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATES]).cast("date")


def melt(wide: DataFrame) -> DataFrame:
    """One column for each date -> (lat, lon, time, rainfall); dates in any of DATES."""
    wide = wide.drop(*DROPPED)
    dates = [c for c in wide.columns if c not in ("lat", "lon")]
    named = [F.col(f"`{d}`").cast("double").alias(d) for d in dates]
    long = wide.select("lat", "lon", *named).unpivot(["lat", "lon"], [F.col(f"`{d}`") for d in dates], "time", "rainfall")
    return long.withColumn("time", parsed_date(F.col("time")))


def read_polygons(spark: SparkSession, path: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons, each an outer ring and its holes, in degrees of WGS 84, of GeoJSON or a shapefile; polygons are few, so the driver holds them.

    GeoJSON is one document, or a folder of files with one feature a line, as write_features() gives. A shapefile's .prj or
    a document's crs names the reference system; projected ones are turned back to degrees. A missing .prj, or a system
    without a way back, is an error.
    """
    if path.lower().endswith(".shp"):
        prj = [r.value for r in spark.read.text(path[:-4] + ".prj", wholetext=True).collect()]
        if not prj:
            raise ValueError(f"{path}: no reference system")
        return unprojected(shapes(bytes(spark.read.format("binaryFile").load(path).first().content)), projections.from_wkt(prj[0]))
    out = []
    for row in spark.read.text(path, wholetext=True).collect():
        try:
            documents = [json.loads(row.value)]
        except json.JSONDecodeError:
            documents = [json.loads(line) for line in row.value.splitlines() if line.strip()]
        for found in documents:
            name = str(found.get("crs", {}).get("properties", {}).get("name", "CRS84"))
            back = None if name.endswith("CRS84") else projections.from_epsg(int(name.replace(":", " ").split()[-1]))
            geometries = [f["geometry"] for f in found["features"]] if "features" in found else [found.get("geometry", found)]
            parts = [p for g in geometries for p in ([g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"])]
            out += unprojected([[[tuple(p[:2]) for p in ring] for ring in part] for part in parts], back)
    return out


def unprojected(polygons: list, back: projections.Inverse | None) -> list:
    return [[[back(*p) for p in ring] for ring in part] for part in polygons] if back else polygons


def feature(df: DataFrame, geometry: str = "geometry") -> Column:
    """A row as a GeoJSON feature: the WKT polygon or multipolygon as its geometry, other columns as properties."""
    kind = F.when(F.col(geometry).startswith("MULTI"), "MultiPolygon").otherwise("Polygon")
    pairs = F.regexp_replace(F.regexp_extract(geometry, r"^\w+ (.*)$", 1), r"(-?[0-9.eE+-]+) (-?[0-9.eE+-]+)", "[$1,$2]")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != geometry]))
    return F.concat(F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), F.translate(pairs, "()", "[]"), F.lit("}}"))


def write_features(df: DataFrame, path: str, geometry: str = "geometry", by: tuple[str, ...] = ()) -> None:
    """Text files with one GeoJSON feature a line, in folders by the columns `by`, which are properties too."""
    df.select(*by, feature(df, geometry).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def shapes(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a shapefile's main file (types 5, 15 and 25): clockwise rings are outer, others holes of the one before."""
    out, at = [], 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        at += 8
        if struct.unpack_from("<i", data, at)[0] in (5, 15, 25):
            n_parts, n = struct.unpack_from("<2i", data, at + 36)
            first = [*struct.unpack_from(f"<{n_parts}i", data, at + 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", data, at + 44 + 4 * n_parts)
            points = list(zip(xy[::2], xy[1::2]))
            for a, b in zip(first, first[1:]):
                ring = points[a:b]
                if ring_area(ring) <= 0 or not out:
                    out.append([ring])
                else:
                    out[-1].append(ring)
        at += size
    return out


def cell_wkt(lat: Column, lon: Column, dlat: Column, dlon: Column) -> Column:
    """The cell's box as WKT."""
    x0, x1, y0, y1 = (F.format_string("%.4f", v) for v in (lon - dlon / 2, lon + dlon / 2, lat - dlat / 2, lat + dlat / 2))
    pt = lambda x, y: F.concat_ws(" ", x, y)
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)), F.lit("))"))


def write_heatmap(df: DataFrame, path: str, value: str = "rec_frac") -> None:
    heatmap_rows(df, value).write.mode("overwrite").csv(path, header=True)


def heatmap_rows(df: DataFrame, value: str = "rec_frac") -> DataFrame:
    return df.select("lat", "lon", value).where(F.col(value).isNotNull() & ~F.isnan(value))


def series_with_trend(series: DataFrame, trend: DataFrame) -> DataFrame:
    """Series rows and trend rows in one table, time as text."""
    return series.withColumn("time", F.col("time").cast("string")).unionByName(trend, allowMissingColumns=True)


def series_rows(series: DataFrame, trends: DataFrame, metrics: list[str]) -> DataFrame:
    """(community, metric, time as text, value, med, low, high, surr_low, surr_high, rank_sig, mk_slope, mk_intercept, mk_p, mk_trend_direction).

    All communities' series of all metrics in long form, and for each the row MK_full with its trend over the whole time.
    """
    pick = lambda c, kind="double": F.col(c).cast(kind) if c in series.columns else F.lit(None).cast(kind)
    each = F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), pick(m).alias("value"), *[pick(f"{m}_{b}").alias(b) for b in ("med", "low", "high", "surr_low", "surr_high")], pick(f"{m}_rank_sig", "boolean").alias("rank_sig"),
    ) for m in metrics])).alias("r")
    rows = series.select("community", F.col("time").cast("string").alias("time"), each).select("community", "time", "r.*").where("value IS NOT NULL")
    full = trends.where("period = 'full' AND slope IS NOT NULL").where(F.col("metric").isin(metrics))
    full = full.select("community", F.lit("MK_full").alias("time"), "metric", F.col("slope").alias("mk_slope"), F.col("intercept").alias("mk_intercept"), F.col("p").alias("mk_p"), F.col("trend").alias("mk_trend_direction"))
    return rows.unionByName(full, allowMissingColumns=True)


def write_series(series: DataFrame, trends: DataFrame, metrics: list[str], path: str) -> None:
    """CSV files in folders community=.../metric=..."""
    series_rows(series, trends, metrics).write.mode("overwrite").partitionBy("community", "metric").csv(path, header=True)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if kind == "csv" else w.parquet(path)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def dot_plot_rows(trends: DataFrame, periods: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Trend rows that have slope and p, with -log10 p (floor 1e-10) and the mark of significance."""
    df = trends.dropna(subset=["slope", "p"])
    df = df.where(F.col("period").isin(periods)) if periods else df
    df = df.where(F.col("metric").isin(metrics)) if metrics else df
    return df.withColumns({"neg_log_p": -F.log10(F.greatest("p", F.lit(1e-10))), "significant": F.col("p") < 0.05})
