"""Values of what has no SQL twin: against other formulations, hand-worked tables and frozen small cases."""

import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels as K
from isohyet.functions import projections
from isohyet.operators import grid as G
from isohyet.operators import recurrence as R
from isohyet.operators import spectral as S
from isohyet.plans import analysis
from isohyet.plans import queries as Q
from isohyet.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    return Q.matrix(spark, DATA).cache()


def test_svd_against_the_gram_matrix(spark, matrix):
    got = S.svd_by_window(matrix.select("win", "cell", "i", "z")).toPandas()
    for win, t in matrix.toPandas().groupby("win"):
        b = t.pivot(index="cell", columns="i", values="z").fillna(0).to_numpy()
        values, vectors = np.linalg.eigh(b.T @ b)
        values, vectors = values[::-1], vectors[:, ::-1]
        mine = got[got.win == win].sort_values("pc")
        n = len(mine)
        assert n == min(b.shape) or values[n] < 1e-15 * values[0]
        assert np.allclose(mine.share, values[:n] / (b * b).sum())
        p = np.abs(np.fft.rfft(vectors[:, 0])) ** 2
        p[1:-1] *= 2
        k = int(p.argmax())
        low = [i for i in range(k) if p[i] < p[k] / 2 or i == 0]
        high = [i for i in range(k + 1, len(p)) if p[i] < p[k] / 2 or i == len(p) - 1]
        band = slice(max(low) + 1 if low else k, min(high) if high else k + 1)
        assert mine.sc.iloc[0] == pytest.approx(p[band].sum() / p.sum())


def test_communities_from_stored_loadings(spark, matrix):
    ld = S.loadings(matrix.select("win", "cell", "i", "z")).toPandas()  # noqa: F841
    cells = matrix.select("cell", "row", "col").distinct().toPandas()  # noqa: F841
    for fixed in (0.05, 0.1):
        want = duckdb.sql(f"""WITH RECURSIVE hot AS (SELECT DISTINCT win, cell FROM (SELECT win, cell, sc, abs(a) AS a, stddev_pop(abs(a)) OVER (PARTITION BY win, pc) AS sd FROM ld) WHERE sc > {fixed} AND a > 3 * sd),
          h AS (SELECT * FROM hot JOIN cells USING (cell)),
          r AS (SELECT win, cell, cell AS other FROM h UNION SELECT r.win, r.cell, b.cell FROM r JOIN h a ON a.win = r.win AND a.cell = r.other JOIN h b ON b.win = a.win AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1)
          SELECT win, cell, min(other) AS comp FROM r GROUP BY 1, 2 HAVING count(*) >= 2""").df()
        got = S.communities(matrix, fixed).toPandas()
        assert {tuple(r) for r in got[["win", "cell", "comp"]].itertuples(index=False)} == {tuple(r) for r in want.itertuples(index=False)} and len(want)


def test_knee_is_left_out(spark):
    # The cutoff is one of the concentrations: a component at it does not count.
    sc = np.array([0.1, 0.1, 0.1, 0.2, 0.9])
    assert K.sc_cutoff(sc) in sc


def test_heatmap_of_communities(spark, matrix):
    got = Q.community_heatmap(spark, DATA).toPandas().set_index("cell")
    found = S.communities(matrix, 0.05).toPandas()
    size = found.groupby(["win", "comp"]).cell.transform("size")
    least = K.min_community_size(found.groupby(["win", "comp"]).size().to_numpy())
    n = found[size >= least].groupby("cell").win.nunique()
    windows = matrix.select("win").distinct().count()
    assert len(got) == 100 and windows > 1
    for cell, r in got.iterrows():
        assert (pd.isna(r.n) and cell not in n) or (r.n == n[cell] and r.fraction == pytest.approx(n[cell] / windows))


def test_size_knee_takes_a_histogram():
    sizes = [2, 2, 3, 3, 3, 4, 5, 9, 14, 15]
    values, counts = np.unique(sizes, return_counts=True)
    assert K.min_community_size(values, counts) == K.min_community_size(sizes)
    assert K.min_community_size([2, 9], [1, 2]) == 2 and K.min_community_size([2, 5], [3, 2]) == 3


def test_lags_of_opposite_vectors(spark):
    rows = [(i, [1.0, 0.5] if i % 2 else [-1.0, -0.5]) for i in range(40)]
    got = {r.dt: r for r in R.lag_percentiles(spark.createDataFrame(rows, "i int, x array<double>"), 5, block=7).collect()}
    assert set(got) == {1, 3, 5} and got[1].p90 == pytest.approx(2, abs=1e-5)  # equal vectors are left out


@pytest.mark.parametrize("cosine", [True, False])
def test_lags_across_blocks(spark, cosine):
    x = np.random.default_rng(2).normal(size=(53, 4))
    keep = [i for i in range(53) if i not in (5, 20, 21)]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in keep], "i int, x array<double>")
    got = R.lag_percentiles(df, 6, cosine, block=10).toPandas().set_index("dt")
    d = K.distances(x, cosine)
    for dt in range(1, 7):
        each = [d[i, i + dt] for i in keep if i + dt in keep]
        assert got.p50[dt] == pytest.approx(np.median(each)) and got.p99[dt] == pytest.approx(np.quantile(each, 0.99))


def test_theiler_window(spark):
    curve = [(1, dt, 1 - float(np.exp(-dt / 4))) for dt in range(1, 61)]
    few = [(2, 1, 0.1), (2, 2, 0.2), (2, 40, 0.3), (2, 41, 0.4)]
    flat = [(3, dt, 0.5) for dt in range(1, 61)]
    got = {r.k: r.theiler for r in R.theiler_windows(spark.createDataFrame(curve + few + flat, "k int, dt int, p90 double"), ["k"]).collect()}
    # The normalised curve up to 30 is farthest above its chord where 30 / 4 * exp(-dt / 4) = 1, about dt = 8.
    assert abs(got[1] - 8) <= 1 and got[2] == 41 and got[3] == 30


def test_surrogates_start_on_the_values():
    x = np.random.default_rng(5).normal(size=(32, 2))
    y = K.iaaft(x, np.random.default_rng(6), 0)
    assert np.array_equal(np.sort(x, axis=0), np.sort(y, axis=0))
    spectrum = np.fft.rfft(x, axis=0)
    rng = np.random.default_rng(6)
    phase = rng.uniform(-np.pi, np.pi, (17, 1)) + np.angle(spectrum) - np.angle(spectrum[:, :1])
    s = np.fft.irfft(np.abs(spectrum) * np.exp(1j * phase), n=32, axis=0)
    assert np.array_equal(np.argsort(s, axis=0), np.argsort(y, axis=0))


def test_relative_gap_ignores_the_lower_third():
    # int(0.33 * 9) - 1 = 1 step is ignored: the jump from 1 to 100, but not the one from 100 to 300.
    assert K.relative_gap([1, 100, 300, 301, 302, 303, 304, 305, 306]) == 200
    assert K.relative_gap([1.0]) is None


def test_q_statistic_without_variance_within(spark):
    k = K.q_statistic([1, 1, 5, 5, 9, 9], [0, 0, 1, 1, 2, 2])
    assert k["lam"] == 0 and k["f"] == np.inf and k["p"] == 0
    rows = [(1, z, lab) for z, lab in zip([1.0, 1.0, 5.0, 5.0, 9.0, 9.0], [0, 0, 1, 1, 2, 2])] + [(2, 3.0, 0), (2, 3.0, 1)] + [(3, float(z), z) for z in range(3)]
    rows += [(4, float(z), lab) for z, lab in zip([1, 2, 3, 10, 11, 12], [0, 0, 0, 1, 1, 1])]
    got = {r.k: r for r in G.q_statistic(spark.createDataFrame(rows, "k int, z double, label int"), ["k"]).collect()}
    assert (got[1].lam, got[1].f, got[1].p) == (0, float("inf"), 0) and (got[2].q, got[2].p) == (0, 1) and np.isnan(got[3].p)
    # F(1, 4) = 121.5: t = sqrt(F) with 4 degrees, two-sided tail 1 - s (1 + (1 - s^2) / 2), s = t / sqrt(t^2 + 4).
    s = (121.5 / 125.5) ** 0.5
    assert got[4].p == pytest.approx(1 - s * (1 + (1 - s * s) / 2), rel=1e-9)


def test_clusters_have_five_cells(spark):
    rng = np.random.default_rng(7)
    cells = spark.createDataFrame([(r * 6 + c, r, c, float(rng.normal())) for r in range(6) for c in range(6)], "cell long, row int, col int, value double")
    for r in G.cluster_configs(cells, [2, 8]).collect():
        sizes = np.bincount(r.labels)
        assert (sizes >= 5).all() and r.k_found == len(sizes) <= r.k_req


def test_sweep_repeats_its_clusterings(spark):
    found = Q.swept(spark, DATA, [3]).collect()
    z = {r.cell: r.value for r in Q.cube(spark, DATA).groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    for r in found:
        assert r.q == pytest.approx(K.q_statistic([z[c] for c in sorted(z)], r.labels)["q"])


def test_smoothing_a_speck(spark):
    # A lone cell of label 1 within label 0 goes, a block of 2 x 6 stays, a cell without label is not filled.
    lab = {(r, c): 0 if r < 4 else 2 for r in range(6) for c in range(6)} | {(1, 1): 1, (0, 5): -1}
    df = spark.createDataFrame([(r * 6 + c, r, c, 10.0 + r, 70.0 + c, k) for (r, c), k in lab.items()], "cell long, row int, col int, lat double, lon double, label long")
    got = {r.cell: r["rank"] for r in G.smooth_labels(df, 4).collect()}
    assert got == {r * 6 + c: 0 if r < 4 else 1 for r, c in lab if (r, c) != (0, 5)}


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_nearest_fill(spark, share):
    rng = np.random.default_rng(8)
    rows = [(r * 13 + c, r, c, int(rng.integers(0, 9)) if rng.random() < share else None) for r in range(11) for c in range(13) if rng.random() < 0.8]
    got = {r.cell: r.label for r in G.nearest_fill(spark.createDataFrame(rows, "cell long, row int, col int, label long")).collect()}
    have = [(r, c, k) for _, r, c, k in rows if k is not None]
    assert got == {i: k if k is not None else min(((r - a) ** 2 + (c - b) ** 2, a, b, x) for a, b, x in have)[3] for i, r, c, k in rows}


def test_outlines(spark):
    ring = [(r, c) for r in range(4) for c in range(4) if not (r in (1, 2) and c in (1, 2))] + [(5, 5), (6, 6)]
    df = spark.createDataFrame([(1, r, c) for r, c in ring] + [(2, 0, 9), (2, 0, 10), (2, 1, 9)], "community int, row int, col int")
    got = {r.community: r for r in G.outlines(df, 1.0, 1.0, 0.5, 0.5).collect()}
    assert (got[1].cells, got[1].rings, got[1].area) == (14, 4, 14)
    assert got[1].geometry.count("((") == 3 and "(1.0000 1.0000, 1.0000 3.0000, 3.0000 3.0000, 3.0000 1.0000, 1.0000 1.0000)" in got[1].geometry
    assert got[2].geometry == "MULTIPOLYGON (((9.0000 0.0000, 11.0000 0.0000, 11.0000 1.0000, 10.0000 1.0000, 10.0000 2.0000, 9.0000 2.0000, 9.0000 0.0000)))"


def test_wide_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Unnamed: 0,lat,lon,2000-01-01,02.01.2000,geometry\n0,10.5,70.25,1.5,,"POINT (70, 10)"\n1,11.5,70.25,nan,2,\n')
    got = {(r.lat, str(r.time)): r.rainfall for r in tables.read_wide_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {(10.5, "2000-01-01"): 1.5, (10.5, "2000-01-02"): None, (11.5, "2000-01-01"): None, (11.5, "2000-01-02"): 2.0}


UTM = (
    'PROJCS["WGS_1984_UTM_Zone_18N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'
    'PROJECTION["Transverse_Mercator"],PARAMETER["Central_Meridian",%d.0],PARAMETER["False_Easting",%d.0],PARAMETER["False_Northing",0.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
)


def test_projections_at_published_points():
    """Worked examples of the map projection literature, on Clarke's ellipsoid of 1866; they give metres to 0.1."""
    a, f = 6378206.4, 1 / 294.978698214
    assert projections.transverse_mercator(a, f, lon0=-75, k0=0.9996)(127106.5, 4484124.4) == pytest.approx((-73.5, 40.5), abs=1e-6)
    assert projections.lambert_conic(a, f, lon0=-96, lat0=23, lat1=33, lat2=45)(1894410.9, 1564649.5) == pytest.approx((-75, 35), abs=1e-6)
    assert projections.mercator(a, f, lon0=-180)(11688673.7, 4139145.6) == pytest.approx((-75, 35), abs=1e-6)
    assert projections.from_epsg(3857)(20037508.342789244, 0.0) == pytest.approx((180, 0), abs=1e-9)
    south = projections.from_epsg(32756)(500_000.0, 10_000_000.0)
    assert south == pytest.approx((153, 0), abs=1e-9) and projections.from_epsg(4326) is None
    # Meridian arc: a quarter of the ellipsoid's circumference through the poles.
    assert projections.transverse_mercator(6378137.0, 1 / 298.257223563)(0.0, 10001965.729) == pytest.approx((0, 90), abs=1e-7)
    assert projections.from_wkt('GEOGCS["WGS 84"]') is None
    one = 'PROJCS["x",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",33],PARAMETER["standard_parallel_2",45],PARAMETER["latitude_of_origin",23],PARAMETER["central_meridian",-96],PARAMETER["false_easting",100],PARAMETER["false_northing",0],UNIT["metre",1]]'
    assert projections.from_wkt(one)(100.0, 0.0) == pytest.approx((-96, 23), abs=1e-8)
    for bad in ('PROJCS["NAD27"]', 'PROJCS["WGS 84",PROJECTION["Mercator"],UNIT["foot",0.3048]]'):
        with pytest.raises(ValueError):
            projections.from_wkt(bad)
    with pytest.raises(ValueError):
        projections.from_epsg(27700)


def test_features_come_back(spark, tmp_path):
    rows = [(1, r, c) for r in range(4) for c in range(4) if (r, c) != (1, 2)] + [(2, 6, 6), (2, 8, 8)]
    shapes = G.outlines(spark.createDataFrame(rows, "community long, row int, col int"), 0.5, 0.5, 10.0, 70.0)
    tables.write_features(shapes, str(tmp_path / "f"), by=("community",))
    got = tables.read_polygons(spark, str(tmp_path / "f" / "community=1"))
    assert [len(p) for p in got] == [2] and sorted(set(got[0][1])) == [(70.75, 10.25), (70.75, 10.75), (71.25, 10.25), (71.25, 10.75)]
    assert len(tables.read_polygons(spark, str(tmp_path / "f" / "community=2"))) == 2
    first = spark.read.text(str(tmp_path / "f" / "community=1")).first().value
    assert '"cells":15' in first and '"type":"MultiPolygon"' in first


def test_a_broken_line_of_a_wide_file_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("lat,lon,2000-01-01,2000-01-02\n1,2,3,4\n\n5,6,7\n")
    with pytest.raises(Exception, match="has not 4 fields"):
        tables.read_wide_csv(spark, str(tmp_path / "w.csv")).collect()
    (tmp_path / "w.csv").write_text("lat,lon,2000-01-01,2000-01-02\n1,2,3,4\n\n")
    assert tables.read_wide_csv(spark, str(tmp_path / "w.csv")).count() == 2


def cells_merged(labels, row, col, least):
    """Merging on the cells themselves, one cluster after the other."""
    out, at = labels.copy(), {(r, c): i for i, (r, c) in enumerate(zip(row, col))}
    size = dict(zip(*(x.tolist() for x in np.unique(labels, return_counts=True))))
    for k in sorted(i for i, s in size.items() if s < least):
        near = {int(out[j]) for i in np.flatnonzero(out == k) for a, b in G.QUEEN if (j := at.get((row[i] + a, col[i] + b))) is not None} - {k}
        near = [i for i in near if size[i] >= least]
        if near:
            to = min(near, key=lambda i: (-size[i], i))
            out[out == k] = to
            size[to] += size.pop(k)
    return out


def test_merging_on_the_graph_of_clusters(spark):
    rng = np.random.default_rng(3)
    for least in (2, 4, 9):
        row, col = (x.tolist() for x in np.divmod(np.flatnonzero(rng.random(144) < 0.9), 12))
        labels = rng.integers(0, 30, len(row))
        df = spark.createDataFrame([(i, r, c, int(k)) for i, (r, c, k) in enumerate(zip(row, col, labels))], "cell long, row int, col int, label long")
        got = {r.cell: r.label for r in G.merge_remaining(df, least).collect()}
        assert [got[i] for i in range(len(row))] == cells_merged(labels, row, col, least).tolist()


def test_trend_table_is_read_again(spark, tmp_path):
    t = spark.createDataFrame([(1, "det", "full", 0.5, 1e-12, True), (1, "rain", "full", None, None, False), (2, "det", "1951-1981", -0.1, 0.04, True)], "community long, metric string, period string, slope double, p double, significant boolean")
    tables.write_table(t, str(tmp_path / "t"), "csv")
    got = {(r.community, r.period): (r.neg_log_p, r.significant) for r in tables.dot_plot_rows(tables.read_trends(spark, str(tmp_path / "t"))).collect()}
    assert got == {(1, "full"): (10.0, True), (2, "1951-1981"): (pytest.approx(-np.log10(0.04)), True)}
    assert tables.dot_plot_rows(tables.read_trends(spark, str(tmp_path / "t")), ["full"], ["det"]).count() == 1


def test_command_line_says_what_is_missing(capsys):
    for args in ([], ["--path", "x", "--mode", "single"], ["--path", "x", "--preset", "spring"], ["--path", "x", "--mode", "all", "--only", "JJAS_full,spring"]):
        with pytest.raises(SystemExit):
            analysis.main(args)
    assert "--path is needed" in capsys.readouterr().err
    analysis.main(["--list"])
    assert "JJAS_full" in capsys.readouterr().out


def test_polygon_files(spark, tmp_path):
    shape = '{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]]}}]%s}'
    (tmp_path / "a.json").write_text(shape % "")
    assert [len(p) for p in tables.read_polygons(spark, str(tmp_path / "a.json"))] == [2]
    (tmp_path / "m.json").write_text(shape % ', "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}')
    assert tables.read_polygons(spark, str(tmp_path / "m.json"))[0][0][1] == pytest.approx((4 / 6378137 * 180 / np.pi, 0), abs=1e-12)
    (tmp_path / "b.json").write_text(shape % ', "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::2154"}}')
    with pytest.raises(ValueError):
        tables.read_polygons(spark, str(tmp_path / "b.json"))
    rings = [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(8, 8), (8, 9), (9, 9), (8, 8)]]
    points = [p for r in rings for p in r]
    body = struct.pack("<i4d2i", 5, 0, 0, 9, 9, len(rings), len(points)) + struct.pack("<3i", 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "c.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    (tmp_path / "c.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    assert [len(p) for p in tables.read_polygons(spark, str(tmp_path / "c.shp"))] == [2, 1]
    (tmp_path / "c.prj").write_text(UTM % (-75, 500000))
    east = tables.read_polygons(spark, str(tmp_path / "c.shp"))[0][0][0]
    assert east == pytest.approx(projections.from_epsg(32618)(0.0, 0.0), abs=1e-9)
    (tmp_path / "c.prj").write_text('PROJCS["WGS_1984_Polar",GEOGCS["GCS_WGS_1984"],PROJECTION["Stereographic"],UNIT["Meter",1.0]]')
    with pytest.raises(ValueError):
        tables.read_polygons(spark, str(tmp_path / "c.shp"))


def test_rain_leaves_out_cells_with_gaps(spark):
    rows = [(f"2000-01-{d:02d}", cell, (None if cell == 1 and d == 3 else float(cell))) for d in range(1, 13) for cell in (0, 1, 2)]
    cube = spark.createDataFrame(rows, "time string, cell long, value double").withColumn("time", F.to_date("time"))
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "cell long, rank long")
    got = analysis.rain_series(cube, labels, analysis.Config(window=2)).collect()
    assert {(r.rain, r.dry_node_fraction, r.dry_fraction) for r in got} == {(1.0, 0.5, 0.0)}


def test_trend_periods_and_options():
    assert analysis.TREND_PERIODS[-1] == (1991, 2021) and analysis.HEATMAP_PERIODS[0] == (1951, 2023) and len(analysis.HEATMAP_PERIODS) == 6
    assert analysis.parse_bool("Off") is False and analysis.parse_size("auto") == "auto" and analysis.parse_year("none") is None
    with pytest.raises(ValueError):
        analysis.parse_bool("maybe")


def test_tiles_of_a_large_grid_give_the_window_of_one(spark):
    """Components and hot cells from products of times over several tiles, against one decomposition of the whole window."""
    rng = np.random.default_rng(9)
    side, n = 70, 24
    t = np.arange(n)
    field = rng.normal(size=(side, side, n))
    field[5:9, 5:9] += 20 * np.sin(2 * np.pi * 3 * t / n)
    field[40:44, 60:64] += 20 * np.cos(2 * np.pi * 5 * t / n)
    field[20, 20] = 0.0
    rows = [(0, r * 1000 + c, r, c, int(i), float(field[r, c, i])) for r in range(side) for c in range(side) for i in t if (r, c, i) != (3, 3, 4)]
    matrix = spark.createDataFrame(pd.DataFrame(rows, columns=["win", "cell", "row", "col", "i", "z"])).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int"), "i": F.col("i").cast("int")})
    field[3, 3, 4] = 0.0
    z, a = K.svd_factors(field.reshape(-1, n))
    sc = np.array([K.half_height(p)[0] for p in K.power_spectrum(z)])
    got = S.svd_by_window(matrix, ("win",)).sort("pc").toPandas()
    size = (a**2).sum(0)
    assert np.allclose(got.share, size / size.sum()) and np.allclose(got.sc, sc, atol=1e-8)
    strong = np.abs(a[:, np.flatnonzero(sc > 0.5)])
    hot = np.flatnonzero((strong > 3 * strong.std(0)).any(1))
    comp = hot[K.union_find(len(hot), K.grid_edges((hot // side).tolist(), (hot % side).tolist()))]
    name = lambda i: int(i // side * 1000 + i % side)
    want = {(name(k), name(i)) for k, i in zip(comp, hot) if (comp == k).sum() >= 2}
    found = S.communities(matrix, 0.5, ("win",)).toPandas()
    assert set(zip(found.comp, found.cell)) == want and {5005, 8008, 43063} <= set(found.cell)
    assert S.packed(matrix, ("win",)).select(F.max(F.size("cells"))).first()[0] <= S.TILE**2
