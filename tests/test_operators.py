"""Operators on small tables, and the whole analysis on a small cube."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels
from isohyet.operators import cube as C
from isohyet.operators import recurrence as R
from isohyet.operators import windows as W
from isohyet.plans import analysis
from isohyet.sources import tables


def test_hydro_year_and_periods(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE '2000-05-31'), (DATE '2000-06-01') AS t(time)")
    assert [r[0] for r in df.select(C.hydro_year(F.col("time"))).collect()] == [1999, 2000]
    day = spark.sql("SELECT DATE '1981-01-01' AS time")
    assert C.years_half_open(day, 1951, 1981).count() == 0 and C.years_inclusive(day, 1951, 1981).count() == 1
    with pytest.raises(ValueError):
        C.year_filter(day, "since_1981")


def test_smoothing_frame(spark):
    df = spark.range(5).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("time"), F.col("id").cast("double").alias("v"))
    got = [r.v_med for r in W.smooth(df, "v", 4).sort("time").collect()]
    assert got == [1.0, 1.5, 2.5, 3.0, 3.5]  # 3, 4, 4, 3, 2 days each


def test_row_windows(spark):
    pos = spark.range(10).select(F.col("id").alias("pos"), F.lit(10).cast("long").alias("total"))
    got = {(r.win, r.n) for r in W.row_windows(pos, 4, 3).groupBy("win").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 4), (1, 4), (2, 4)}


def test_melt(spark):
    wide = spark.sql("SELECT 1.0D AS lat, 2.0D AS lon, 3.0D AS `2000-01-02`, 4.0D AS `03.01.2000`, 'x' AS geometry")
    got = sorted((str(r.time), r.rainfall) for r in tables.melt(wide).collect())
    assert got == [("2000-01-02", 3.0), ("2000-01-03", 4.0)]


@pytest.mark.parametrize("cosine", [True, False])
def test_recurrence_matches_dense(spark, cosine):
    x = np.random.default_rng(1).normal(size=(40, 5))
    state = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "win long, i int, x array<double>")
    got = R.line_metrics(R.recurrences(state, 0.2, 2, cosine), 40).first().asDict()
    want = kernels.line_metrics(kernels.recurrence(x, 0.2, 2, cosine))
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for rows in (state, state.where("i % 7 <> 3")):  # with missing rows too
        lens = R.line_histograms(rows, 0.2, 2, cosine)
        runs = R.runs(R.recurrences(rows, 0.2, 2, cosine)).groupBy("win", "kind", "len").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, lens.collect())) == sorted(map(tuple, runs.collect()))
        a, b = (f.first().asDict() for f in (R.histogram_metrics(lens, 40), R.line_metrics(R.recurrences(rows, 0.2, 2, cosine), 40)))
        assert a == pytest.approx(b)


def test_clip_counts_touched_cells(spark):
    cells = spark.sql("SELECT x.id * 1.0D AS lon, y.id * 1.0D AS lat FROM range(5) x JOIN range(5) y ON true")
    got = C.clip(cells, [[(1.4, 1.4), (1.6, 1.4), (1.6, 2.6), (1.4, 2.6)]], 1.0, 1.0).count()
    assert got == 6


def coast(n, x=0.0, y=0.0, size=20.0):
    """A concave ring of n vertices."""
    a = np.arange(n) * 2 * np.pi / n
    r = size * (0.6 + 0.3 * np.sin(7 * a) + 0.1 * np.sin(53 * a))
    return [*zip((x + r * np.cos(a)).tolist(), (y + r * np.sin(a)).tolist())]


def test_clip_to_a_coast_of_ten_thousand_vertices(spark):
    outer, hole = coast(10_000), coast(500, 1.0, 1.0, 4.0)
    cells = spark.range(200 * 200).select(((F.col("id") % 200) * 0.25 - 25).alias("lon"), (F.floor(F.col("id") / 200) * 0.25 - 25.1).alias("lat"))
    began = time.time()
    got = {(r.lon, r.lat) for r in C.clip(cells, [[outer, hole]], 0.25, 0.25).collect()}
    assert time.time() - began < 60  # a nested expression of all edges has no end
    # By sampling: a cell with some points of a fine grid inside is touched, one without any by any edge is not.
    inside = lambda x, y: kernels.within([*outer, outer[0]], x, y) and not kernels.within([*hole, hole[0]], x, y)
    edge = np.array(outer + hole)
    for r in cells.sample(0.004, 7).collect():
        near = (np.abs(edge[:, 0] - r.lon) <= 0.125) & (np.abs(edge[:, 1] - r.lat) <= 0.125)
        if near.any():
            assert (r.lon, r.lat) in got
        elif (np.abs(edge[:, 0] - r.lon) > 0.3).all() or (np.hypot(*(edge - [r.lon, r.lat]).T) > 0.3).all():
            assert ((r.lon, r.lat) in got) == inside(r.lon, r.lat)
    assert len(got) > 5000


def test_clip_of_several_polygons_and_no_cells(spark):
    cells = spark.sql("SELECT x.id * 1.0D AS lon, y.id * 1.0D AS lat FROM range(6) x JOIN range(6) y ON true")
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    assert C.clip(cells, [square(0.8, 1.2), [square(2.6, 5.6), square(3.4, 4.6)]], 1.0, 1.0).count() == 1 + 8
    assert C.clip(cells, [[square(-9.0, 9.0), square(-8.0, 8.0)]], 1.0, 1.0).count() == 0
    assert C.clip(cells.limit(0), [square(0.8, 1.2)], 1.0, 1.0).count() == 0


def test_whole_analysis(spark, tmp_path):
    rng = np.random.default_rng(0)
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(360)]
    wave = np.sin(np.arange(360) * 2 * np.pi / 30)
    rows = [(d, 10 + r * 0.5, 70 + c * 0.5, float(max(0, 3 + (2 * wave[k] if r < 3 else 0) + rng.normal()))) for k, d in enumerate(days) for r in range(6) for c in range(6)]
    cube = spark.createDataFrame(rows, "time date, lat double, lon double, rainfall double")
    cfg = analysis.Config(window=30, months=None, ks=range(2, 6), surrogates=9, trend_periods=[(2000, 2001)], heatmap_periods=[(2000, 2000)])
    got = analysis.run_pipeline(spark, cube, cfg, str(tmp_path))
    assert got["heatmap"].count() == 36
    assert got["communities"].count() == 36
    assert got["rqa"].select("win").distinct().count() == (360 - 180) // 30 + 1
    assert {"det_rank_sig", "lam_surr_low", "entr_med"} <= set(got["rqa"].columns)
    assert {r.step: r.valid_cells for r in got["figures"].collect()} == {"read": 36}
    cells = got["period_cells"].toPandas()
    assert len(cells) == 11 * 11 and set(cells.period) == {"2000-2000"} and cells.rf.between(0, 1).all()
    shapes = got["outlines"].toPandas()
    assert shapes.cells.sum() == 36 and shapes.area.sum() == pytest.approx(36 * 0.25)
    files = spark.read.csv(f"{tmp_path}/series_csv", header=True)
    assert files.where("time = 'MK_full' AND metric = 'det'").count() == shapes.shape[0] and {"community", "metric", "mk_p"} <= set(files.columns)
    assert got["limits"].where("low <= high").count() == 7
    assert {r.metric for r in got["trends"].select("metric").distinct().collect()} == {*analysis.METRICS, *analysis.RAIN}


def test_presets():
    assert analysis.preset("OND_full").window == 91
    with pytest.raises(ValueError):
        analysis.preset("summer_full")
