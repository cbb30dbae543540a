"""The analysis on a field whose communities, dryness and trends are known, and surrogates against naive steps."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels
from isohyet.operators import cube as C
from isohyet.operators import recurrence as R
from isohyet.operators.hold import hold
from isohyet.plans import analysis

SIDE, DAYS = 10, 720
PATCH = {(r, c) for r in (3, 4, 5) for c in (3, 4, 5)}


def naive_surrogate(x, rng, rounds):
    """Channels keep their sorted values; spectra by explicit sums of waves, ranks by sorting."""
    n, channels = x.shape
    f, t = np.arange(n // 2 + 1), np.arange(n)
    wave = np.exp(-2j * np.pi * np.outer(f, t) / n)
    weight = np.where((f == 0) | ((n % 2 == 0) & (f == n // 2)), 1.0, 2.0)
    spectrum = wave @ x

    def back(size, phase):
        return np.array([sum(w * a * np.cos(p + 2 * np.pi * k * i / n) for k, w, a, p in zip(f, weight, size, phase)) for i in t]) / n

    def ranked(phase):
        out = np.empty_like(x)
        for c in range(channels):
            s = back(np.abs(spectrum[:, c]), phase + np.angle(spectrum[:, c]) - np.angle(spectrum[:, 0]))
            out[np.argsort(s, kind="stable"), c] = np.sort(x[:, c])
        return out

    y = ranked(rng.uniform(-np.pi, np.pi, (len(f), 1))[:, 0])
    for _ in range(rounds):
        y = ranked(np.angle(wave @ y[:, 0]))
    return y


def test_surrogate_metrics(spark):
    x = np.random.default_rng(2).normal(size=(21, 3)).cumsum(0)
    state = spark.createDataFrame([(4, i, v.tolist()) for i, v in enumerate(x)], "win int, i int, x array<double>")
    got = {r.surr: r for r in R.surrogates(state, 3, 0.2, 1, True, rounds=4, batch=2).collect()}
    assert sorted(got) == [0, 1, 2]
    for k, r in got.items():
        y = naive_surrogate(x, np.random.default_rng([4, k]), 4)
        assert np.allclose(np.sort(y, 0), np.sort(x, 0))
        want = kernels.line_metrics(kernels.recurrence(y, 0.2, 1))
        assert all(r[m] == pytest.approx(v, abs=1e-9) for m, v in want.items())


def test_surrogate_rounds_turn_the_first_channel_only(monkeypatch):
    """20 rounds cost 20 turns of one channel for all surrogates and one turn of all channels for each."""
    x = np.random.default_rng(2).normal(size=(40, 16)).cumsum(0)
    turned, irfft = [], np.fft.irfft
    monkeypatch.setattr(np.fft, "irfft", lambda a, *more, **named: turned.append(a.shape[1]) or irfft(a, *more, **named))
    many = list(kernels.iaafts(x, [np.random.default_rng([4, k]) for k in range(5)], 20))
    assert sum(turned) == 20 * 5 + 5 * 16
    assert all(np.array_equal(y, kernels.iaaft(x, np.random.default_rng([4, k]), 20)) for k, y in enumerate(many))


def test_surrogates_are_dealt_out_by_parts(spark):
    """A window's parts are few bytes, but not one task."""
    rows = [(w, i, v.tolist()) for w in range(4) for i, v in enumerate(np.random.default_rng(w).normal(size=(20, 3)))]
    state = spark.createDataFrame(rows, "win int, i int, x array<double>").coalesce(1)
    got = R.surrogates(state, 6, 0.2, 1, rounds=2, batch=1).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 24 and len({r.task for r in got}) > 1


@pytest.fixture(scope="module")
def found(spark):
    """The cells of a patch share a wave of 20 days, all others are noise."""
    rng = np.random.default_rng(5)
    t = np.arange(DAYS)
    first = datetime.date(2000, 1, 1)
    rows = []
    for r in range(SIDE):
        for c in range(SIDE):
            v = 10 + rng.normal(size=DAYS) + (5 * np.sin(2 * np.pi * t / 20) if (r, c) in PATCH else 0)
            rows += [(first + datetime.timedelta(int(k)), 10 + r * 0.5, 70 + c * 0.5, float(x)) for k, x in zip(t, v)]
    cube = spark.createDataFrame(rows, "time date, lat double, lon double, rainfall double")
    cfg = analysis.Config(window=60, months=None, ks=range(2, 5), surrogates=9, trend_periods=[(2000, 2001)], heatmap_periods=[(2000, 2000)], sc_threshold=0.5, min_community_size=5, least_cluster=0.05)
    p = analysis.prepare(cube, cfg)
    heat = hold(analysis.heatmap(p["z"], p["cells"], cfg))
    labels = analysis.communities(heat, p["cells"], p["z"], cfg)
    return cfg, p, heat, labels


def test_heatmap_is_hot_where_cells_share_a_wave(found):
    cfg, p, heat, _ = found
    got = {(r.row, r.col): r.n or 0 for r in heat.join(p["cells"], "cell").collect()}
    assert len(got) == SIDE**2
    assert {k for k, n in got.items() if n > 0} == PATCH


def test_communities_are_the_planted_ones(found):
    _, p, _, labels = found
    got = {(r.row, r.col): r.rank for r in labels.join(p["cells"], "cell").collect()}
    assert len(got) == SIDE**2
    # The majority of nine cells takes the patch's corners away.
    inner = {k for k in PATCH if 4 in k}
    own = {got[k] for k in inner}
    assert len(own) == 1 and {k for k, r in got.items() if r in own} == inner


def test_surrogate_columns_are_the_surrogates_percentiles(spark, found):
    cfg, p, _, labels = found
    series = hold(analysis.recurrence_series(p["z"], labels, cfg))
    one = series.orderBy("community", "win").first()
    state = analysis.state_series(p["z"], labels).where(F.col("community") == one.community)
    pos = state.select("time").distinct().toPandas().time.sort_values().tolist()
    rows = sorted(state.collect(), key=lambda r: r.time)
    i = one.win * cfg.window
    x = np.array([r.x for r in rows[i : i + 6 * cfg.window]])
    curves = R.lag_percentiles(spark.createDataFrame([(0, k, r.x) for k, r in enumerate(rows)], "community int, i int, x array<double>"), 90, keys=("community",))
    theiler = R.theiler_windows(curves, ["community"]).first().theiler
    assert len(pos) == DAYS and one.time == rows[i + 3 * cfg.window].time
    want = kernels.line_metrics(kernels.recurrence(x, cfg.q, theiler))
    surr = [kernels.line_metrics(kernels.recurrence(kernels.iaaft(x, np.random.default_rng([int(one.community), int(one.win), k])), cfg.q, theiler)) for k in range(9)]
    for m in analysis.METRICS:
        values = [s[m] for s in surr]
        assert one[m] == pytest.approx(want[m], abs=1e-9)
        assert (one[f"{m}_surr_low"], one[f"{m}_surr_high"]) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])), abs=1e-9)
        assert one[f"{m}_p"] == pytest.approx((sum(v >= want[m] for v in values) + 1) / 10)


def test_rain_and_trend(spark, found):
    cfg, p, _, labels = found
    rain = analysis.rain_series(p["cube"], labels, cfg).toPandas()
    cells = p["cube"].join(labels.select("cell", F.col("rank").alias("community")), "cell").groupBy("community", "time").agg(F.avg("value").alias("m")).toPandas().sort_values("time")
    for r in rain.itertuples():
        mine = cells[cells.community == r.community].m.to_numpy()[r.win * 60 : r.win * 60 + 360]
        assert r.rain == pytest.approx(np.median(mine)) and r.dry_fraction == 0
    rising = spark.createDataFrame([(1, datetime.date(2000 + k, 7, 1), 1.0 + 0.5 * k + 0.01 * (-1) ** k) for k in range(12)], "community int, time date, det double")
    t = {r.period: r for r in analysis.trends(rising, ["det"], analysis.Config(trend_periods=[(2000, 2006)])).collect()}
    assert t["full"].slope == pytest.approx(0.5, abs=0.01) and t["full"].trend == "increasing" and t["2000-2006"].slope == pytest.approx(0.5, abs=0.01)
    assert C.valid_cells(p["cube"]).first()[0] == SIDE**2
