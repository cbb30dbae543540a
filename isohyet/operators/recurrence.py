"""Recurrence analysis of windows of a multivariate series, from pairs to line metrics.

State tables have (win, i, x): the window, the row's place in it, and its features. One window is one group, so the
work is windows times squared window size, whatever the series' length, and a task holds one window's distances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions import kernels


def by_group(df: DataFrame, keys, f, schema: str) -> DataFrame:
    """Grouped map f(key values, pandas frame) -> pandas frame, for keys that are kept in front."""
    kinds = dict(df.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        at = {k: t[k].iloc[0] for k in keys}
        out = f(at, t)
        for n, k in enumerate(keys):
            out.insert(n, k, pd.Series([at[k]] * len(out), index=out.index, dtype=object))
        return out

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def vectors(t: pd.DataFrame) -> np.ndarray:
    """Features of a group's rows in order of their place; None counts as missing."""
    return np.array([np.asarray(v, float) for v in t.sort_values("i").x])


def recurrent(t: pd.DataFrame, q: float | None, theiler: int, cosine: bool, eps: float | None) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(places, limit, recurrence matrix) of a window, or None if no two rows are far enough apart in time."""
    i = np.sort(t.i.to_numpy())
    d = kernels.distances(vectors(t), cosine)
    off = np.abs(i[:, None] - i[None]) > (int(t.theiler.iloc[0]) if "theiler" in t else theiler)
    if not off.any():
        return None
    limit = float(np.quantile(d[off], q)) if eps is None else float(eps)
    return i, limit, (d <= limit) & off


def recurrences(state: DataFrame, q: float | None = 0.1, theiler: int = 0, cosine: bool = True, eps: float | None = None, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, i, j, eps): pairs with |i - j| > theiler whose distance is at most eps, or the window's q quantile of them.

    One window is one group: its distances are a matrix product, and only recurrent pairs leave the task. Missing
    features count as 0; the cosine distance raises each by 1e-6. Distances have 9 decimals and include their limit. A
    column theiler of the state overrides the parameter.
    """

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        found = recurrent(t, q, theiler, cosine, eps)
        if not found:
            return pd.DataFrame({"i": [], "j": [], "eps": []})
        i, limit, r = found
        a, b = np.nonzero(r)
        return pd.DataFrame({"i": i[a], "j": i[b], "eps": np.full(len(a), limit)})

    return by_group(state, keys, run, "i int, j int, eps double")


def line_histograms(state: DataFrame, q: float | None = 0.1, theiler: int = 0, cosine: bool = True, eps: float | None = None, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, kind, len, n): how many diagonal and vertical lines of each length the recurrences have.

    The lines are counted where the window's matrix is, so a few rows leave the task in place of all pairs.
    """

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        found = recurrent(t, q, theiler, cosine, eps)
        if not found:
            return pd.DataFrame({"kind": [], "len": [], "n": []})
        i, _, r = found
        if i[-1] - i[0] + 1 > len(i):  # missing rows break lines
            whole = np.zeros((i[-1] - i[0] + 1,) * 2, bool)
            whole[np.ix_(i - i[0], i - i[0])] = r
            r = whole
        each = [(kind, *np.unique(kernels.line_lengths(r, kind == "diag"), return_counts=True)) for kind in ("diag", "vert")]
        return pd.DataFrame({"kind": [k for k, x, _ in each for _ in x], "len": np.concatenate([x for _, x, _ in each]), "n": np.concatenate([c for *_, c in each])})

    return by_group(state, keys, run, "kind string, len long, n long")


def epsilons(state: DataFrame, q: float = 0.1, theiler: int = 0, cosine: bool = True, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, eps): the q quantile of each window's distances."""

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        i = np.sort(t.i.to_numpy())
        off = np.abs(i[:, None] - i[None]) > theiler
        return pd.DataFrame({"eps": [float(np.quantile(kernels.distances(vectors(t), cosine)[off], q))] if off.any() else []})

    return by_group(state, keys, run, "eps double")


def runs(rec: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, kind, line, len): runs along diagonals (kind diag) and columns (kind vert)."""
    cells = rec.select(*keys, F.explode(F.array(
        F.struct(F.lit("diag").alias("kind"), (F.col("j") - F.col("i")).alias("line"), F.col("i").alias("at")),
        F.struct(F.lit("vert").alias("kind"), F.col("j").alias("line"), F.col("i").alias("at")),
    )).alias("c")).select(*keys, "c.*")
    island = F.col("at") - F.row_number().over(Window.partitionBy(*keys, "kind", "line").orderBy("at"))
    return cells.withColumn("g", island).groupBy(*keys, "kind", "line", "g").agg(F.count("*").alias("len")).drop("g")


def line_metrics(rec: DataFrame, size: int, least: int = 2, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """The metrics of pairs, from their runs. See histogram_metrics()."""
    return histogram_metrics(runs(rec, keys).groupBy(*keys, "kind", "len").agg(F.count("*").alias("n")), size, least, keys)


def histogram_metrics(lens: DataFrame, size: int, least: int = 2, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, kind, len, n) -> det, lam, entr, lmean, div, det_lam and rr of each window that has a recurrence."""
    diag, long = F.col("kind") == "diag", F.col("len") >= least
    points = F.col("n") * F.col("len")
    pick = lambda test, x: F.coalesce(F.sum(F.when(test, x)), F.lit(0))
    total = F.sum(F.when(diag & long, F.col("n"))).over(Window.partitionBy(*keys))
    p = F.col("n") / total
    lens = lens.withColumn("h", F.when(diag & long, -p * F.log(p + 1e-8)))
    scale = float(np.log(size - 1)) if size > 2 else 1.0
    out = lens.groupBy(*keys).agg(
        (pick(diag & long, points) / (pick(diag, points) + 1e-8)).alias("det"),
        (pick(~diag & long, points) / (pick(~diag, points) + 1e-8)).alias("lam"),
        (F.coalesce(F.sum("h"), F.lit(0.0)) / scale).alias("entr"),
        F.coalesce(pick(diag & long, points) / F.nullif(pick(diag & long, F.col("n")), F.lit(0)), F.lit(0.0)).alias("lmean"),
        F.coalesce(1 / (F.max(F.when(diag & (F.col("len") >= 2), F.col("len"))) + 1e-8), F.lit(0.0)).alias("div"),
        (pick(diag, points) / float(size * size)).alias("rr"),
    )
    return out.withColumn("det_lam", F.col("det") / (F.col("lam") + 1e-8))


def diagonal_histogram(rec: DataFrame, least: int = 2, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    return runs(rec, keys).where((F.col("kind") == "diag") & (F.col("len") >= least)).groupBy(*keys, "len").agg(F.count("*").alias("n"))


def nulled(df: DataFrame, metrics: list[str]) -> DataFrame:
    """A metric of 0 counts as missing."""
    return df.withColumns({m: F.nullif(F.col(m), F.lit(0.0)) for m in metrics})


def zero_counts(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(m) == 0).alias(m) for m in metrics])


def lag_percentiles(state: DataFrame, most: int, cosine: bool = True, percentiles=(1, 10, 50, 90, 99), keys: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """(keys, dt, p1 ...): percentiles of the distances of rows dt apart, dt from 1 to most.

    The series is cut into blocks of places; a row also goes to the block before it if it stands within reach of that.
    Cosine distances are clamped to 0 to 2 and left out up to 1e-5.
    """
    at = F.floor(F.col("i") / block)
    near = F.when((F.col("i") % block < most) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    rows = state.select(*keys, "i", "x", F.explode(near).alias("__b"))

    def run(key: dict, t: pd.DataFrame) -> pd.DataFrame:
        lag, d = kernels.lag_distances(vectors(t), np.sort(t.i.to_numpy()), most, (int(key["__b"]) + 1) * block, cosine)
        keep = d > 1e-5 if cosine else np.ones(len(d), bool)
        return pd.DataFrame({"dt": lag[keep], "d": d[keep]})

    got = by_group(rows, (*keys, "__b"), run, "dt int, d double").groupBy(*keys, "dt").agg(F.percentile("d", F.array(*[F.lit(p / 100) for p in percentiles])).alias("p"))
    return got.select(*keys, "dt", *[F.col("p")[k].alias(f"p{p}") for k, p in enumerate(percentiles)])


def theiler_windows(curves: DataFrame, keys: list[str], within: int = 30) -> DataFrame:
    """(keys, theiler): knee of the 90th percentile curve up to `within`, else the last lag there.

    With fewer than 3 points of the curve, or of its part up to `within`, the last lag of all.
    """

    def cut(key: dict, t: pd.DataFrame) -> pd.DataFrame:
        last = int(t.dt.max())
        t = t.dropna(subset=["p90"]).sort_values("dt")
        near = t[t.dt <= within]
        at = last
        if len(near) >= 3:
            y = (near.p90 - t.p90.min()) / (t.p90.max() - t.p90.min() + 1e-10)
            knee = kernels.kneedle(near.dt.to_numpy(), y.to_numpy())
            at = int(near.dt.iloc[-1] if knee is None else knee)
        return pd.DataFrame({"theiler": [at]})

    return by_group(curves, keys, cut, "theiler int")


def surrogates(state: DataFrame, count: int = 99, q: float = 0.1, theiler: int = 0, cosine: bool = True, rounds: int = 20, batch: int = 11, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, surr, det, lam, entr, lmean) of seeded IAAFT surrogates; a task takes some surrogates of one window.

    A column theiler of the state overrides the parameter. Keys are whole numbers, which seed the surrogates.
    """
    kinds = dict(state.dtypes)
    tw = F.max("theiler") if "theiler" in kinds else F.lit(theiler)
    parts = F.explode(F.sequence(F.lit(0), F.lit((count - 1) // batch)))
    packed = state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("rows"), tw.alias("tw")).withColumn("part", parts)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        at = {k: int(t[k].iloc[0]) for k in keys}
        part = int(t.part.iloc[0])
        x = np.array([np.asarray(v, float) for v in t.rows.iloc[0]])
        mine = range(part * batch, min(count, (part + 1) * batch))
        out = []
        for k, y in zip(mine, kernels.iaafts(x, [np.random.default_rng([*at.values(), k]) for k in mine], rounds)):
            out.append(at | {"surr": k} | kernels.line_metrics(kernels.recurrence(y, q, int(t.tw.iloc[0]), cosine)))
        return pd.DataFrame(out)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", surr int, det double, lam double, entr double, lmean double"
    # A window is little data and much work, so parts are dealt out by a number of tasks, which no join of small ones undoes.
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed.repartition(tasks, *keys, "part").groupBy(*keys, "part").applyInPandas(run, schema)


def rank_test(observed: DataFrame, surr: DataFrame, value: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """(keys, value, low, high, p, significant): 2.5 and 97.5 percentiles of the surrogates and the one-sided rank p."""
    both = observed.select(*keys, value).join(surr.select(*keys, F.col(value).alias("__s")), keys)
    got = both.groupBy(*keys, value).agg(F.percentile("__s", F.array(F.lit(0.025), F.lit(0.975))).alias("__b"), ((F.count_if(F.col("__s") >= F.col(value)) + 1) / (F.count("__s") + 1)).alias("p"))
    return got.select(*keys, value, F.col("__b")[0].alias("low"), F.col("__b")[1].alias("high"), "p", (F.col("p") <= alpha).alias("significant"))
