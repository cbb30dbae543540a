"""Spectra and concentration of series (keys, i, v), and the relevant cells of loadings (keys, pc, cell, a)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions import kernels
from isohyet.operators.grid import components
from isohyet.operators.hold import hold
from isohyet.operators.recurrence import by_group


def power(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, p): spectrum of each whole series by sums of sines and cosines, inner bins twice, at most 1."""
    size = F.col("__n")
    each = series.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    each = each.withColumn("f", F.explode(F.sequence(F.lit(0), F.floor(size / 2).cast("int"))))
    angle = F.lit(2 * math.pi) / size * F.pmod(F.col("f") * F.col("i"), size)
    s = each.groupBy(*keys, "f", "__n").agg(F.sum(F.col("v") * F.cos(angle)).alias("c"), F.sum(F.col("v") * F.sin(angle)).alias("s"))
    p = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) / size * F.when((F.col("f") > 0) & (F.col("f") < F.floor(size / 2)), 2.0).otherwise(1.0)
    top = F.max("p").over(Window.partitionBy(*keys))
    return s.withColumn("p", p).withColumn("p", F.col("p") / F.when(top == 0, 1.0).otherwise(top)).select(*keys, "f", "p")


def concentration(spectrum: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, peak, left, right, sc): the band of half height around the peak and its share of the power."""
    w = Window.partitionBy(*keys)
    p = spectrum.withColumn("p", F.round("p", digits))
    p = p.withColumns({"peak": F.max_by("f", F.struct("p", -F.col("f"))).over(w), "top": F.max("p").over(w), "last": F.max("f").over(w)})
    low = (F.col("p") < F.col("top") / 2) | (F.col("f") == 0) | (F.col("f") == F.col("last"))
    left = F.max(F.when(low & (F.col("f") < F.col("peak")), F.col("f"))).over(w)
    right = F.min(F.when(low & (F.col("f") > F.col("peak")), F.col("f"))).over(w)
    p = p.withColumns({"left": F.coalesce(left + 1, F.col("peak")), "right": F.coalesce(right - 1, F.col("peak"))})
    inside = F.sum(F.when(F.col("f").between(F.col("left"), F.col("right")), F.col("p")))
    return p.groupBy(*keys, "peak", "left", "right").agg(F.when(F.sum("p") > 0, inside / F.sum("p")).otherwise(0.0).alias("sc"))


def threshold_curve(values: DataFrame, column: str = "sc", base: float = 0.0) -> DataFrame:
    """(t, n, fraction): for each distinct value from base on, and 1.0, how many values exceed it.

    Counts come from running sums over the distinct values, not from a range join.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("t")).agg(F.count("*").alias("k"))
    one = values.sparkSession.range(1).select(F.lit(1.0).alias("t"), F.lit(0).cast("long").alias("k"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("t"))
    n = F.coalesce(F.sum("k").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("k").over(w.rangeBetween(0, 0))
    every = Window.partitionBy(F.lit(0))
    return counts.unionByName(one).withColumns({"n": n, "all": F.sum("k").over(every)}).where(F.col("t") >= base).select("t", "n", (F.col("n") / F.col("all")).alias("fraction"))


def relevant(loadings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell): cells whose absolute loading on some component exceeds 3 times the spread of the absolute loadings."""
    sd = F.stddev_pop(F.abs("a")).over(Window.partitionBy(*keys, "pc"))
    return loadings.withColumn("sd", sd).where(F.abs("a") > 3 * F.col("sd")).select(*keys, "cell").distinct()


#: Cells of a tile are so many rows and columns; a tile of one window is one group.
TILE = 32


def tile(df: DataFrame) -> Column:
    """The tile of a cell, by place or, without places, by ranges of its id."""
    if "row" in df.columns:
        return F.floor(F.col("row") / TILE) * (1 << 32) + F.floor(F.col("col") / TILE)
    return F.floor(F.col("cell") / (TILE * TILE))


def packed(matrix: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cell, [row, col,] i, z) -> (keys, cells, rows, cols, z): each tile's cell x time matrix as one row. Missing values count as 0."""
    place = "row" in matrix.columns

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        cells, r = np.unique(t.cell.to_numpy(), return_inverse=True)
        b = np.zeros((len(cells), int(t.i.max()) + 1))
        b[r, t.i.to_numpy()] = np.nan_to_num(t.z.to_numpy(float))
        first = np.unique(r, return_index=True)[1]
        rows, cols = (t[c].to_numpy()[first] if place else np.zeros(len(cells), int) for c in ("row", "col"))
        return pd.DataFrame({"cells": [cells], "rows": [rows.astype(np.int32)], "cols": [cols.astype(np.int32)], "z": [b.tobytes()]})

    tiles = matrix.where(F.col("i").isNotNull()).withColumn("__tile", tile(matrix))
    return by_group(tiles, (*keys, "__tile"), run, "cells array<long>, rows array<int>, cols array<int>, z binary").drop("__tile")


def tile_matrix(r) -> np.ndarray:
    return np.frombuffer(r.z).reshape(len(r.cells), -1)


def kept_keys(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def per_tile(tiles: DataFrame, keys: tuple[str, ...], f, schema: str) -> DataFrame:
    """f(tile) -> dict of equally long columns, for each tile on its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for r in t.itertuples():
                out = f(r)
                n = len(next(iter(out.values())))
                yield pd.DataFrame({k: pd.Series([getattr(r, k)] * n, dtype=object) for k in keys} | out)

    return tiles.mapInPandas(run, f"{kept_keys(tiles, keys)}, {schema}")


def gram(tiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i, j, g), i <= j: products of times over all cells, summed from tile to tile."""

    def products(r) -> dict:
        b = tile_matrix(r)
        i, j = np.triu_indices(b.shape[1])
        return {"i": i, "j": j, "g": (b.T @ b)[i, j]}

    return per_tile(tiles, keys, products, "i int, j int, g double").groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


#: Components below this share of the largest eigenvalue are left out: the products of times don't tell them from zero.
VANISHING = 1e-12


def axes(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time x PC, share, spectral concentration) from a window's products of times; its size is the window's alone."""
    n = int(t.j.max()) + 1
    g = np.zeros((n, n))
    g[t.i, t.j] = g[t.j, t.i] = t.g
    lam, v = np.linalg.eigh(g)
    lam, v = lam[::-1], v[:, ::-1]
    keep = lam > VANISHING * lam[0] if lam[0] > 0 else np.zeros(n, bool)
    lam, v = lam[keep], v[:, keep]
    sc = np.array([kernels.half_height(p)[0] for p in kernels.power_spectrum(math.sqrt(n) * v.T)]) if len(lam) else np.zeros(0)
    return v, lam / max(lam.sum(), 1e-300), sc


def svd_by_window(matrix: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, cell, i, z) -> (keys, pc, share, sc): each component's share of variance and spectral concentration."""

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        _, share, sc = axes(t)
        return pd.DataFrame({"pc": np.arange(len(sc)), "share": share, "sc": sc})

    return by_group(gram(packed(matrix, keys), keys), keys, run, "pc int, share double, sc double")


def strong_axes(tiles: DataFrame, fixed: float | None, keys: tuple[str, ...]) -> DataFrame:
    """(keys, sc, v): concentrations and time vectors of the components that count, in one row for each window that has some.

    A component counts if its concentration is above the limit, the knee of the window's own curve unless one is fixed.
    """

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        v, _, sc = axes(t)
        strong = np.flatnonzero(sc > (kernels.sc_cutoff(sc) if fixed is None else fixed)) if len(sc) else []
        if not len(strong):
            return pd.DataFrame({"pcs": [], "sc": [], "v": []}, dtype=object)
        return pd.DataFrame({"pcs": [strong.astype(np.int32)], "sc": [sc[strong]], "v": [np.ascontiguousarray(v[:, strong] / math.sqrt(len(v))).tobytes()]})

    return by_group(gram(tiles, keys), keys, run, "pcs array<int>, sc array<double>, v binary")


def tile_loadings(r) -> np.ndarray:
    """cell x PC of a tile that has been joined with its window's axes."""
    b = tile_matrix(r)
    return b @ np.frombuffer(r.v).reshape(-1, len(r.sc))[: b.shape[1]]


def loadings(matrix: DataFrame, keys: tuple[str, ...] = ("win",)) -> DataFrame:
    """(keys, cell, i, z) -> (keys, cell, pc, sc, a): the loadings of all components; their signs are arbitrary."""
    tiles = hold(packed(matrix, keys))

    def each(r) -> dict:
        a = tile_loadings(r)
        n = len(r.sc)
        return {"cell": np.repeat(np.asarray(r.cells), n), "pc": np.tile(np.asarray(r.pcs), len(r.cells)), "sc": np.tile(np.asarray(r.sc), len(r.cells)), "a": a.reshape(-1)}

    return per_tile(tiles.join(strong_axes(tiles, -1.0, keys), list(keys)), keys, each, "cell long, pc int, sc double, a double")


def communities(matrix: DataFrame, fixed: float | None = None, keys: tuple[str, ...] = ("win",), side: int | None = None) -> DataFrame:
    """(keys, cell, row, col, i, z) -> (keys, comp, cell): spatially connected cells that load on concentrated components.

    A cell is hot if its absolute loading on some component exceeds 3 times the spread of all cells' there. Products of
    times are summed over tiles of the grid, a window's components come from these, and each tile is then multiplied
    with them: no group grows with the grid but that of a window's hot cells, unless a side of tiles for
    their components is given.
    """
    tiles = hold(packed(matrix, keys))
    strong = hold(strong_axes(tiles, fixed, keys))
    both = tiles.join(strong, list(keys))

    def sums(r) -> dict:
        a = np.abs(tile_loadings(r))
        return {"pc": np.arange(a.shape[1]), "n": np.full(a.shape[1], len(a)), "one": a.sum(0), "two": (a * a).sum(0)}

    m = per_tile(both, keys, sums, "pc int, n long, one double, two double").groupBy(*keys, "pc").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    spread = F.sqrt(F.greatest(F.col("two") / F.col("n") - F.pow(F.col("one") / F.col("n"), 2), F.lit(0.0)))
    limits = m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", (3 * spread).alias("limit")))), lambda s: s["limit"]).alias("limits"))

    def hot(r) -> dict:
        at = np.flatnonzero((np.abs(tile_loadings(r)) > np.asarray(r.limits)).any(1))
        return {"cell": np.asarray(r.cells)[at], "row": np.asarray(r.rows)[at], "col": np.asarray(r.cols)[at]}

    found = per_tile(both.join(limits, list(keys)), keys, hot, "cell long, row int, col int")
    return components(found, list(keys), 2, tile=side).select(*keys, "comp", "cell")
