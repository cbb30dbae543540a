"""Operators that part a grid into tiles or triangles, against the whole grid at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import grid as G


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["win", "cell", "row", "col"])).withColumns({c: F.col(c).cast("int") for c in ("row", "col")})


@pytest.mark.parametrize("moves, share", [(G.QUEEN, 0.4), (G.ROOK, 0.6)])
def test_tiled_components(spark, monkeypatch, moves, share):
    monkeypatch.setattr(G, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(w, (r + 7) * 1000 + c, r, c) for w in range(2) for r in range(-7, 50) for c in range(61) if rng.random() < share]
    cells = frame(spark, rows)
    got = G.components(cells, ["win"], 2, moves, tile=4)
    want = G.components(cells, ["win"], 2, moves)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.groupBy("win", "comp").count().agg(F.max("count")).first()[0] > 100


def test_one_part_over_all_tiles_and_none(spark):
    snake = [(0, r * 100 + c, r, c) for r in range(40) for c in range(40) if r % 2 == 0 or c == (39 if r % 4 == 1 else 0)]
    got = G.tiled_components(frame(spark, snake), ["win"], G.ROOK, 5)
    assert got.select("comp").distinct().count() == 1 and got.count() == len(snake)
    assert G.components(frame(spark, snake).limit(0), ["win"], 1, tile=5).count() == 0
    assert G.components(frame(spark, snake).drop("win"), [], 1, G.ROOK, tile=8).select("comp").distinct().count() == 1


def brute_triangles(have):
    """Triangles of three cells, of bridged gaps too."""
    out = []
    for r, c in {(r + a, c + b) for r, c in have for a in (-1, 0) for b in (-1, 0)}:
        a, b, e, f = (r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)
        out += [t for t, ok in (((a, b, f), True), ((a, e, f), True), ((b, e, f), a not in have), ((a, b, e), f not in have)) if ok and all(p in have for p in t)]
    for r, c in {(r, c + 1) for r, c in have} - set(have):
        n, s, w, e = (r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)
        out += [(w, e, v) for v in (n, s)] if all(p in have for p in (n, s, w, e)) else []
    return out


@pytest.mark.parametrize("factor, reach", [(2, 1.0), (4, 1.0), (3, 0.5)])
def test_triangulated(spark, factor, reach):
    rng = np.random.default_rng(factor)
    have = {(r, c): float(rng.normal()) for r in range(9) for c in range(9) if (r, c) not in {(1, 1), (2, 7), (3, 7), (4, 4), (0, 5), (8, 8), (6, 2)}}
    cells = spark.createDataFrame([(k, r, c, v * (k + 1)) for k in range(2) for (r, c), v in have.items()], "period int, row int, col int, value double")
    got = {(r.period, r.y, r.x): r.value for r in G.triangulated(cells, factor, ("period",), reach).collect()}
    want = {}
    for t in brute_triangles(have):
        m = np.array([[*p, 1.0] for p in t]).T
        for y in range(min(p[0] for p in t) * factor, max(p[0] for p in t) * factor + 1):
            for x in range(min(p[1] for p in t) * factor, max(p[1] for p in t) * factor + 1):
                w = np.linalg.solve(m, [y / factor, x / factor, 1.0])
                near = min(np.hypot(y / factor - r, x / factor - c) for r, c in have)
                if w.min() > -1e-9 and near <= reach + 1e-12:
                    want[y, x] = float(sum(a * have[p] for a, p in zip(w, t)))
    for r, c in have:  # edges of adjacent cells, in a triangle or not
        for a, b in ((0, 1), (1, 0)):
            for k in range(factor + 1) if (r + a, c + b) in have else []:
                if min(k, factor - k) / factor <= reach:
                    want[r * factor + a * k, c * factor + b * k] = have[r, c] + (have[r + a, c + b] - have[r, c]) * k / factor
    assert {k[1:] for k in got} == set(want) and len(got) == 2 * len(want)
    assert all(v == pytest.approx(want[k[1:]] * (k[0] + 1), abs=1e-9) for k, v in got.items())
    at = {(r, c): have[r, c] for r, c in have}
    assert all(got[0, r * factor, c * factor] == pytest.approx(v) for (r, c), v in at.items())
