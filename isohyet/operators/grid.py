"""Graphs and labels on a grid of cells (row, col): neighbours, components, heatmaps, clusters, smoothing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions import kernels
from isohyet.operators.hold import hold
from isohyet.operators.recurrence import by_group

QUEEN, ROOK = kernels.QUEEN, kernels.ROOK


def neighbours(cells: DataFrame, keys: list[str], moves=QUEEN) -> DataFrame:
    """(keys, cell, other): adjacent cells, by exploding the moves and an equi-join on integer places."""
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]))
    a = cells.select(*keys, "cell", "row", "col", to.alias("m")).select(*keys, "cell", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    return a.join(cells.select(*keys, "row", "col", F.col("cell").alias("other")), [*keys, "row", "col"]).select(*keys, "cell", "other")


def components(cells: DataFrame, keys: list[str], least: int = 2, moves=QUEEN, tile: int | None = None) -> DataFrame:
    """(keys, cell, comp): smallest cell of the connected part; parts below least are left out.

    Without a tile a grid is one group. For large grids give the side of tiles, and no group is larger than one. See tiled_components().
    """
    if tile:
        parts = tiled_components(cells, keys, moves, tile)
        if least <= 1:
            return parts
        large = parts.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
        return parts.join(large, [*keys, "comp"], "left_semi").select(*keys, "cell", "comp")
    kinds = dict(cells.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = local_parts(t, moves)[[*keys, "cell", "comp"]]
        return out[out.groupby("comp").cell.transform("size") >= least]

    return cells.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "cell"]) + f", comp {kinds['cell']}")


def local_parts(t: pd.DataFrame, moves) -> pd.DataFrame:
    t = t.sort_values("cell")
    return t.assign(comp=t.cell.to_numpy()[kernels.union_find(len(t), kernels.grid_edges(t.row.tolist(), t.col.tolist(), moves))])


#: Side of a tile of cells, for grids that have more cells than one.
TILE = 256
#: Tiles that meet in one group of the next level, along a side, and levels; the last level takes the whole grid.
FAN, LEVELS = 16, 3


def tiled_components(cells: DataFrame, keys: list[str], moves=QUEEN, tile: int = TILE) -> DataFrame:
    """(keys, cell, row, col) -> (keys, cell, comp): parts within tiles first, then parts that touch across borders are joined.

    Each level merges the borders within squares of FAN by FAN tiles of the level below, so a group holds what touches along
    the borders of one square, and the next level's tiles are these squares.
    """
    kinds = dict(cells.dtypes)
    kept = ", ".join(f"{k} {kinds[k]}" for k in keys)
    kept = kept + ", " if kept else ""
    at = cells.select(*keys, "cell", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))
    local = hold(at.groupBy(*keys, "tr", "tc").applyInPandas(lambda t: local_parts(t, moves), f"{kept}cell {kinds['cell']}, row int, col int, tr int, tc int, comp {kinds['cell']}"))
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = local.where(edge("row") | edge("col"))
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]))
    asked = border.withColumn("m", to).select(*keys, F.col("comp").alias("a"), F.col("tr").alias("tr0"), F.col("tc").alias("tc0"), (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    met = asked.join(border, [*keys, "row", "col"]).where("(tr0 <> tr OR tc0 <> tc) AND a < comp")
    pairs = hold(met.select(*keys, "tr0", "tc0", "tr", "tc", "a", F.col("comp").alias("b")).distinct())
    names = local.select(*keys, "cell", "comp")
    for level in range(1, LEVELS + 1):
        side = FAN**level
        square = (lambda c: F.floor(F.col(c) / side)) if level < LEVELS else (lambda c: F.lit(0))
        here = (square("tr0") == square("tr")) & (square("tc0") == square("tc"))

        def join(t: pd.DataFrame) -> pd.DataFrame:
            ids, both = np.unique(np.r_[t.a.to_numpy(), t.b.to_numpy()], return_inverse=True)
            root = ids[kernels.union_find(len(ids), zip(both[: len(t)].tolist(), both[len(t) :].tolist()))]
            moved = np.flatnonzero(root != ids)
            return pd.DataFrame({k: [t[k].iloc[0]] * len(moved) for k in keys} | {"old": ids[moved], "new": root[moved]})

        schema = f"{kept}old {kinds['cell']}, new {kinds['cell']}"
        grouped = pairs.where(here).withColumns({"__r": square("tr"), "__c": square("tc")}).groupBy(*keys, "__r", "__c")
        merged = hold(grouped.applyInPandas(join, schema))
        named = lambda df, c: df.join(merged.withColumnRenamed("old", c), [*keys, c], "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: B023, E731
        names = named(names, "comp")
        if level < LEVELS:
            pairs = hold(named(named(pairs.where(~here), "a"), "b").where("a <> b").distinct())
    return names.select(*keys, "cell", "comp")


def sizes(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "comp").agg(F.count("*").alias("size"))


def size_figures(s: DataFrame) -> DataFrame:
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("size") == 2).alias("pairs"), F.count_if(F.col("size") >= 10).alias("large"), F.percentile("size", F.lit(0.5)).alias("median"), F.max("size").alias("largest"))


def size_ccdf(s: DataFrame) -> DataFrame:
    """(s, fraction): share of parts of size s or more, for whole numbers from 3 to the largest, by running counts."""
    each = s.groupBy("size").agg(F.count("*").alias("k"))
    span = s.agg(F.max("size").alias("m")).where("m >= 3").select(F.explode(F.sequence(F.lit(3).cast("long"), "m")).alias("size"), F.lit(0).cast("long").alias("k"))
    all_ = each.unionByName(span).groupBy("size").agg(F.sum("k").alias("k"))
    w = Window.partitionBy(F.lit(0))
    n = F.sum("k").over(w.orderBy(F.desc("size")))
    return all_.withColumn("fraction", n / F.sum("k").over(w)).where("size >= 3").select(F.col("size").alias("s"), "fraction")


def heatmap(parts: DataFrame, cells: DataFrame, windows: DataFrame, least: DataFrame | int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cell, n, fraction): windows in which the cell is in a part of at least `least` cells; none is null.

    windows has (keys, win) of all windows, parts or not; least is a number or a table (keys, least).
    """
    keys = list(keys)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "win", "comp"))
    sized = parts.withColumn("__s", size)
    if isinstance(least, DataFrame):
        sized = sized.join(least, keys) if keys else sized.crossJoin(least)
    else:
        sized = sized.withColumn("least", F.lit(int(least)))
    n = sized.where(F.col("__s") >= F.col("least")).groupBy(*keys, "cell").agg(F.countDistinct("win").alias("n"))
    total = windows.groupBy(*keys).agg(F.countDistinct("win").alias("__w")) if keys else windows.agg(F.countDistinct("win").alias("__w"))
    every = cells.select("cell").crossJoin(total)  # one row for each cell and period
    return every.join(n, [*keys, "cell"], "left").withColumn("fraction", F.col("n") / F.col("__w")).drop("__w")


def least_sizes(s: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, least): smallest size of communities by the knee of their size distribution, from a short histogram."""
    hist = s.groupBy(*keys, "size").agg(F.count("*").alias("k"))
    at = keys or ("__g",)
    hist = hist if keys else hist.withColumn("__g", F.lit(0))
    got = by_group(hist, at, lambda key, t: pd.DataFrame({"least": [kernels.min_community_size(t["size"].to_numpy(), t.k.to_numpy())]}), "least int")
    return got.select(*keys, "least")


def q_statistic(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, label) -> (keys, n, sst, ssw, q, df1, df2, f, lam, p): share of variance between labels and its test."""
    g = values.groupBy(*keys, "label").agg(F.count("z").alias("m"), (F.var_pop("z") * F.count("z")).alias("w"))
    whole = values.groupBy(*keys).agg(F.count("z").alias("n"), (F.var_pop("z") * F.count("z")).alias("sst")) if keys else values.agg(F.count("z").alias("n"), (F.var_pop("z") * F.count("z")).alias("sst"))
    inner = g.groupBy(*keys).agg(F.sum("w").alias("ssw"), F.count("*").alias("__l")) if keys else g.agg(F.sum("w").alias("ssw"), F.count("*").alias("__l"))
    j = whole.join(inner, keys) if keys else whole.withColumn("__k", F.lit(1)).join(inner.withColumn("__k", F.lit(1)), "__k").drop("__k")
    q = F.when(F.col("sst") == 0, 0.0).otherwise(F.least(F.greatest(1 - F.col("ssw") / F.col("sst"), F.lit(0.0)), F.lit(1.0)))
    j = j.withColumns({"q": q, "df1": F.col("__l") - 1, "df2": F.col("n") - F.col("__l")})
    flat, few = F.col("sst") == 0, (F.col("df1") <= 0) | (F.col("df2") <= 0)
    nan, infinite = F.lit(float("nan")), F.lit(float("inf"))
    f = F.when(flat, 0.0).when(few, nan).when(F.col("q") >= 1, infinite).otherwise(F.col("df2") / F.col("df1") * F.col("q") / F.nullif(1 - F.col("q"), F.lit(0.0)))
    lam = F.when(flat, 0.0).when(few, nan).when(F.col("ssw") == 0, 0.0).otherwise((F.col("sst") - F.col("ssw")) / (2 * F.nullif(F.col("ssw"), F.lit(0.0)) / F.col("df2")))

    @F.pandas_udf("double")
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernels.f_tail(x, m, n) for x, m, n in zip(f, a, b)], dtype=float)

    p = F.when(flat, 1.0).when(few, nan).when(F.col("q") >= 1, 0.0).otherwise(tail(F.coalesce("f", F.lit(1.0)), F.greatest("df1", F.lit(1)), F.greatest("df2", F.lit(1))))
    return j.withColumns({"f": f, "lam": lam}).withColumn("p", p).drop("__l")


#: Cells of a cluster at least (fixed value).
LEAST = 5
CONFIGS = [("ward", "euclidean"), ("average", "euclidean"), ("average", "manhattan"), ("complete", "euclidean"), ("complete", "manhattan")]


def grid_features(grid) -> tuple[pd.DataFrame, np.ndarray]:
    """The cells of a collected grid, and value, row and col of each, scaled."""
    g = pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in grid])
    x = g[["value", "row", "col"]].to_numpy(float)
    sd = x.std(0)
    return g, (x - x.mean(0)) / np.where(sd == 0, 1, sd)


def collected(cells: DataFrame) -> DataFrame:
    """One row: all cells with values, in order. One clustering needs the whole grid, so it is one group."""
    return cells.agg(F.array_sort(F.collect_list(F.struct("cell", "row", "col", "value"))).alias("grid"))


def merge_trees(cells: DataFrame, configs=CONFIGS, connectivity: str = "queen") -> DataFrame:
    """(cell, row, col, value) -> (linkage, metric, a, b, d): the merges of each configuration's tree, in order; a task builds one tree."""
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("linkage"), F.lit(b).alias("metric")) for a, b in configs]))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r = t.iloc[0]
        g, x = grid_features(r.grid)
        edges = kernels.grid_edges(g.row.tolist(), g.col.tolist(), QUEEN if connectivity == "queen" else ROOK)
        merges = kernels.merge_tree(x, edges, r.linkage, r.metric) if edges else []
        a, b, d = zip(*merges) if merges else ((), (), ())
        return pd.DataFrame({"linkage": [r.linkage], "metric": [r.metric], "a": [list(a)], "b": [list(b)], "d": [list(d)]})

    jobs = collected(cells).withColumn("c", asked).select("grid", "c.*")
    return jobs.groupBy("linkage", "metric").applyInPandas(run, "linkage string, metric string, a array<int>, b array<int>, d array<double>")


def cut_trees(trees: DataFrame, cells: DataFrame, ks, least_fraction: float = 0.0) -> DataFrame:
    """(linkage, metric, k_req, k_found, q, p, labels): each tree cut at every k; k = 0 asks for the k of the largest relative gap.

    Clusters below the larger of 5 cells and the fraction join others.
    """
    jobs = trees.crossJoin(collected(cells)).withColumn("k_req", F.explode(F.array(*[F.lit(int(k)) for k in ks])))  # the grid is one row

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            out = []
            for r in t.itertuples():
                g, _ = grid_features(r.grid)
                labels = kernels.cut_tree(len(g), list(zip(r.a, r.b)), r.k_req or kernels.tree_k(r.d))
                labels = kernels.merge_tiny(labels, g.row.tolist(), g.col.tolist(), max(LEAST, int(len(g) * least_fraction)))
                labels = np.unique(labels, return_inverse=True)[1]
                q = kernels.q_statistic(g.value, labels)
                out.append((r.linkage, r.metric, r.k_req, int(labels.max()) + 1, q["q"], q["p"], labels.tolist()))
            yield pd.DataFrame(out, columns=["linkage", "metric", "k_req", "k_found", "q", "p", "labels"])

    # One cut is a row's work; rows are dealt out, as all come from one task.
    return jobs.repartition(len(list(ks)), "k_req").mapInPandas(run, "linkage string, metric string, k_req int, k_found int, q double, p double, labels array<int>")


def cluster_configs(cells: DataFrame, ks, least_fraction: float = 0.0, configs=CONFIGS, connectivity: str = "queen") -> DataFrame:
    """(cell, row, col, value) -> (linkage, metric, k_req, k_found, q, p, labels) for every configuration and k, from one tree each."""
    return cut_trees(hold(merge_trees(cells, configs, connectivity)), cells, ks, least_fraction)


def distinct_partitions(found: DataFrame) -> DataFrame:
    """Of identical label lists the one of highest q."""
    w = Window.partitionBy("labels").orderBy(F.desc("q"), "k_req", "linkage", "metric")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ranked_partitions(found: DataFrame, n: int = 20) -> DataFrame:
    """The n distinct partitions of two or more clusters with the highest q; the first one is the best."""
    return distinct_partitions(found.where("k_found >= 2")).orderBy(F.desc("q"), "k_req", "linkage", "metric").limit(n)


def k_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("k_found").agg(F.count("*").alias("n"), F.max("q").alias("best_q"))


def choose_k(found: DataFrame) -> int:
    """Knee of the best q over k; without one the k of the highest q. The table has a row per k."""
    rows = found.where("k_found >= 2").groupBy("k_req").agg(F.max("q").alias("q")).sort("k_req").collect()
    knee = kernels.kneedle([r.k_req for r in rows], [r.q for r in rows])
    return int(knee) if knee is not None else max(rows, key=lambda r: r.q).k_req


def nearest_fill(labels: DataFrame) -> DataFrame:
    """Cells without a label get that of the nearest with one; ties to the smaller (row, col).

    In two steps, as distance transforms go: for each place of a column the nearest labelled cells above and below, then
    for each cell the best of these along its row. Both steps are dealt out by column and by row. Places of the row that
    are no cells take part too, so gaps in the grid hide nothing.
    """
    have = labels.where("label IS NOT NULL").select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("label").alias("l"))
    lack = labels.where("label IS NULL")
    rows = lack.select("row").distinct()
    # A column's labelled cells and the rows asked for, in one order.
    asked = have.select("c").distinct().crossJoin(rows).select("c", F.col("row").alias("r"), F.lit(None).cast("struct<r:int,l:bigint>").alias("at"))
    seen = have.select("c", "r", F.struct(F.col("r").cast("int").alias("r"), F.col("l").cast("bigint").alias("l")).alias("at"))
    w = Window.partitionBy("c").orderBy("r")
    both = seen.unionByName(asked).withColumns({
        "up": F.last("at", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "down": F.first("at", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("at IS NULL")
    near = both.select(F.col("r").alias("row"), "c", F.explode(F.array_compact(F.array("up", "down"))).alias("at"))
    d = (F.col("row") - F.col("at.r")) * (F.col("row") - F.col("at.r")) + (F.col("col") - F.col("c")) * (F.col("col") - F.col("c"))
    kind = dict(labels.dtypes)["label"]
    fill = lack.select("cell", "row", "col").join(near, "row").groupBy("cell", "row", "col").agg(F.min_by("at.l", F.struct(d, "at.r", "c")).cast(kind).alias("label"))
    return labels.where("label IS NOT NULL").select("cell", "row", "col", "label").unionByName(fill)


def majority(labels: DataFrame) -> DataFrame:
    """(cell, label): most frequent label of the 3 x 3 cells around, edges repeated, ties to the smallest label."""
    top, right = labels.agg(F.max("row"), F.max("col")).first()
    move = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [*QUEEN, (0, 0)]]))
    at = lambda x, d, m: F.least(F.greatest(F.col(x) + F.col(d), F.lit(0)), F.lit(m))
    seen = labels.select("cell", "row", "col", move.alias("m")).select("cell", at("row", "m.a", top).alias("row"), at("col", "m.b", right).alias("col")).join(labels.select("row", "col", "label"), ["row", "col"])
    return seen.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def split_parts(labels: DataFrame) -> DataFrame:
    """(cell, label, part): connected parts of each label, numbered by label and first cell in scan order."""
    comp = components(labels.select("label", "cell", "row", "col"), ["label"], 1)
    order = comp.select("label", "comp").distinct().withColumn("part", F.row_number().over(Window.orderBy("label", "comp")) - 1)
    return comp.join(order, ["label", "comp"]).select("cell", "label", "part")


def cluster_adjacency(labels: DataFrame) -> DataFrame:
    """(label, other): clusters that touch."""
    near = neighbours(labels.select("cell", "row", "col"), []).join(labels.select("cell", "label"), "cell")
    return near.join(labels.select(F.col("cell").alias("other"), F.col("label").alias("l2")), "other").where("label <> l2").select("label", F.col("l2").alias("other")).distinct()


def merge_small(labels: DataFrame, least: int) -> DataFrame:
    """(cell, label): groups of touching clusters below least become one, under their smallest label.

    The adjacency of clusters is a table of dozens of rows.
    """
    small = {r.label for r in labels.groupBy("label").count().where(F.col("count") < least).collect()}
    pairs = [(r.label, r.other) for r in cluster_adjacency(labels).collect() if r.label in small and r.other in small]
    ids = sorted(small)
    place = {k: i for i, k in enumerate(ids)}
    root = kernels.union_find(len(ids), [(place[a], place[b]) for a, b in pairs])
    to = {k: ids[root[i]] for k, i in place.items() if ids[root[i]] != k}
    if not to:
        return labels
    kind = dict(labels.dtypes)["label"]
    new = labels.sparkSession.createDataFrame([*to.items()], f"label {kind}, __to {kind}")
    return labels.join(new, "label", "left").withColumn("label", F.coalesce("__to", "label")).select(*labels.columns)


def merge_remaining(labels: DataFrame, least: int) -> DataFrame:
    """Clusters below least, one after the other, into the largest touching cluster of that size. See kernels.merge_remaining().

    The order matters, so one group does it, on the graph of clusters: it has a row for each cluster and each two that
    touch, however large the grid is. Cells get their label by a join.
    """
    kind = dict(labels.dtypes)["label"]
    sizes_ = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.col("label").alias("a"), F.lit(None).cast(kind).alias("b"), "n")
    touch = cluster_adjacency(labels).select(F.col("label").alias("a"), F.col("other").alias("b"), F.lit(0).cast("long").alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        alone = t.b.isna()
        moved = kernels.merge_remaining(dict(zip(t.a[alone], t.n[alone])), zip(t.a[~alone], t.b[~alone].astype(t.a.dtype)), least)
        return pd.DataFrame({"label": list(moved), "__to": list(moved.values())})

    moved = sizes_.unionByName(touch).withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, f"label {kind}, __to {kind}")
    return labels.join(moved, "label", "left").withColumn("label", F.coalesce("__to", "label")).select(*labels.columns)


def relabel(labels: DataFrame, order: str = "south") -> DataFrame:
    """(cell, label, rank): south: by mean latitude, then mean longitude; north: by highest latitude down, then lowest longitude."""
    g = labels.groupBy("label").agg(F.avg("lat").alias("y"), F.avg("lon").alias("x"), F.max("lat").alias("top"), F.min("lon").alias("west"))
    by = [F.round("y", 9), F.round("x", 9)] if order == "south" else [F.desc("top"), F.col("west")]
    ranks = g.withColumn("rank", F.row_number().over(Window.orderBy(*by, "label")) - 1).select("label", "rank")
    return labels.join(ranks, "label").select("cell", "label", "rank")


def smooth_labels(labels: DataFrame, least: float = 0.1, split: bool = True, order: str = "south") -> DataFrame:
    """Majority filter, split, relabel, merge small clusters, relabel. least below 1 is a share of the cells."""
    labels = hold(labels.select("cell", "row", "col", "lat", "lon", "label"))
    place = labels.drop("label")
    valid = labels.where("label >= 0").select("cell", "row", "col", "label")
    filled = hold(nearest_fill(place.join(valid.select("cell", "label"), "cell", "left").select("cell", "row", "col", "label")))
    got = place.join(majority(filled), "cell").join(valid.select("cell"), "cell", "left_semi")
    if split:
        got = place.join(split_parts(hold(got)).select("cell", F.col("part").alias("label")), "cell")
    got = hold(place.join(relabel(hold(got), order).select("cell", F.col("rank").alias("label")), "cell"))
    n = int(-(-least * valid.count() // 1)) if least < 1 else int(least)
    got = merge_remaining(merge_small(got, n).select("cell", "row", "col", "lat", "lon", F.col("label").cast("long").alias("label")), n)
    return hold(relabel(hold(got), order))


def outlines(labels: DataFrame, dlat: float, dlon: float, lat0: float, lon0: float) -> DataFrame:
    """(community, row, col) -> (community, cells, rings, area, geometry): one multipolygon for each community.

    lat0 and lon0 are the centre of row 0 and column 0. Inner borders are dissolved, holes are kept; area in square
    degrees. A community is one group, at most a grid.
    """

    def run(at: dict, t: pd.DataFrame) -> pd.DataFrame:
        rings = [[(lon0 + (x - 0.5) * dlon, lat0 + (y - 0.5) * dlat) for x, y in r] for r in kernels.outline(t.row.tolist(), t.col.tolist())]
        outer, holes = [[r] for r in rings if kernels.ring_area(r) > 0], [r for r in rings if kernels.ring_area(r) < 0]
        for h in holes:  # the smallest outer ring around a point just off the hole's first corner
            x, y = h[0][0] + dlon / 2, h[0][1] + dlat / 2
            around = [p for p in outer if kernels.within(p[0], x, y)]
            min(around or outer, key=lambda p: kernels.ring_area(p[0])).append(h)
        text = ", ".join("(" + ", ".join("(" + ", ".join(f"{x:.4f} {y:.4f}" for x, y in r) + ")" for r in p) + ")" for p in outer)
        return pd.DataFrame({"cells": [len(t)], "rings": [len(rings)], "area": [sum(map(kernels.ring_area, rings))], "geometry": [f"MULTIPOLYGON ({text})"]})

    return by_group(labels.select("community", "row", "col"), ("community",), run, "cells long, rings int, area double, geometry string")


def bilinear(cells: DataFrame, factor: int = 2) -> DataFrame:
    """(row, col, value) -> (y, x, value) at 1/factor steps: each point joins the four cells around it; missing ones leave their weight to the others."""
    m = cells.agg(F.max("row").alias("rmax"), F.max("col").alias("cmax")).select(F.explode(F.sequence(F.lit(0), F.col("rmax") * factor)).alias("y"), "cmax").select("y", F.explode(F.sequence(F.lit(0), F.col("cmax") * factor)).alias("x"))
    y, x = F.col("y") / factor, F.col("x") / factor
    p = m.withColumns({"fy": y - F.floor(y), "fx": x - F.floor(x), "r0": F.floor(y), "c0": F.floor(x)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = p.withColumn("k", corner).withColumns({"row": (F.col("r0") + F.col("k.a")).cast("int"), "col": (F.col("c0") + F.col("k.b")).cast("int")})
    weight = F.when(F.col("k.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    j = p.withColumn("w", weight).where("w > 0").join(cells.select("row", "col", "value"), ["row", "col"])
    return j.groupBy("y", "x").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def triangulated(cells: DataFrame, factor: int = 2, keys: tuple[str, ...] = (), reach: float = 1.0) -> DataFrame:
    """(keys, row, col, value) -> (keys, y, x, value) at 1/factor steps: linear over triangles of cells, within reach of one.

    A square of four cells is parted from its smaller to its larger row and column; one of three cells is a triangle. A
    missing cell between four others is bridged: its square is parted along the row. Points that no such triangle and no line
    between adjacent cells holds, in wider gaps or beyond the cells, or whose nearest cell is farther than reach, have no row.
    """
    corner = {"v00": (0, 0), "v01": (0, -1), "v10": (-1, 0), "v11": (-1, -1)}
    around = {"north": (1, 0), "south": (-1, 0), "west": (0, 1), "east": (0, -1)}

    def met(places: dict[str, tuple[int, int]]) -> DataFrame:
        """A row for each place, with the values of the cells that stand to it as named."""
        to = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in places.items()]))
        each = cells.select(*keys, "row", "col", "value", to.alias("k")).select(*keys, (F.col("row") + F.col("k.a")).alias("r"), (F.col("col") + F.col("k.b")).alias("c"), "k.n", "value")
        return each.groupBy(*keys, "r", "c").agg(*[F.max(F.when(F.col("n") == n, F.col("value"))).alias(n) for n in places])

    def spread(df: DataFrame, low: int) -> DataFrame:
        steps = F.array(*[F.lit(k / factor) for k in range(low, factor)])
        return df.withColumn("fy", F.explode(steps)).withColumn("fx", F.explode(steps))

    def blend(*parts: tuple[Column, str]) -> Column:
        """The weighted sum, null if a cell of some weight is missing."""
        return functools.reduce(lambda a, b: a + b, [F.when(F.abs(w) < 1e-12, 0.0).otherwise(w * F.col(v)) for w, v in parts])

    def nearest(*parts: tuple[str, float, float]) -> Column:
        return F.least(*[F.when(F.col(v).isNotNull(), F.sqrt(F.pow(F.col("fy") - a, 2) + F.pow(F.col("fx") - b, 2))) for v, a, b in parts])

    y, x, one = F.col("fy"), F.col("fx"), F.lit(1.0)
    main = F.when(x >= y, blend((one - x, "v00"), (x - y, "v01"), (y, "v11"))).otherwise(blend((one - y, "v00"), (y - x, "v10"), (x, "v11")))
    upper = F.when(F.col("v00").isNull() & (x + y >= 1), blend((one - y, "v01"), (one - x, "v10"), (x + y - 1, "v11")))
    lower = F.when(F.col("v11").isNull() & (x + y <= 1), blend((one - x - y, "v00"), (x, "v01"), (y, "v10")))
    square = spread(met(corner), 0).withColumns({"value": F.coalesce(main, upper, lower), "d": nearest(("v00", 0, 0), ("v01", 0, 1), ("v10", 1, 0), ("v11", 1, 1))})
    # Around a missing cell; its own place counts with the squares where it is a cell.
    holes = met(around | {"own": (0, 0)}).where(F.col("own").isNull() & functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in around]))
    ay = F.abs(y)
    side = F.when(y > 0, ay * F.col("south")).otherwise(ay * F.col("north"))
    bridged = spread(holes, 1 - factor).where(F.abs(y) + F.abs(x) < 1).withColumns({"value": side + (one - ay - x) / 2 * F.col("west") + (one - ay + x) / 2 * F.col("east"), "d": nearest(("north", -1, 0), ("south", 1, 0), ("west", 0, -1), ("east", 0, 1))})
    place = lambda r, f: F.round((F.col(r) + F.col(f)) * factor).cast("int")
    pick = lambda df: df.where(F.col("value").isNotNull() & (F.col("d") <= reach)).select(*keys, place("r", "fy").alias("y"), place("c", "fx").alias("x"), "value")
    return pick(square).unionByName(pick(bridged))


def far_points(points: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """Points (y, x) whose nearest cell centre (row, col) is farther than reach: cells are searched by integer blocks."""
    k = max(1, int(np.ceil(reach)))
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = points.withColumn("s", shifts).withColumns({"br": F.floor(F.col("y") / k) + F.col("s.a"), "bc": F.floor(F.col("x") / k) + F.col("s.b")})
    c = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), F.floor(F.col("row") / k).alias("br"), F.floor(F.col("col") / k).alias("bc"))
    d = F.sqrt(F.pow(F.col("y") - F.col("r"), 2) + F.pow(F.col("x") - F.col("c"), 2))
    near = p.join(c, ["br", "bc"]).where(d <= reach).select("y", "x").distinct()
    return points.join(near, ["y", "x"], "left_anti")


def masks_from_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, lat, lon) -> (community, cell) of exact cells."""
    return cells.join(points.select(F.col("id").alias("community"), "lat", "lon"), ["lat", "lon"]).select("community", "cell")
