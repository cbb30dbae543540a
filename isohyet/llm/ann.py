"""Approximate nearest neighbours: one HNSW graph per shard, shard results merged.

Largest inner product becomes nearest point by one more coordinate, sqrt(M^2 - |v|^2) with the shard's largest norm M
(queries get 0 there). Vectors are inserted in batches: a batch searches the graph built so far, all its members at
once, and is also compared within itself; neighbours are chosen by the usual diversity rule. A graph is flat arrays:
for each level its nodes and a table of neighbours. Copies of a vector are one node that carries their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm.common import cut, table

#: Distinct vectors in a shard, about: the larger of SHARD and GROWTH times the root of their number, so that both shards
#: and the number of them grow, up to LARGEST and the bytes of vectors that one task holds.
SHARD, GROWTH, LARGEST, SHARD_BYTES = 4096, 16, 1 << 18, 256 << 20
#: Neighbours of a node on level 0 (half as many above), width of searches when building and least width when answering.
LINKS, BUILD, SEARCH = 24, 64, 112
#: A shard's width is doubled until searches for so many of its own vectors find this share of their nearest; a search
#: expands about a STEP-th of its width at a time.
PROBES, TARGET, STEP = 64, 0.96, 128
#: Queries in a block. A copy of a graph answers at least BLOCKS blocks, and QUERIES times the root of the number of vectors,
#: so what is sent grows as their number to the power 1.5, like the searches, and a shard is no single task.
BLOCK, BLOCKS, QUERIES = 512, 8, 4
K = 20


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a (n x d) with b (n x m x d)."""
    return np.matmul(b, a[:, :, None])[:, :, 0]


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once: (distance, node), nearest first, -1 where none.

    Wide searches expand several nodes at a time, about STEP times in all.
    """
    n, q = len(points), len(queries)
    rows = np.arange(q)
    norm = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    best = np.full((q, width), -1)
    dist = np.full((q, width), np.inf)
    done = np.ones((q, width), bool)
    first = entry.shape[1]
    best[:, :first] = entry
    dist[:, :first] = norm[entry] - 2 * dots(queries, points[entry])
    done[:, :first] = False
    seen[rows[:, None], entry] = True
    live, step = rows, max(1, width // STEP)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        at = np.argpartition(open_, step - 1, axis=1)[:, :step] if step > 1 else open_.argmin(1)[:, None]
        ok = np.isfinite(np.take_along_axis(open_, at, 1))
        some = ok.any(1)
        live, at, ok = live[some], at[some], ok[some]
        if not len(live):
            break
        done[live[:, None], at] = True
        near = np.where(ok[:, :, None], links[np.maximum(best[live[:, None], at], 0)], n).reshape(len(live), -1)
        if step > 1:  # a node may be a neighbour of several
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        seen[:, n] = True
        d = np.where(fresh, norm[np.minimum(near, n - 1)] - 2 * dots(queries[live], points[np.minimum(near, n - 1)]), np.inf)
        all_d, all_n, all_done = np.c_[dist[live], d], np.c_[best[live], near], np.c_[done[live], ~fresh]
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        take = lambda x: np.take_along_axis(x, keep, 1)
        dist[live], best[live], done[live] = take(all_d), take(all_n), take(all_done)
    best = np.where(np.isfinite(dist), best, -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(dist, order, 1), np.take_along_axis(best, order, 1)


def choose(points: np.ndarray, node: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each node out of near (nearest first): one nearer to a chosen one than to the node waits."""
    n = len(points)
    out = np.full((len(node), m), n)
    safe = np.minimum(np.where(near < 0, n, near), n - 1)
    valid = (near >= 0) & (near < n) & (near != node[:, None])
    p = points[safe]
    own = ((p - points[node][:, None]) ** 2).sum(2)
    count = np.zeros(len(node), int)
    chosen = np.zeros(near.shape, bool)
    nearest = np.full(near.shape, np.inf)
    rows = np.arange(len(node))
    for j in range(near.shape[1]):
        ok = valid[:, j] & (count < m) & (own[:, j] < nearest[:, j])
        if ok.any():
            r = rows[ok]
            out[r, count[r]] = safe[r, j]
            count[r] += 1
            chosen[r, j] = True
            nearest[r] = np.minimum(nearest[r], ((p[r] - p[r, j][:, None]) ** 2).sum(2))
    for j in range(near.shape[1]):  # room that is left goes to the nearest of those that wait
        ok = valid[:, j] & ~chosen[:, j] & (count < m)
        r = rows[ok]
        out[r, count[r]] = safe[r, j]
        count[r] += 1
    return out


def build(points: np.ndarray, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: (nodes, neighbours as places among these nodes, len(nodes) where none)."""
    n = len(points)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS / 2)).astype(int), 4)
    level[:1] = level.max(initial=0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= height)
        p, m = points[nodes], LINKS if height == 0 else LINKS // 2
        links = np.full((len(nodes), m), len(nodes))
        i = 0
        while i < len(nodes):
            size = min(max(32, i // 2), 512, len(nodes) - i)
            new = np.arange(i, i + size)
            inner = ((p[new] ** 2).sum(1)[None] - 2 * p[new] @ p[new].T) + np.where(np.eye(size, dtype=bool), np.inf, 0)
            mates = new[np.argsort(inner, axis=1)[:, : min(m, size)]]
            cand = mates
            if i:
                entry = np.zeros((size, 1), int) if not out else np.minimum(np.searchsorted(nodes, descend(points, out, p[new])), i - 1)[:, None]
                part = np.where(links[:i] >= i, i, links[:i])
                cand = np.c_[beam(p[:i], part, p[new], entry, BUILD)[1], mates]
            d = np.where(cand < 0, np.inf, ((p[np.maximum(cand, 0)] - p[new][:, None]) ** 2).sum(2))
            cand = np.take_along_axis(cand, np.argsort(d, axis=1, kind="stable"), 1)
            links[new] = choose(p, new, cand, m)
            links = link_back(p, links, new, m)
            i += size
        out.append((nodes, links))
    return out


def link_back(p: np.ndarray, links: np.ndarray, new: np.ndarray, m: int) -> np.ndarray:
    """Gives the neighbours of new nodes a link to them, and has nodes with too many choose again."""
    n = len(p)
    a, b = np.repeat(new, m), links[new].reshape(-1)
    a, b = a[b < n], b[b < n]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    to, start, more = np.unique(b, return_index=True, return_counts=True)
    width = int(more.max(initial=0))
    extra = np.full((len(to), width), n)
    extra[np.repeat(np.arange(len(to)), more), np.arange(len(b)) - np.repeat(start, more)] = a
    both = np.sort(np.c_[links[to], extra], axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = n
    d = np.where(both >= n, np.inf, ((p[np.minimum(both, n - 1)] - p[to][:, None]) ** 2).sum(2))
    both = np.take_along_axis(both, np.argsort(d, axis=1, kind="stable"), 1)
    full = (both < n).sum(1) > m
    links[to] = both[:, :m] if both.shape[1] >= m else np.c_[both, np.full((len(to), m - both.shape[1]), n)]
    if full.any():
        links[to[full]] = choose(p, to[full], both[full], m)
    return links


def descend(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray) -> np.ndarray:
    """The nearest node found on the lowest of the levels."""
    node = np.zeros(len(queries), int)
    for nodes, links in levels:
        at = np.searchsorted(nodes, node)[:, None] if len(nodes) > 1 else np.zeros((len(queries), 1), int)
        node = nodes[beam(points[nodes], links, queries, at, 8)[1][:, 0]]
    return node


def augmented(v: np.ndarray) -> np.ndarray:
    """With the further coordinate, in single precision: enough to walk the graph. Scores are taken from the originals."""
    norm = (v * v).sum(1)
    return np.c_[v, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))].astype(np.float32)


def search(v: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int) -> np.ndarray:
    """Places of up to `width` vectors for each query, -1 where none."""
    points, q = augmented(v), np.c_[queries, np.zeros(len(queries))].astype(np.float32)
    entry = descend(points, levels[:-1], q)[:, None] if len(levels) > 1 else np.zeros((len(q), 1), int)
    return beam(points, levels[-1][1], q, entry, width)[1]


def calibrated(v: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], k: int) -> int:
    """The width at which the graph's own vectors, PROBES of them, find TARGET of their k largest products; at most all vectors.

    Distances crowd together as dimensions or vectors grow, so no formula in the number of vectors holds the recall.
    """
    probes = v[np.linspace(0, len(v) - 1, min(PROBES, len(v))).astype(int)]
    k = min(k, len(v))
    least = np.concatenate([np.partition(probes[i : i + 16] @ v.T, len(v) - k, axis=1)[:, len(v) - k] for i in range(0, len(probes), 16)])
    width = min(len(v), max(SEARCH, k))
    while width < len(v):
        near = search(v, levels, probes, width)
        score = np.where(near < 0, -np.inf, np.einsum("qkd,qd->qk", v[near], probes))
        if np.minimum((score >= least[:, None] - 1e-9 * np.abs(least[:, None])).sum(1), k).mean() >= TARGET * k:
            break
        width = min(len(v), 2 * width)
    return width


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): vectors that are neither null nor zero and whose components are finite."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): k nearest by inner product of each vec_id divisible by `every`.

    All usable rows are candidates but those with the query's own id. Ties go to the smaller vec_id; rows that repeat id
    and vector count once. Vectors of a length other than the most common one take no part. Null ids take no part.
    Fewer candidates than k give fewer rows, an empty table none. Vectors have no texts to be long; further columns are left
    out.
    """
    spark = vectors.sparkSession
    all_ = usable(vectors)
    top = all_.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top.n if top else 1
    all_ = cut(all_.where(F.size("v") == dim).distinct(), "vectors")
    # Copies: a query needs no more than k + 1 ids of one vector. The limit acts before the shuffle, too.
    one = Window.partitionBy("v").orderBy("vec_id")
    rank = F.row_number().over(one)
    kinds = all_.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kinds = cut(kinds.withColumn("h", F.xxhash64("v", F.lit(9))), "distinct-vectors")
    count = kinds.count()
    most = max(k + 1, min(LARGEST, SHARD_BYTES // (8 * dim)))
    shards = max(1, -(-count // most), round(count / max(SHARD, GROWTH * count**0.5)))
    dealt = kinds.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(shards, "shard")

    def index(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("h").combine_chunks()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        ids = t["ids"].combine_chunks()
        levels = build(augmented(v))
        flat = [x.astype(np.int32).tobytes() for nodes, links in levels for x in (nodes, links)]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "v": [v.tobytes()], "ids": [ids.flatten().to_numpy().tobytes()], "ends": [ids.offsets.to_numpy().astype(np.int64).tobytes()], "graph": [flat], "width": pa.array([calibrated(v, levels, k + 1)], pa.int32())})

    graphs = dealt.groupBy("shard").applyInArrow(index, "shard int, v binary, ids binary, ends binary, graph array<binary>, width int")
    graphs = cut(graphs, "graphs")

    queries = all_.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("qs")).select("block", F.col("qs.vec_id").alias("q_ids"), F.flatten("qs.v").alias("q"))
    # Each block of the stated query set goes to each shard. A graph goes to its blocks once for `run` of them.
    run = max(BLOCKS, int(QUERIES * count**0.5 / BLOCK))
    sets = -(-blocks // run)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    homes = graphs.withColumn("part", numbers(sets)).withColumns({"block": F.lit(-1), "q_ids": F.lit(None).cast("array<bigint>"), "q": F.lit(None).cast("array<double>")})
    visits = cut(asked, "queries").withColumn("shard", numbers(shards)).withColumn("part", F.floor(F.col("block") / run).cast("int"))
    met = homes.unionByName(visits, allowMissingColumns=True).repartition(shards * sets, "shard", "part").sortWithinPartitions("shard", "part", "block")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ids = ends = levels = width = None
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r]  # noqa: B023, E731
                if get("block").as_py() < 0:
                    v = np.frombuffer(get("v").as_py()).reshape(-1, dim)
                    ids, ends = np.frombuffer(get("ids").as_py(), np.int64), np.frombuffer(get("ends").as_py(), np.int64)
                    width = get("width").as_py()
                    flat = [np.frombuffer(x, np.int32).astype(np.int64) for x in get("graph").as_py()]
                    levels = [(nodes, links.reshape(len(nodes), -1)) for nodes, links in zip(flat[::2], flat[1::2])]
                    continue
                q_ids, q = get("q_ids").values.to_numpy(), get("q").values.to_numpy().reshape(-1, dim)
                near = search(v, levels, q, width)
                exact = np.where(near < 0, -np.inf, np.einsum("qkd,qd->qk", v[near], q))
                row, col = np.nonzero(near >= 0)
                places = near[row, col]
                n = (ends[1:] - ends[:-1])[places]
                owner, score = np.repeat(row, n), np.repeat(exact[row, col], n)
                cand = ids[np.repeat(ends[places] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                yield best_of(get("block").as_py(), q_ids[owner], cand, score, k)

    kind = "block int, query_id binary, vec_id binary, score binary"
    found = met.mapInArrow(answer, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for r in range(b.num_rows):
                block = b.column("block")[r].as_py()
                new = tuple(np.frombuffer(b.column(c)[r].as_py(), t) for c, t in (("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64)))
                both = tuple(map(np.concatenate, zip(held[block], new))) if block in held else new
                held[block] = trim(*both, k)
        for q, v, s in held.values():
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    return found.repartition(blocks, "block").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def trim(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


def best_of(block: int, q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    other = q != v
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in trim(q[other], v[other], s[other], k))], ["block", "query_id", "vec_id", "score"])


def op5_hnsw_shards(spark, sf_dir: str) -> DataFrame:
    """One row for each query and rank. See nearest()."""
    return nearest(table(spark, sf_dir, "embeddings"))
