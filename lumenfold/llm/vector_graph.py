"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard of the vectors.

Distinct vectors are nodes. Hashing deals them into shards of about SHARD_NODES, and a task builds each shard's
graph: every node is searched for greedily from the shard's medoid, what the search has seen is pruned to at most
DEGREE diverse neighbours (a candidate goes when a kept neighbour is ALPHA times nearer to it than the node is), and
edges are added back and pruned likewise. Queries in blocks meet every shard by an equi-join; a beam search finds
each shard's nearest nodes, whose distances are computed again in double precision on the vectors as given. From SHARDS
shards on they grow, up to MOST_NODES nodes, and so does the beam, by the power of 0.4: a search in a larger graph costs
little more, one in more graphs as many times more.

Equal vectors share a node, which keeps the k + 1 least ids: no query can need more of them, as ties go to the
least id. Every row is indexed; nothing is sampled.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors
are compared with those of their own length only; rows of the query's own id are never its neighbours; an id with
several vectors is near by the nearest of them, as a neighbour and as a query, and is returned once (then there may be
fewer than k rows); fewer candidates than k give as many rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import scoped, table

SHARD_NODES, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 4096, 32, 64, 96, 1.2
#: Shards from which on they grow instead of becoming more, as every query is searched for in each, and the nodes to which they grow: a task's memory is their bound.
SHARDS, MOST_NODES = 24, 32_768
#: Queries of a task, and of one search in it: the index meets every block of the queries.
QUERY_BLOCK, SEARCHED = 8192, 512
#: Edges back to one node that are pruned at once; all are, in rounds.
BACK_EDGES = 64
#: Edges that a node has room for besides DEGREE while its graph is built; batches of nodes whose edges back are added at once, at most; nodes that are pruned at once.
SLACK, BATCHES, PRUNED = 16, 16, 128


def _distances(points: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of points[rows] (b, c) to queries (b, d)."""
    gap = points[rows]
    gap -= queries[:, None, :]
    return np.einsum("bcd,bcd->bc", gap, gap)


#: What a beam holds where it has no node yet: no distance, no id, opened.
_NONE = (int(np.float32(np.inf).view(np.int32)) << 32) | 0xFFFFFFFF


def _held(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Nodes as a beam holds them: 32 bits of the squared distance, which order as it does, 31 of the id, and whether the node is opened (or has no finite distance), so that one partition of integers keeps the nearest."""
    far = ~np.isfinite(near)
    return (np.where(far, np.float32(np.inf), near).view(np.int32).astype(np.int64) << 32) | (ids.astype(np.int64) << 1) | far


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the beam's nodes for each query, nearest first."""
    b, n = len(queries), len(points)
    beam = min(beam, n)
    held = np.full((b, beam), _NONE)
    held[:, 0] = _held(_distances(points, np.full((b, 1), entry), queries)[:, 0].astype(np.float32), np.full(b, entry))
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = seen[:, entry] = True
    seen = seen.ravel()
    found, active = np.empty_like(held), np.arange(b)
    while True:
        open_ = np.where(held & 1, _NONE, held)
        best = open_.argmin(1)
        going = open_[np.arange(len(active)), best] != _NONE
        if not going.all():
            found[active[~going]] = held[~going]
            held, active, best = held[going], active[going], best[going]
            if not len(active):
                break
        at = np.arange(len(active)) * beam + best
        next_ = graph.take((held.ravel().take(at) >> 1) & 0x7FFFFFFF, 0)
        held.ravel()[at] |= 1
        place = (np.where(next_ < 0, n, next_) + active[:, None] * (n + 1)).ravel()
        fresh = np.flatnonzero(~seen.take(place))
        seen[place.take(fresh)] = True
        # a search meets most nodes again and again: distances are those of new ones alone
        node = next_.ravel().take(fresh)
        gap = points.take(node, 0)
        gap -= queries.take(active.take(fresh // next_.shape[1]), 0)
        more = np.full(next_.shape, _NONE)
        more.ravel()[fresh] = _held(np.einsum("ij,ij->i", gap, gap).astype(np.float32), node)
        held = np.partition(np.concatenate([held, more], 1), beam - 1, 1)[:, :beam].copy()
    found.sort(1)
    ids = (found >> 1) & 0x7FFFFFFF
    return np.where(ids == 0x7FFFFFFF, -1, ids), (found >> 32).astype(np.int32).view(np.float32)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most degree of its candidates (-1: none): the nearest first, each ruling out those that it is nearer to."""
    none = (candidates < 0) | (candidates == nodes[:, None])
    rows = np.where(none, 0, candidates)
    own = _distances(points, rows, points[nodes])
    own[none] = np.inf
    order = np.argsort(own, 1, kind="stable")
    own, rows = np.take_along_axis(own, order, 1), np.take_along_axis(rows, order, 1)
    vectors = points[rows]
    norms = np.einsum("bcd,bcd->bc", vectors, vectors)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1)
    alive = np.isfinite(own)
    at = np.arange(len(nodes))
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[at, pick]
        if not some.any():
            break
        out[some, k] = rows[at, pick][some]
        alive &= alpha * alpha * between[at, pick] > own
        alive[at, pick] = False
        alive &= rows != rows[at, pick][:, None]
    return out


def _pruned(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """robust_prune in blocks of nodes: what it needs grows with the square of the candidates."""
    return np.concatenate([robust_prune(points, nodes[i : i + PRUNED], candidates[i : i + PRUNED], degree, ALPHA) for i in range(0, len(nodes), PRUNED)])


def build_graph(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """The out-neighbours (n, DEGREE; -1: none) of every point, and the medoid at which searches start."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(_distances(points, np.arange(n)[None, :], points.mean(0)[None, :].astype(points.dtype))[0].argmin())
    degree = min(DEGREE, max(n - 1, 1))
    # a node's edges come first in its row; edges back are added while there is room and pruned with the others when there is none
    graph = np.full((n, degree + SLACK), -1)
    if n > 1:
        first = rng.integers(0, n, (n, degree // 2 + 1))
        first[first == np.arange(n)[:, None]] = (first[first == np.arange(n)[:, None]] + 1) % n
        graph[:, : degree // 2 + 1] = first
    for batch in np.array_split(rng.permutation(n), max(1, min(n // 256, BATCHES))):
        for part in np.array_split(batch, -(-len(batch) // SEARCHED)):
            found, _ = beam_search(points, graph, entry, points[part], BUILD_BEAM)
            graph[part, :degree] = _pruned(points, part, np.concatenate([found, graph[part]], 1), degree)
            graph[part, degree:] = -1
        source, target = np.repeat(batch, degree), graph[batch, :degree].ravel()
        known = (target < 0) | (graph[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        had = (graph[nodes] >= 0).sum(1)
        fits = had + count <= graph.shape[1]
        ok = np.repeat(fits, count)
        graph[target[ok], (np.repeat(had, count) + place)[ok]] = source[ok]
        source, place, nodes, count = source[~ok], place[~ok], nodes[~fits], count[~fits]
        for low in range(0, int(count.max(initial=0)), BACK_EDGES):
            more = count > low
            ok = (place >= low) & (place < low + BACK_EDGES)
            added = np.full((int(more.sum()), min(BACK_EDGES, int(count.max()) - low)), -1)
            added[np.repeat(np.cumsum(more) - 1, count)[ok], place[ok] - low] = source[ok]
            graph[nodes[more], :degree] = _pruned(points, nodes[more], np.concatenate([graph[nodes[more]], added], 1), degree)
            graph[nodes[more], degree:] = -1
    over = np.flatnonzero(graph[:, degree] >= 0)
    if len(over):
        graph[over, :degree] = _pruned(points, over, graph[over], degree)
    return graph[:, :degree], entry


def shard_count(nodes: int, shard_nodes: int = SHARD_NODES) -> int:
    """Of how many shards an index of so many nodes is made."""
    return max(1, min(round(nodes / shard_nodes), SHARDS), -(-nodes // MOST_NODES))


def search_beam(nodes: int) -> int:
    """The beam of a search in a shard: larger ones need a wider one for the same recall."""
    return max(SEARCH_BEAM, round(SEARCH_BEAM * (nodes / SHARD_NODES) ** 0.4))


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@scoped
def nearest(vectors: DataFrame, queries: Column, k: int = 10, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """vectors: (vec_id, embedding). Rows (query_id, rank, vec_id, score): the k nearest of every row that queries selects."""
    spark = vectors.sparkSession
    good = table(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where(_valid(F.col("embedding"))).where("vec_id is not null"))
    ranked = good.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    nodes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding"))
    nodes = table(nodes)
    dims = {r["dim"]: shard_count(r["count"], shard_nodes) for r in nodes.groupBy("dim").count().collect()}  # a row per vector length
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for kv in dims.items() for x in kv]), F.col("dim"))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(frame["embedding"].to_numpy())
        graph, entry = build_graph(exact.astype(np.float32))
        sizes = np.cumsum([0, *map(len, frame["ids"])])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "entry": [entry], "exact": [exact.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "ids": [np.concatenate(frame["ids"].to_numpy()).astype(np.int64).tobytes()], "bounds": [sizes.astype(np.int64).tobytes()]})

    # a task for each shard and, below, for each shard and block: their work does not follow their bytes
    tasks = max(sum(dims.values()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), shards).cast("int")).repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, entry int, exact binary, graph binary, ids binary, bounds binary")
    index = table(index)
    asked = good.where(queries).withColumn("dim", F.size("embedding")).distinct()
    blocks = max(1, asked.count() // QUERY_BLOCK)
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("asked"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples():
            exact = np.frombuffer(r.exact).reshape(-1, r.dim)
            graph = np.frombuffer(r.graph, np.int32).reshape(len(exact), -1)
            ids, bounds = np.frombuffer(r.ids, np.int64), np.frombuffer(r.bounds, np.int64)
            names = np.array([a["vec_id"] for a in r.asked])
            queries = np.stack([np.asarray(a["embedding"]) for a in r.asked])
            points = exact.astype(np.float32)
            for i in range(0, len(names), SEARCHED):
                own, q = names[i : i + SEARCHED], queries[i : i + SEARCHED]
                found, _ = beam_search(points, graph, r.entry, q.astype(np.float32), max(search_beam(len(points)), 4 * k))
                true = np.sqrt(_distances(exact, np.maximum(found, 0), q))
                true[found < 0] = np.inf
                order = np.argsort(true, 1, kind="stable")
                for j in range(len(own)):
                    near = []
                    for c in order[j]:
                        if not np.isfinite(true[j, c]) or (len(near) >= k and true[j, c] > near[k - 1][0]):
                            break
                        node = found[j, c]
                        near += [(float(true[j, c]), int(x)) for x in ids[bounds[node] : bounds[node + 1]] if x != own[j]]
                        near.sort()
                    out += [(int(own[j]), x, s) for s, x in near[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = asked.join(index, ["dim", "shard"]).repartition(tasks * blocks, "dim", "shard", "block").groupBy("dim", "shard", "block").applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
