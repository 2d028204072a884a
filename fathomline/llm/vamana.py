"""Approximate nearest neighbours on robust-pruned directed graphs, one graph a shard.

Equal vectors are taken together first: a distinct vector keeps the smallest ids of its rows (as
many as a result can name), found by limited window ranks that shrink on the map side, so a
vector that a third of the rows share costs one node. Distinct vectors are dealt to shards of about
``SHARD`` nodes by hash. In each shard a graph is built: every node is searched for greedily from
the medoid, the nodes seen are its candidate neighbours, and relaxed distance pruning keeps near
and diverse ones; edges are mirrored and pruned again. Nodes go in by growing batches, so most of
the work is numpy on whole batches.

Every query then runs a beam search in every shard, in blocks of ``BLOCK`` queries, and the shards'
nearest are merged by distance and id. Distances are exact, in double precision, on the original
vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

SHARD = 4096
BLOCK = 32_768
DEGREE, BEAM, RELAX, QUERY_BEAM = 24, 40, 1.2, 64
#: Mirrored edges a node may hold beyond its degree before it is pruned again.
SLACK = 12


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` (q, d) to its own rows of ``b`` (q, k, d)."""
    d = b - a[:, None, :]
    return np.einsum("qkd,qkd->qk", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy best-first searches of all queries side by side.

    ``graph`` holds neighbours, -1 where there is none. Returns for every query the beam's nodes
    and squared distances, nearest first (-1 and inf where unfilled), and a mask of expanded nodes.
    """
    q, n = len(queries), len(x)
    nodes = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((queries - x[start]) ** 2).sum(1)
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    expanded = np.zeros((q, n), bool)
    live = np.arange(q)
    while len(live):
        waiting = ~done[live]
        open_ = waiting.any(1)
        live, waiting = live[open_], waiting[open_]
        if not len(live):
            break
        pick = waiting.argmax(1)  # beams are sorted: the first waiting node is the nearest
        node = nodes[live, pick]
        done[live, pick] = True
        expanded[live, node] = True
        near = graph[node]
        fresh = near >= 0
        safe = np.where(fresh, near, 0)
        fresh &= ~seen[live[:, None], safe]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        d = _distances(queries[live], x[safe])
        d[~fresh] = np.inf
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1)
        all_dist = np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        rows = np.arange(len(live))[:, None]
        nodes[live], dist[live], done[live] = all_nodes[rows, order], all_dist[rows, order], all_done[rows, order]
    return nodes, dist, expanded


def prune(x: np.ndarray, point: int, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Keep the nearest candidate, drop those that it covers (relax * its distance to them <= theirs to the point), repeat."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates >= 0) & (candidates != point)]
    c = x[candidates]
    away = c - x[point]
    own = np.einsum("ij,ij->i", away, away)
    order = np.argsort(own, kind="stable")
    candidates, own, away = candidates[order], own[order], away[order]
    between = own[:, None] + own[None, :] - 2 * (away @ away.T)
    covered = relax * relax * between <= own[None, :]
    kept: list[int] = []
    gone = np.zeros(len(candidates), bool)
    for i in range(len(candidates)):
        if not gone[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            gone |= covered[i]
    return candidates[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 11) -> tuple[np.ndarray, int]:
    """The neighbours (n, degree + SLACK at most, then -1) of every node and the node to start from."""
    n = len(x)
    width = degree + SLACK
    graph = np.full((n, width), -1, np.int64)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for final in (False, True):  # the second round refines edges made while the graph was small
        at = 1 if not final else 0
        while at < n:
            batch = order[at : at + (min(max(at, 1), 256) if not final else 256)]
            at += len(batch)
            _, _, expanded = beam_search(x, graph, start, x[batch], beam)
            touched: dict[int, list[int]] = {}
            for row, point in enumerate(batch):
                found = np.concatenate([np.flatnonzero(expanded[row]), graph[point]])
                keep = prune(x, int(point), found, degree, relax if final else 1.0)
                graph[point] = -1
                graph[point, : len(keep)] = keep
                for k in keep.tolist():
                    touched.setdefault(k, []).append(int(point))
            for k, back in touched.items():
                have = graph[k][graph[k] >= 0]
                new = np.setdiff1d(np.array(back), have)
                if len(have) + len(new) <= width:
                    graph[k, len(have) : len(have) + len(new)] = new
                elif len(new):
                    keep = prune(x, k, np.concatenate([have, new]), degree, relax if final else 1.0)
                    graph[k] = -1
                    graph[k, : len(keep)] = keep
    return graph, start


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep_ids: int = 11, shard: int = SHARD) -> DataFrame:
    """A stashed table of every shard's graph: shard, node, vector, ids (the smallest ``keep_ids``), neighbours, start.

    Every usable row is indexed; rows that repeat an id and vector count once, and an empty table gives
    an empty index. Columns beside the two named are left aside. Vectors of other lengths than a shard's most frequent one are kept
    apart: shards are dealt by length and hash.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("n", F.size("v"))
    first = Window.partitionBy("h", "v").orderBy("id")
    ranked = rows.withColumn("k", F.dense_rank().over(first)).where(F.col("k") <= keep_ids)
    distinct = ranked.groupBy("h", "v", "n").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    distinct = stash(distinct, "distinct")
    count = distinct.count()
    shards = max(1, -(-count // shard))
    dealt = distinct.withColumn("shard", F.struct("n", F.pmod("h", F.lit(shards)).cast("int").alias("s")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", ignore_index=True)
        graph, start = build_graph(np.stack(pdf.v.to_numpy()))
        return pd.DataFrame({"n": pdf.n, "s": pdf.s, "node": np.arange(len(pdf)), "v": pdf.v, "ids": pdf.ids, "near": [g[g >= 0] for g in graph], "start": start})

    spread = dealt.select("h", "v", "n", "ids", F.col("shard.s").alias("s"))
    # as many tasks as shards: adaptive execution would put several small shards into one task
    graphs = spread.repartition(shards, "n", "s").groupBy("n", "s").applyInPandas(build, "n int, s int, node int, v array<double>, ids array<long>, near array<int>, start int")
    return stash(graphs, "graph")


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = QUERY_BEAM) -> DataFrame:
    """Each query's ``k`` nearest of the index but itself: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id. An id that has several vectors counts with the nearest, and
    as a query with the smallest of them; repeated queries are asked once. Queries that aren't usable find nothing; a query without
    other vectors of its length has no rows. The index must keep ``k + 1`` ids or more a vector.
    """
    asked = queries.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("q"), F.transform(vector_col, lambda v: v.cast("double")).alias("qv"))
    asked = asked.groupBy("q").agg(F.min("qv").alias("qv")).withColumn("qn", F.size("qv"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("n").alias("qn"), F.col("s").alias("qs")).distinct()
    per_shard = asked.join(shards, "qn")
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if g.empty or q.empty:
            return none
        g = g.sort_values("node", ignore_index=True)
        x = np.stack(g.v.to_numpy())
        graph = np.full((len(g), DEGREE + SLACK), -1, np.int64)
        for i, near in enumerate(g.near):
            graph[i, : len(near)] = near
        out: list[tuple] = []
        ids = g.ids.to_numpy()
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            points = np.stack(part.qv.to_numpy())
            nodes, _, _ = beam_search(x, graph, int(g.start[0]), points, beam)
            for name, point, found in zip(part.q, points, nodes):
                found = found[found >= 0]
                d = np.sqrt(((x[found] - point) ** 2).sum(1))
                nearest: dict[int, float] = {}
                for s, i in sorted((s, int(i)) for s, f in zip(d.tolist(), found.tolist()) for i in ids[f] if i != name):
                    nearest.setdefault(i, s)
                out += [(name, i, s) for i, s in list(nearest.items())[:k]]
        return pd.DataFrame(out, columns=["q", "id", "score"]) if out else none

    found = graph.groupBy("n", "s", "block").cogroup(per_shard.groupBy("qn", "qs", "block")).applyInPandas(run, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("q").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
