"""Weighted graphs as edge tables: source, target, weight."""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written


def nodes(edges: DataFrame) -> DataFrame:
    """Id, degree, strength (sum of weights)."""
    ends = edges.select(F.col("source").alias("id"), "weight").unionByName(edges.select(F.col("target").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def is_bipartite(edges: DataFrame) -> DataFrame:
    """One row: no node is both a source and a target."""
    both = edges.select(F.col("source").alias("id")).distinct().join(edges.select(F.col("target").alias("id")).distinct(), "id")
    return both.agg((F.count(F.lit(1)) == 0).alias("bipartite"))


def sub_network(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges of at least ``threshold`` times the larger of 1 and the largest weight."""
    most = edges.agg(F.greatest(F.lit(1.0), F.max("weight").cast("double")).alias("_most"))
    return edges.join(F.broadcast(most)).where(F.col("weight") >= threshold * F.col("_most")).drop("_most")  # one row


def _adjacency(pdf: pd.DataFrame) -> dict:
    near: dict = {}
    for s, t, w in zip(pdf["source"], pdf["target"], pdf["weight"], strict=True):
        for x, y in {(s, t), (t, s)}:
            own = near.setdefault(x, {})
            own[y] = own.get(y, 0) + w
    return near


#: Edges that every task of ``betweenness`` and the last level of ``louvain`` may hold.
MOST_EDGES = 500_000


def betweenness(edges: DataFrame, pivots: int | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """Id, betweenness (share of all pairs), size 7 + 10 t / max.

    Every node's shortest paths are counted on their own, so sources are dealt over tasks; each task holds the edges, which is what
    the operator is for: graphs of topics and top words, reduced by ``sub_network``. Edges are counted before any is collected;
    more than ``most_edges`` are refused. With ``pivots`` the paths of about so many nodes, drawn by a hash, stand for all nodes'.
    """
    spark = edges.sparkSession
    rows = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("weight"))
    if rows.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges for betweenness; reduce the graph first")
    near = spark.sparkContext.broadcast({k: sorted(v) for k, v in _adjacency(rows.toPandas()).items()})
    n = len(near.value)

    def run(batches):
        for batch in batches:
            score: dict[str, float] = {}
            for s in batch["id"]:
                stack, before, paths, depth, queue = [], {s: []}, {s: 1.0}, {s: 0}, deque([s])
                while queue:
                    v = queue.popleft()
                    stack.append(v)
                    for w in near.value[v]:
                        if w not in depth:
                            depth[w], before[w], paths[w] = depth[v] + 1, [], 0.0
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(stack, 0.0)
                for w in reversed(stack):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        score[w] = score.get(w, 0.0) + share[w]
            yield pd.DataFrame({"id": list(score), "part": list(score.values())})

    sources = nodes(rows).select("id")
    drawn = sources if pivots is None or pivots >= n else sources.orderBy(F.xxhash64("id")).limit(pivots)
    sums = drawn.mapInPandas(run, "id string, part double").groupBy("id").agg(F.sum("part").alias("part"))
    scale = (n / min(n, pivots or n)) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    found = sources.join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))
    top = found.agg(F.max("betweenness").alias("_m"))
    return found.join(F.broadcast(top)).select("id", "betweenness", (7 + 10 * F.coalesce(F.try_divide("betweenness", "_m"), F.lit(0.0))).alias("size"))  # one row


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Share of the weight within communities less what random ends would give; ``communities``: id, community."""
    own = communities.select(F.col("id").cast("string").alias("id"), "community")
    both = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("weight"))
    both = both.join(own.toDF("source", "_a"), "source").join(own.toDF("target", "_b"), "target")
    ends = both.select(F.col("_a").alias("c"), "weight").unionByName(both.select(F.col("_b").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    total, within = both.agg(F.sum("weight"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0))).first()
    return within / total - ends.agg(F.sum(F.pow(F.col("d") / (2 * total), 2))).first()[0]


def _moved_together(edges: DataFrame, rounds: int) -> DataFrame:
    """One level of local moving on a graph of any size: id, community (one of its members).

    In each round about half of the nodes, by a hash, go where their weight gains most; a community's degree comes by a join.
    """
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("to"), "weight").unionByName(edges.where("source <> target").select(F.col("target").alias("id"), F.col("source").alias("to"), "weight"))
    ends = written(ends.groupBy("id", "to").agg(F.sum("weight").alias("weight")), "louvain-ends")
    degrees = written(ends.groupBy("id").agg(F.sum("weight").alias("degree")), "louvain-degrees")
    total = degrees.agg(F.sum("degree")).first()[0] or 1.0
    own = written(degrees.select("id", F.col("id").alias("community")), "louvain-own")
    for step in range(rounds):
        sizes = written(own.join(degrees, "id").groupBy("community").agg(F.sum("degree").alias("inside")), "louvain-sizes")
        links = ends.where("id <> to").join(own.toDF("to", "community"), "to").groupBy("id", "community").agg(F.sum("weight").alias("links"))
        stay = own.select("id", "community", F.lit(0.0).alias("links"))
        tried = links.unionByName(stay).groupBy("id", "community").agg(F.sum("links").alias("links")).join(sizes, "community").join(degrees, "id").join(own.toDF("id", "present"), "id")
        inside = F.col("inside") - F.when(F.col("community") == F.col("present"), F.col("degree")).otherwise(0.0)
        gain = F.col("links") - inside * F.col("degree") / total
        # a move has to gain; equal gains go to the smaller name
        order = F.struct(gain + F.when(F.col("community") == F.col("present"), 1e-12).otherwise(0.0), F.hash("community"), F.col("community"))
        best = tried.groupBy("id").agg(F.max_by("community", order).alias("best"), F.first("present").alias("present"))
        free = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0
        moved = written(best.select("id", F.when(free, F.col("best")).otherwise(F.col("present")).alias("community"), (free & (F.col("best") != F.col("present"))).alias("moved")), "louvain-moved")
        own = moved.select("id", "community")
        if step and not moved.agg(F.max("moved")).first()[0]:
            break
    return own


def louvain(edges: DataFrame, seed: int = 1, most_edges: int = MOST_EDGES, rounds: int = 8) -> DataFrame:
    """Id, community by greedy modularity.

    A graph of more than ``most_edges`` edges first has its nodes moved together and merged by joins, level by level, until it is
    small enough (or nothing merges any more); the rest is done in one task, nodes being visited in a seeded order.
    """
    rows = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("weight"))
    names = None
    while (n := rows.count()) > most_edges:
        own = _moved_together(rows, rounds)
        names = own.toDF("id", "_c") if names is None else names.join(own.toDF("_c", "_next"), "_c").select("id", F.col("_next").alias("_c"))
        names = written(names, "louvain-names")
        merged = rows.join(own.toDF("source", "_s"), "source").join(own.toDF("target", "_t"), "target").groupBy(F.least("_s", "_t").alias("source"), F.greatest("_s", "_t").alias("target"))
        rows = written(merged.agg(F.sum("weight").alias("weight")), "louvain-merged")
        if rows.count() >= n:
            break
    if rows.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges are left that no community merges; reduce the graph first")
    found = rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda pdf: _louvain(pdf, seed), "id string, community long")
    return found if names is None else names.join(found.withColumnRenamed("id", "_c"), "_c").select("id", "community")


def _louvain(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """All levels on a graph that one task holds; a weight between a node and itself counts as inside it."""
    near = _adjacency(pdf)
    names = {v: v for v in near}  # node -> its present supernode
    rng, level = random.Random(seed), near
    while True:
        total = sum(sum(v.values()) for v in level.values()) or 1.0
        own = {v: v for v in level}
        degree = {v: sum(ws.values()) for v, ws in level.items()}
        inside = dict(degree)
        moved_any, order = False, sorted(level)
        rng.shuffle(order)
        moved = True
        while moved:
            moved = False
            for v in order:
                links: dict = {}
                for w, x in level[v].items():
                    if w != v:
                        links[own[w]] = links.get(own[w], 0.0) + x
                inside[own[v]] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - inside.get(c, 0.0) * degree[v] / total  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=own[v])
                if gain(best) <= gain(own[v]) + 1e-12:
                    best = own[v]
                inside[best] = inside.get(best, 0.0) + degree[v]
                if best != own[v]:
                    own[v], moved, moved_any = best, True, True
        names = {v: own[c] for v, c in names.items()}
        if not moved_any:
            break
        merged: dict = {}
        for v, ws in level.items():
            for w, x in ws.items():
                to = merged.setdefault(own[v], {})
                to[own[w]] = to.get(own[w], 0.0) + x
        level = merged
    codes = {c: k for k, c in enumerate(sorted(set(names.values())))}
    return pd.DataFrame({"id": sorted(names), "community": [codes[names[v]] for v in sorted(names)]})
