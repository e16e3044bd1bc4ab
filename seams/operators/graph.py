"""Centrality of units in the import graph."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seams.checkpoints import settle

#: Edges up to this many are told to every task that looks for paths; more need a graph that does not fit a machine.
MOST_EDGES = 2_000_000


class TooLarge(ValueError):
    """A graph has more edges than a task can hold."""


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, every: int = 5, most: int = MOST_EDGES) -> DataFrame:
    """(unit_id, pagerank) by power iteration over weighted edges (source, target, weight).

    Edges from or to unknown nodes are left out. The mass of nodes without outgoing edges is spread evenly. Stops when the sum of changes
    is below n x tolerance; after `rounds` it raises, unless tolerance is 0. A graph of at most MOST_EDGES
    nodes and edges (they are counted) is ranked in memory; in a larger one a round is a join
    and an aggregation, and every few rounds the ranks are checkpointed, which ends their lineage.
    """
    nodes = nodes.select("unit_id").distinct().cache()
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    for end in ("source", "target"):
        edges = edges.join(nodes.withColumnRenamed("unit_id", end), end, "left_semi")
    if n <= most and edges.count() <= most:
        names = np.sort(nodes.toPandas().unit_id.to_numpy(str))
        return nodes.sparkSession.createDataFrame(pd.DataFrame({"unit_id": names, "pagerank": _ranks(names, edges.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("weight")).toPandas(), alpha, rounds, tolerance)}))
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    moves = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")).join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")).cache()
    ends = nodes.join(out, F.col("unit_id") == F.col("source"), "left_anti").cache()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        lost = ranks.join(ends, "unit_id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        got = moves.join(ranks, F.col("source") == F.col("unit_id")).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(got, F.col("unit_id") == F.col("target"), "left").crossJoin(F.broadcast(lost)).select("unit_id", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), F.col("rank").alias("old"))
        if k % every and k < rounds and not tolerance:
            ranks = new.select("unit_id", "rank")
            continue
        new = settle(new)
        ranks = new.select("unit_id", "rank")
        if tolerance and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            return ranks.withColumnRenamed("rank", "pagerank")
    if tolerance:
        raise ArithmeticError(f"ranks have not settled in {rounds} rounds")
    return ranks.withColumnRenamed("rank", "pagerank")


def _ranks(names: np.ndarray, edges: pd.DataFrame, alpha: float, rounds: int, tolerance: float) -> np.ndarray:
    n = len(names)
    source, target = (np.searchsorted(names, edges[c].to_numpy(str)) for c in ("source", "target"))
    total = np.bincount(source, edges.weight, n)
    share, ends = edges.weight.to_numpy() / total[source], total == 0
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        old = rank
        rank = (1 - alpha) / n + alpha * (np.bincount(target, old[source] * share, n) + old[ends].sum() / n)
        if tolerance and np.abs(rank - old).sum() < n * tolerance:
            return rank
    if tolerance:
        raise ArithmeticError(f"ranks have not settled in {rounds} rounds")
    return rank


def paths_through(source: str, out: dict[str, list[tuple[str, float]]]) -> dict[str, float]:
    """Brandes' dependencies of one source on all other nodes, with weights as distances."""
    order, before, count, far = [], {source: []}, {source: 1.0}, {}
    tentative, heap = {source: 0.0}, [(0.0, 0, source)]
    step = 1
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in far:
            continue
        far[v] = d
        order.append(v)
        for w, length in out.get(v, ()):
            x = d + length
            if w not in far and x < tentative.get(w, float("inf")):
                tentative[w], before[w], count[w] = x, [v], count[v]
                heapq.heappush(heap, (x, step, w))
                step += 1
            elif w not in far and x == tentative.get(w):
                before[w].append(v)
                count[w] += count[v]
    depends = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            depends[v] += count[v] / count[w] * (1 + depends[w])
    depends.pop(source)
    return depends


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 50, seed: int = 42) -> DataFrame:
    """(unit_id, betweenness), normalised; with over `pivots` nodes estimated from that many, chosen by a seeded hash.

    Weights are distances. Pivots are dealt over tasks; each task holds the edges, which are checked to be at most MOST_EDGES.
    """
    nodes = nodes.select("unit_id").distinct()
    n = nodes.count()
    chosen = nodes.orderBy(F.xxhash64("unit_id", F.lit(seed)), "unit_id").limit(pivots)
    k = min(n, pivots)
    table = edges.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("weight")).where("source <> target")
    if table.count() > MOST_EDGES:
        raise TooLarge(f"betweenness needs at most {MOST_EDGES} edges")
    out: dict[str, list[tuple[str, float]]] = {}
    for r in table.orderBy("source", "target").toLocalIterator():
        out.setdefault(r.source, []).append((r.target, r.weight))
    shared = nodes.sparkSession.sparkContext.broadcast(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                found = paths_through(source, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["unit_id", "part"])

    parts = chosen.repartition(max(1, min(k, 200)), "unit_id").mapInArrow(run, "unit_id string, part double").groupBy("unit_id").agg(F.sum("part").alias("total"))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / k if k else 1.0)
    return nodes.join(parts, "unit_id", "left").select("unit_id", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))
