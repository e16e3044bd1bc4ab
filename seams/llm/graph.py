"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seams.llm.store import materialize, scratch


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (u, v) as a table, and its number of rows and the sum of their hashes."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, most_rounds: int = 100, keep: int = 0) -> DataFrame:
    """(node, root) for each node with an edge (u, v), as a table; root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges
    no longer change. A step is a minimum per node, combined before its shuffle, and a
    join that brings it back, so hubs are never gathered; each round is a written table. Edges that still
    change after most_rounds are an error: what they give would not be whole. keep: as for materialize.
    """
    with scratch(edges.sparkSession):
        now, before = _marked(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for _ in range(most_rounds if before[0] else 0):
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            joined = down.join(least, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            now, after = _marked(small)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components have not settled in {most_rounds} rounds")
        found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return materialize(found, "components", keep=1 + keep)
