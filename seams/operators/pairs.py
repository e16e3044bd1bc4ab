"""Candidate pairs and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seams.functions.text import cross_layer
from seams.operators.similarity import neighbours
from seams.schemas import FEATURES


def canonical(pairs: DataFrame, a: str = "comp_a", b: str = "comp_b") -> DataFrame:
    """comp_a, comp_b in the order of names, other columns as they are."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(F.least(a, b).alias("comp_a"), F.greatest(a, b).alias("comp_b"), *rest)


def candidates(edges: DataFrame, sims: DataFrame, behavior: DataFrame, evolution: DataFrame, units: DataFrame, k: int = 50, least: float = 0.05) -> DataFrame:
    """(comp_a, comp_b): pairs with an edge, among each other's most similar, or with runtime or history features; known units only."""
    near = neighbours(sims, k, least)
    parts = [edges.select("source", "target"), near.select("unit", "other"), behavior.select("comp_a", "comp_b"), evolution.select("comp_a", "comp_b")]
    every = None
    for p in parts:
        p = canonical(p.toDF("x", "y"), "x", "y")
        every = p if every is None else every.unionByName(p)
    known = units.select("unit_id").distinct()
    return every.where("comp_a <> comp_b").distinct().join(known.withColumnRenamed("unit_id", "comp_a"), "comp_a", "left_semi").join(known.withColumnRenamed("unit_id", "comp_b"), "comp_b", "left_semi")


def assemble(pairs: DataFrame, units: DataFrame, edges: DataFrame, sims: DataFrame, semantic: DataFrame, centrality: DataFrame, behavior: DataFrame, evolution: DataFrame) -> DataFrame:
    """One row per pair (comp_a, comp_b) with the FEATURES; what is missing is 0."""
    key = ["comp_a", "comp_b"]
    links = canonical(edges.select("source", "target", "weight"), "source", "target").groupBy(*key).agg(F.max("weight").alias("structural_coupling_weight"))
    inherits = edges.where("kind = 'inheritance'").select(F.col("source").alias("comp_a"), F.col("target").alias("comp_b"), F.lit(1).alias("inheritance_linked")).distinct()
    out = pairs.join(links, key, "left").join(inherits, key, "left")
    for table, name in ((sims, "tfidf_cosine_similarity"), (semantic, "semantic_similarity")):
        out = out.join(canonical(table.select("a", "b", F.col("sim").alias(name)), "a", "b"), key, "left")
    for table in (behavior, evolution):
        out = out.join(canonical(table), key, "left")
    for side in ("a", "b"):
        c = centrality.select(F.col("unit_id").alias(f"comp_{side}"), F.col("pagerank").alias(f"pagerank_{side}"), F.col("betweenness").alias(f"betweenness_{side}"))
        u = units.select(F.col("unit_id").alias(f"comp_{side}"), *[F.col(x).alias(f"{x}_{side}") for x in ("imports", "annotations", "domain_hints")])
        out = out.join(c, f"comp_{side}", "left").join(u, f"comp_{side}", "left")
    for name, column in (("shared_import_count", "imports"), ("shared_annotation_count", "annotations")):
        out = out.withColumn(name, F.size(F.array_intersect(f"{column}_a", f"{column}_b")))
    out = out.withColumn("cross_layer_flag", cross_layer(F.col("domain_hints_a"), F.col("domain_hints_b")))
    return out.select(*key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def merge_labels(*sources: DataFrame) -> DataFrame:
    """(comp_a, comp_b, label) per unordered pair; later sources stand above earlier ones, and within one the last row (seq) wins. Null labels say nothing."""
    every = None
    for rank, s in enumerate(sources):
        s = canonical(s.where("label is not null").select("comp_a", "comp_b", "label", F.struct(F.lit(rank).alias("rank"), F.col("seq")).alias("order")))
        every = s if every is None else every.unionByName(s)
    return every.groupBy("comp_a", "comp_b").agg(F.max_by("label", "order").alias("label"))


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with label, null where there is none."""
    return features.join(canonical(labels.select("comp_a", "comp_b", "label")), ["comp_a", "comp_b"], "left")
