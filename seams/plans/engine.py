"""An analysis from sources to ranked pairs."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seams.checkpoints import settle
from seams.config import EngineConfig
from seams.functions.text import tokenize
from seams.operators import behavior, clusters, evolution, feedback, graph, pairs, rank, similarity, structure
from seams.schemas import CHUNKS, FEATURES
from seams.sources.documents import read_documents
from seams.sources.git_log import read_history
from seams.sources.labels import read_labels
from seams.sources.source_tree import read_files
from seams.sources.traces import read_lines


@dataclass
class Result:
    """DataFrames of one analysis; those of stages that did not run are empty."""

    units: DataFrame
    edges: DataFrame | None = None
    features: DataFrame | None = None
    ranked: DataFrame | None = None
    clusters: DataFrame | None = None
    hot_paths: DataFrame | None = None
    hotspots: DataFrame | None = None
    commits: DataFrame | None = None
    mode: str = "none"
    importances: dict[str, float] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)  # stages beyond their limits, and why


_BEHAVIOR = "comp_a string, comp_b string, " + ", ".join(f"{c} double" for c in FEATURES[6:10])
_EVOLUTION = "comp_a string, comp_b string, " + ", ".join(f"{c} double" for c in FEATURES[10:14])


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def units(self) -> DataFrame:
        files = read_files(self.spark, self.config.code_roots).where("error is null")
        root = self.config.repository and os.path.abspath(self.config.repository).rstrip("/") + "/"
        if root:  # paths as the history has them
            files = files.withColumn("path", F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")))
        return structure.parse_sources(files)

    def structure(self, units: DataFrame) -> DataFrame:
        symbols = structure.symbol_table(units, self.config.register_all_modules)
        imports = units.select(F.col("unit_id").alias("source"), F.posexplode("imports").alias("pos", "name"))
        found = structure.edges(structure.resolve_imports(imports, symbols), self.config.strong_coupling)
        return found.unionByName(structure.inheritance_edges(units, symbols)) if self.config.inheritance_edges else found

    def behavior(self, units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if not self.config.trace_files:
            return self._empty(_BEHAVIOR), None
        parsed = behavior.parse_lines(read_lines(self.spark, self.config.trace_files), self.config.spring_http, self.config.otel_parent_calls)
        events = parsed.select("file", "seq", "ts", "component", "target", "depth")
        if self.config.otel_parent_calls:
            events = events.unionByName(behavior.otel_calls(parsed))
        events = behavior.resolve_events(events, units).cache()
        calls = behavior.call_counts(events)
        found = behavior.pair_features(calls, behavior.window_pairs(events, self.config.trace_window), behavior.totals(events), units, self.config.min_order)
        return found, behavior.hot_paths(calls, self.config.top_k)

    def evolution(self, units: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        c = self.config
        if not c.repository:
            return self._empty(_EVOLUTION), None, None
        since = None if c.as_of is None else c.as_of - c.max_days * evolution.DAY
        commits, files = read_history(self.spark, c.repository, c.max_days, c.max_commits, since)
        files = files.withColumn("path", evolution.normalize_path(F.col("path")))
        now = F.lit(c.as_of) if c.as_of is not None else F.lit(time.time())
        ages = commits.select("sha", (now - F.col("committed_ts")).alias("age"))
        owners = evolution.file_units(units)
        rolled = evolution.unit_rollup(evolution.cochange(files, ages, c.max_commit_files, c.half_life_days), owners, c.min_cochange).cache()
        changes = evolution.unit_changes(evolution.change_counts(files), owners).cache()
        leads = evolution.directionality(rolled, evolution.unit_times(files, commits, owners), c.lead_window_days)
        return evolution.pair_features(rolled, changes, leads), evolution.hotspots(changes, c.top_k), evolution.recent_commits(commits, 10)

    def labels(self) -> DataFrame:
        """Stored decisions, with those of the labels file above them."""
        schema = "comp_a string, comp_b string, label int, seq bigint"
        stored = feedback.latest(feedback.FeedbackLog(self.spark, self.config.feedback_path).read()).select("comp_a", "comp_b", "label", "seq") if self.config.feedback_path else self._empty(schema)
        given = read_labels(self.spark, self.config.labels_file) if self.config.labels_file else self._empty(schema)
        return pairs.merge_labels(stored, given)

    def vectors(self, units: DataFrame, chunks: DataFrame, candidates: DataFrame) -> DataFrame:
        sentences = units.select(F.col("unit_id").alias("unit"), F.col("raw_tokens").alias("words")).where(F.size("words") > 0)
        every = sentences.select("words").unionAll(chunks.where(F.trim("text") != "").select(tokenize(F.col("text")).alias("words")))
        if every.limit(2).count() < 2:
            return self._empty("a string, b string, sim double")
        model = similarity.word_vectors(every, seed=self.config.seed)
        return similarity.vector_cosines(similarity.unit_vectors(model, sentences), candidates.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))

    def train(self, labelled: DataFrame):
        """A model of labelled pairs (FEATURES, label), saved in the output folder, if there is one; None with too few labels."""
        model = rank.train(labelled, self.config)
        if model is not None and self.config.output:
            rank.save(model, f"{self.config.output}/model")
        return model

    def train_from_decisions(self, features: DataFrame) -> tuple[dict[str, float], DataFrame] | None:
        """Importances, and the cross-validation, of a model of all stored and given decisions on pairs (FEATURES); None with too few."""
        labelled = settle(pairs.with_labels(features.drop("label"), self.labels()))
        model = self.train(labelled)
        return None if model is None else (rank.importances(model), rank.cross_validate(labelled, self.config))

    def feature_importances(self) -> dict[str, float]:
        """Of the model in the folder of saved models or of output; none without one."""
        for path in (self.config.saved_model, self.config.output and f"{self.config.output}/model"):
            model = rank.load(path) if path else None
            if model is not None:
                return rank.importances(model)
        return {}

    def analyze(self) -> Result:
        c, spent, began = self.config, {}, time.time()

        def lap(name: str) -> None:
            nonlocal began
            spent[name] = round(time.time() - began, 3)
            began = time.time()

        units = self.units().cache()
        result = Result(units, seconds=spent)
        if not units.limit(1).count():
            return result
        chunks = read_documents(self.spark, c.document_folder) if c.document_folder else self._empty(CHUNKS)
        lap("ingestion")
        edges = self.structure(units).cache()
        texts = units.select(F.col("unit_id").alias("unit"), F.concat_ws(" ", "class_names", "method_names", "annotations", "raw_tokens", "comments").alias("text"))
        weights = similarity.tfidf(texts, c.max_features).cache()
        sims = similarity.cosine_pairs(weights).cache()
        try:
            between = graph.betweenness(units, edges, c.pivots, c.seed)
        except graph.TooLarge as e:
            between, result.refused["betweenness"] = self._empty("unit_id string, betweenness double"), str(e)
        centrality = graph.pagerank(units, edges).join(between, "unit_id", "left")
        lap("structural")
        runtime, result.hot_paths = self.behavior(units)
        lap("behavioral")
        history, result.hotspots, result.commits = self.evolution(units)
        lap("evolutionary")
        found = pairs.candidates(edges, sims, runtime, history, units, c.neighbours, c.min_cosine).cache()
        features = pairs.assemble(found, units, edges, sims, self.vectors(units, chunks, found), centrality, runtime, history)
        labels = self.labels().cache()
        labelled = settle(pairs.with_labels(features, labels))
        result.edges, result.features = edges, labelled
        lap("features")
        model = self.train(labelled)
        if model is None and c.saved_model:
            model = rank.load(c.saved_model)
        if model is not None:
            result.mode, result.importances = "supervised", rank.importances(model)
            result.ranked = rank.supervised(labelled, model)
        else:
            result.mode = "composite"
            scored = rank.channels(labelled).cache()
            result.ranked = rank.composite(scored, rank.adaptive_weights(scored, labels, c), c.cross_layer_bonus)
        try:
            result.clusters = clusters.suggest(weights, c.cluster_size, c.cluster_samples)
        except clusters.TooLarge as e:
            result.refused["clusters"] = str(e)
        lap("ranking")
        if c.output:
            write_report(result, c.output, c.top_k)
        return result


def shown(ranked: DataFrame) -> DataFrame:
    """Report rows: numbers rounded to four digits."""
    rationale = F.map_from_entries(F.transform(F.map_entries("rationale"), lambda e: F.struct(e["key"].alias("key"), F.round(e["value"], 4).alias("value"))))
    return ranked.select("comp_a", "comp_b", F.round("boundary_score", 4).alias("boundary_score"), F.round("confidence", 4).alias("confidence"), rationale.alias("rationale"), "suggested_service")


def write_report(result: Result, folder: str, k: int) -> str:
    """All ranked pairs as Parquet, and report.json with the k best, clusters, hotspots and importances."""
    result.ranked.write.mode("overwrite").parquet(f"{folder}/ranked")
    best = rank.top(result.ranked.sparkSession.read.parquet(f"{folder}/ranked"), k)
    rows = lambda df: [r.asDict(True) for r in df.collect()] if df is not None else []  # noqa: E731  k rows or so
    report = {
        "meta": {"mode": result.mode, "stages": result.seconds, "total_elapsed_s": round(sum(result.seconds.values()), 3), "refused": result.refused},
        "top_boundaries": rows(shown(best)),
        "service_clusters": {str(r.cluster): list(r.units) for r in clusters.as_lists(result.clusters).collect()} if result.clusters is not None else {},
        "feature_importances": result.importances,
        "hotspots": rows(result.hotspots), "hot_paths": rows(result.hot_paths), "commits": rows(result.commits),
        "units_scanned": result.units.count(),
    }
    os.makedirs(folder, exist_ok=True)
    temporary, path = f"{folder}/report.json.tmp", f"{folder}/report.json"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2)
    os.replace(temporary, path)
    return path
