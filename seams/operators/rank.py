"""Scores of pairs: weighted channels, and a boosted classifier learnt from decisions."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.checkpoints import settle
from seams.config import EngineConfig
from seams.functions.text import suggest_name
from seams.schemas import FEATURES

CHANNELS = ("structural", "behavioral", "evolutionary")


def channels(pairs: DataFrame) -> DataFrame:
    """pairs with the three channels, each scaled to 0..1 over all pairs (0 where all are equal)."""
    one = F.lit(1.0)
    raw = {
        "structural": 0.4 * F.col("structural_coupling_weight") + 0.4 * (one - F.col("tfidf_cosine_similarity")) + 0.2 * (one - F.col("semantic_similarity")),
        "behavioral": 0.5 * F.col("runtime_call_frequency") + 0.3 * F.col("temporal_affinity") + 0.2 * F.col("execution_order_stability"),
        "evolutionary": 0.4 * (one - F.col("logical_coupling_score")) + 0.3 * (one - F.col("co_change_frequency")) + 0.3 * F.col("change_sequence_directionality"),
    }
    found = pairs.withColumns({f"raw_{c}": x for c, x in raw.items()})
    spans = found.agg(*[f(f"raw_{c}").alias(f"{n}_{c}") for c in CHANNELS for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = {c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") > 1e-9, (F.col(f"raw_{c}") - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0) for c in CHANNELS}
    return found.crossJoin(F.broadcast(spans)).select(*pairs.columns, *[x.alias(c) for c, x in scaled.items()])


def adaptive_weights(scored: DataFrame, labels: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """One row (w_structural, w_behavioral, w_evolutionary, adapted).

    scored: pairs with channels and label. labels: all decisions, matched by a pair or not. Channels that tell
    accepted from rejected pairs gain weight; with too few decisions, or of one kind, the base weights stay.
    """
    config = config or EngineConfig()
    base = config.weights
    gap = {c: F.abs(F.avg(F.when(F.col("label") == 1, F.col(c))) - F.avg(F.when(F.col("label") == 0, F.col(c)))) for c in CHANNELS}
    stats = scored.agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"), *[g.alias(f"d_{c}") for c, g in gap.items()])
    total = labels.agg(F.count("label").alias("total"))
    row = stats.crossJoin(F.broadcast(total)).withColumn("adapted", (F.col("total") >= config.adaptive_min_labels) & (F.col("yes") > 0) & (F.col("no") > 0))
    every = sum((F.col(f"d_{c}") for c in CHANNELS), F.lit(0.0))
    raw = {c: base[c] * (1 + config.adaptive_alpha * F.col(f"d_{c}") / F.when(every > 0, every).otherwise(1.0)) for c in CHANNELS}
    whole = sum(raw.values(), F.lit(0.0))
    return row.select(*[F.when(F.col("adapted"), raw[c] / whole).otherwise(base[c]).alias(f"w_{c}") for c in CHANNELS], F.col("adapted").cast("int").alias("adapted"))


def composite(scored: DataFrame, weights: DataFrame, bonus: float = 0.15) -> DataFrame:
    """comp_a, comp_b, boundary_score, confidence, rationale, suggested_service, highest score first."""
    both = scored.crossJoin(F.broadcast(weights))
    parts = {c: F.col(c) * F.col(f"w_{c}") for c in CHANNELS}
    score = sum(parts.values(), F.lit(0.0))
    score = F.when(F.col("cross_layer_flag") > 0, F.least(F.lit(1.0), score + bonus)).otherwise(score)
    entries = [x for c in CHANNELS for x in (F.lit(f"{c}_channel"), F.round(parts[c], 5))]
    entries += [F.lit("cross_layer_bonus"), F.round(F.col("cross_layer_flag") * bonus, 5), F.lit("weights_adapted"), F.col("adapted").cast("double")]
    entries += [x for c in CHANNELS for x in (F.lit(f"w_{c}"), F.round(F.col(f"w_{c}"), 4))]
    return both.select("comp_a", "comp_b", score.alias("boundary_score"), score.alias("confidence"), F.create_map(*entries).alias("rationale"), suggest_name(F.col("comp_a"), F.col("comp_b")).alias("suggested_service"))


def top(ranked: DataFrame, k: int) -> DataFrame:
    """The k pairs of the highest scores; ties in the order of names."""
    return ranked.orderBy(F.desc("boundary_score"), "comp_a", "comp_b").limit(k)


#: Minority rows up to this many are told to every task that looks for neighbours; decisions are made by people.
MOST_MINORITY = 100_000
#: Rows of labelled pairs that one partition of the training data has.
TRAINING_ROWS = 50_000


class TooMany(ValueError):
    """More labelled rows of the lesser class than a task can hold."""


def _assembled(pairs: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(pairs)


def _neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(id, place, other): the features of the k nearest other rows (id, f) of each, by distance and then id, from place 1."""
    known = rows.orderBy("id").toPandas()  # at most MOST_MINORITY
    ids, f = known.id.to_numpy(np.int64), np.array(known.f.tolist(), float).reshape(len(known), -1)
    shared = rows.sparkSession.sparkContext.broadcast((ids, f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, f = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo in range(0, len(own), 64):
                at = np.searchsorted(ids, own[lo : lo + 64])
                far = ((f[at][:, None, :] - f[None]) ** 2).sum(2)
                far[np.arange(len(at)), at] = np.inf
                near = np.argsort(far, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_pydict({"id": np.repeat(ids[at], near.shape[1]), "place": np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(at)), "other": pa.array(f[near.ravel()].tolist(), pa.list_(pa.float64()))})

    return rows.select("id").mapInArrow(run, "id bigint, place int, other array<double>")


def smote(labelled: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """labelled (FEATURES, label) with as many rows of class 1 as of class 0, where both have three or more.

    New rows lie between a row of class 1 and one of its k nearest (Chawla et al. 2002). Rows of class 1 that are equal are
    neighbours of each other. More than MOST_MINORITY rows of class 1 are refused.
    """
    known = labelled.where("label is not null")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    yes, no = counts.get(1, 0), counts.get(0, 0)
    plain = known.select(*FEATURES, "label")
    if min(yes, no) < 3 or yes >= no:
        return plain
    if yes > MOST_MINORITY:
        raise TooMany(f"resampling holds at most {MOST_MINORITY} rows of class 1")
    near = min(k, yes - 1)
    own = known.where("label = 1").select(F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("f"))
    own = own.withColumn("nth", F.row_number().over(W.partitionBy("f").orderBy("f")))  # tells equal rows apart
    rows = settle(own.select(F.xxhash64("f", "nth").alias("id"), "f"))
    copies = -(-(no - yes) // yes)
    asked = rows.select("id", "f", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("turn")).withColumn("place", (F.pmod(F.xxhash64("id", "turn", F.lit(seed)), F.lit(near)) + 1).cast("int"))
    asked = asked.orderBy("turn", F.xxhash64("id", F.lit(seed)), "id").limit(no - yes)
    share = F.pmod(F.xxhash64("id", "turn", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003
    made = asked.join(_neighbours(rows, near), ["id", "place"]).select(F.zip_with("f", "other", lambda x, y: x + share * (y - x)).alias("f"))
    return plain.unionByName(made.select(*[F.col("f")[i].alias(f) for i, f in enumerate(FEATURES)], F.lit(1).alias("label")))


def _ready(data: DataFrame) -> DataFrame:
    """data with features as a vector and label as a double, in few partitions."""
    data = settle(data)
    data = data.coalesce(max(1, data.count() // TRAINING_ROWS))
    return settle(_assembled(data).withColumn("label", F.col("label").cast("double")).select("features", "label"))


def _boosted(config: EngineConfig, trees: int, subsample: float):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=trees, maxDepth=config.depth, stepSize=config.step, subsamplingRate=subsample, seed=config.seed, checkpointInterval=20)


def stop_after(losses: list[float], patience: int, least: float = 1e-4) -> int | None:
    """The number of trees after which the loss had not fallen by `least` for `patience` trees; None if that is not reached."""
    best, at = float("inf"), 0
    for i, x in enumerate(losses):
        if x < best - least:
            best, at = x, i
        elif i - at >= patience:
            return i + 1
    return None


def _first_trees(model, n: int):
    """The model of the first n trees alone."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession

    context = SparkSession.getActiveSession().sparkContext
    own, ml, new = model._java_obj, context._jvm.org.apache.spark.ml, context._gateway.new_array
    trees, weights = new(ml.regression.DecisionTreeRegressionModel, n), new(context._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = own.trees()[i], own.treeWeights()[i]
    return GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid(), trees, weights, own.numFeatures(), 2))


def train(labelled: DataFrame, config: EngineConfig | None = None):
    """A boosted tree model of label, or None with too few labelled pairs or a single class.

    A tenth of the resampled rows validates: boosting stops when its loss has not fallen for `patience` trees. Trees
    depend on those before only: a few are grown first, and all where they do not show the end.
    """
    config = config or EngineConfig()
    known = labelled.where("label is not null")
    stats = known.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes")).first()
    if stats.n < config.min_training or stats.classes < 2:
        return None
    data = _ready(smote(known, seed=config.seed)).withColumn("aside", F.pmod(F.xxhash64("features", "label", F.lit(config.seed)), F.lit(10)) == 0)
    kept, aside = data.where("not aside").cache(), data.where("aside").cache()
    if not kept.select("label").distinct().count() == 2 or not aside.limit(1).count():
        kept, aside = data, data
    trees = min(config.trees, 2 * config.patience)
    while True:
        model = _boosted(config, trees, config.subsample).fit(kept)
        stop = stop_after(list(model.evaluateEachIteration(aside)), config.patience)
        if stop is not None:
            model = _first_trees(model, stop)
        if stop is not None or trees == config.trees:
            return model
        trees = config.trees


def importances(model) -> dict[str, float]:
    """Importance of each feature, the largest first."""
    values = zip(FEATURES, map(float, model.featureImportances.toArray()))
    return dict(sorted(values, key=lambda x: -x[1]))


def supervised(pairs: DataFrame, model) -> DataFrame:
    """As `composite`, scored by the model; the rationale has the 8 largest products of value and importance."""
    from pyspark.ml.functions import vector_to_array

    weight = importances(model)
    whole = sum(weight.values()) or 1.0
    parts = F.array(*[F.struct(F.round(F.col(f) * (weight[f] / whole), 5).alias("value"), F.lit(f).alias("name"), F.lit(i).alias("place")) for i, f in enumerate(FEATURES)])
    order = F.transform(parts, lambda p: F.struct((-F.abs(p["value"])).alias("size"), p["place"].alias("place"), p["name"].alias("name"), p["value"].alias("value")))
    first = F.slice(F.array_sort(order), 1, 8)
    rationale = F.map_from_entries(F.transform(first, lambda p: F.struct(p["name"], p["value"])))
    score = vector_to_array("probability")[1]
    return model.transform(_assembled(pairs)).select("comp_a", "comp_b", score.alias("boundary_score"), score.alias("confidence"), rationale.alias("rationale"), suggest_name(F.col("comp_a"), F.col("comp_b")).alias("suggested_service"))


def cross_validate(labelled: DataFrame, config: EngineConfig | None = None, folds: int = 5) -> DataFrame:
    """(fold, auc, mean, std): the area under the ROC curve on each fold of the resampled rows, and its mean and deviation over the folds.

    Folds hold equal shares of both labels. No rows with a single class or fewer than two rows a fold.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    config = config or EngineConfig()
    data = _ready(smote(labelled.where("label is not null"), seed=config.seed))
    stats = data.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes")).first()
    found = []
    if stats.classes == 2 and stats.n >= 2 * folds:
        order = W.partitionBy("label").orderBy(F.xxhash64("features", F.lit(config.seed)))
        data = settle(data.withColumn("fold", (F.row_number().over(order) - 1) % folds).coalesce(1 + stats.n // TRAINING_ROWS))

        def score(k: int) -> float:
            model = _boosted(config, config.trees, 1.0).fit(data.where(F.col("fold") != k))
            return float(BinaryClassificationEvaluator().evaluate(model.transform(data.where(F.col("fold") == k))))

        with ThreadPool(folds) as pool:  # a tree of few rows leaves the cluster idle
            found = pool.map(inheritable_thread_target(labelled.sparkSession)(score), range(folds))
    mean, std = (float(np.mean(found)), float(np.std(found))) if found else (0.0, 0.0)
    return labelled.sparkSession.createDataFrame([(k, x, mean, std) for k, x in enumerate(found)], "fold int, auc double, mean double, std double")


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    """A saved model; None where there is none."""
    from pyspark.ml.classification import GBTClassificationModel
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return GBTClassificationModel.load(path)
    except (AnalysisException, Py4JJavaError) as e:
        if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise
