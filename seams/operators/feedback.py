"""Decisions of reviewers: an append-only log, and what follows from it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.operators.pairs import canonical
from seams.schemas import FEEDBACK


def _key(log: DataFrame) -> DataFrame:
    return log.withColumn("key_a", F.least("comp_a", "comp_b")).withColumn("key_b", F.greatest("comp_a", "comp_b"))


def latest(log: DataFrame) -> DataFrame:
    """The last row (decided_at, seq) of each unordered pair, without pairs that were deleted last. Listed in the order of first mention (`first_seq`)."""
    order = F.struct("decided_at", "seq")
    rest = [c for c in log.columns]
    last = _key(log).groupBy("key_a", "key_b").agg(F.max_by(F.struct(*rest), order).alias("row"), F.min("seq").alias("first_seq"))
    out = last.select("row.*", "first_seq")
    return out.where("not coalesce(deleted, false)") if "deleted" in rest else out


def labels(log: DataFrame) -> DataFrame:
    """(comp_a, comp_b, label) by canonical pair."""
    return canonical(latest(log).select("comp_a", "comp_b", "label"))


def stats(decisions: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected, last_updated (`never` without any)."""
    return decisions.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("accepted"), F.count_if(F.col("label") == 0).alias("rejected"), F.coalesce(F.max(F.col("decided_at").cast("string")), F.lit("never")).alias("last_updated"))


def sufficiency(stat: DataFrame) -> DataFrame:
    """One row with `sufficient`: three decisions of either kind and ten in all."""
    return stat.select("total", "accepted", "rejected", ((F.col("accepted") >= 3) & (F.col("rejected") >= 3) & (F.col("total") >= 10)).cast("int").alias("sufficient"))


def validate(rows: DataFrame) -> DataFrame:
    """rows (comp_a, comp_b, label as text) with label as 0 or 1 and valid: both names there and the label one of 0, 1, true, false."""
    label = F.lower(F.trim(F.col("label").cast("string")))
    number = F.when(label.isin("1", "true"), 1).when(label.isin("0", "false"), 0)
    good = number.isNotNull() & (F.trim(F.coalesce("comp_a", F.lit(""))) != "") & (F.trim(F.coalesce("comp_b", F.lit(""))) != "")
    return rows.withColumn("label", number).withColumn("valid", good)


def template(ranked: DataFrame, decided: DataFrame, k: int) -> DataFrame:
    """The k best pairs with their stored label (null: to be decided)."""
    best = ranked.orderBy(F.desc("boundary_score"), "comp_a", "comp_b").limit(k)
    return with_decisions(best, decided)


def with_decisions(report: DataFrame, decided: DataFrame) -> DataFrame:
    """A report's pairs with the stored label of the unordered pair."""
    d = canonical(decided.select("comp_a", "comp_b", "label")).toDF("key_a", "key_b", "label")
    return _key(report).join(d, ["key_a", "key_b"], "left").drop("key_a", "key_b")


class FeedbackLog:
    """A log at a path: rows are only ever added, as small Parquet files; `compact` rewrites it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All rows; none where nothing has been written."""
        try:
            return self.spark.read.schema(FEEDBACK).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], FEEDBACK)

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[f.name for f in self.spark.createDataFrame([], FEEDBACK).schema]).write.mode("append").parquet(self.path)

    def _stamped(self, rows: DataFrame, deleted: bool = False) -> DataFrame:
        start = self.read().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        for name, value in (("boundary_score", 0.0), ("confidence", 0.0), ("rationale_text", ""), ("decided_by", "architect"), ("run_id", "")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(value))
        seq = F.row_number().over(W.orderBy("comp_a", "comp_b") if "seq" not in rows.columns else W.orderBy("seq")) - 1 + start
        return rows.withColumn("decided_at", F.lit(datetime.now(UTC).replace(tzinfo=None).isoformat())).withColumn("seq", seq.cast("long")).withColumn("deleted", F.lit(deleted))

    def record(self, comp_a: str, comp_b: str, label: int, **more) -> None:
        row = {"comp_a": comp_a, "comp_b": comp_b, "label": int(label)} | more
        self._append(self._stamped(self.spark.createDataFrame([row], ", ".join(f"{k} {'int' if k == 'label' else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))))

    def bulk(self, rows: DataFrame) -> tuple[int, int]:
        """Add the valid rows; how many were added and how many skipped."""
        checked = validate(rows).cache()
        added = checked.where("valid").count()
        skipped = checked.count() - added
        if added:
            self._append(self._stamped(checked.where("valid").drop("valid")))
        checked.unpersist()
        return added, skipped

    def delete(self, comp_a: str, comp_b: str) -> bool:
        """Add a row that ends a pair's decision; False where there is none."""
        if not self.get(comp_a, comp_b).count():
            return False
        self._append(self._stamped(self.spark.createDataFrame([(comp_a, comp_b, None)], "comp_a string, comp_b string, label int"), deleted=True))
        return True

    def clear(self) -> int:
        n = self.entries().count()
        self.spark.createDataFrame([], FEEDBACK).write.mode("overwrite").parquet(self.path)
        return n

    def entries(self) -> DataFrame:
        return latest(self.read()).orderBy("first_seq")

    def get(self, comp_a: str, comp_b: str) -> DataFrame:
        return latest(self.read()).where((F.least("comp_a", "comp_b") == min(comp_a, comp_b)) & (F.greatest("comp_a", "comp_b") == max(comp_a, comp_b)))

    def training(self) -> DataFrame:
        """Pairs as they were given, with labels."""
        return self.entries().select("comp_a", "comp_b", "label")

    def stats(self) -> DataFrame:
        return stats(latest(self.read()))

    def compact(self) -> None:
        rows = [tuple(r) for r in self.read().toLocalIterator()]
        self.spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.mode("overwrite").parquet(self.path)
