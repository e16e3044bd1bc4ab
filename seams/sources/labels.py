"""Labels of pairs in JSON files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seams.schemas import LABELS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(comp_a, comp_b, label, seq) of an array of objects in one file; null labels are left out. No rows where it cannot be read."""
    if "://" not in path and not os.path.isfile(path):
        return spark.createDataFrame([], f"{LABELS}, seq bigint")
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode_outer(F.from_json("value", f"array<struct<{LABELS.replace(' ', ':')}>>".replace(",:", ","))).alias("seq", "row"))
    return rows.where("row.label is not null and row.comp_a is not null and row.comp_b is not null").select("row.*", F.col("seq").cast("long").alias("seq"))
