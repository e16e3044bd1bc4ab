"""Lines of trace logs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, seq, line) of the files that exist; seq is in the order of lines. Undecodable bytes are replaced."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if "://" in p or os.path.isfile(p)]
    if not there:
        return spark.createDataFrame([], "file string, seq bigint, line string")
    raw = spark.read.text(there).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    parts = raw.select("file", F.explode(F.split("value", r"[\x0b\x0c\x1c-\x1e\x85  ]")).alias("line"))
    # places are ordered, not consecutive: numbered after lines are cut, so that a line may have any number of parts
    return parts.select("file", F.monotonically_increasing_id().alias("seq"), "line")


def numbered(lines: DataFrame) -> DataFrame:
    """lines with seq from 0 in each file; for small logs."""
    return lines.withColumn("seq", (F.row_number().over(W.partitionBy("file").orderBy("seq")) - 1).cast("long"))
