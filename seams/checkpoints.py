"""Cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir. Where that is unset, in a temporary one, but only if driver and executors are one process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seams-checkpoint-"))
    return df.checkpoint()


def together(spark: SparkSession, *parts: Callable[[], Any]) -> list:
    """The results of parts, whose jobs do not rest on each other and run side by side."""
    with ThreadPool(len(parts)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda part: part()), parts, chunksize=1)
