"""Trace logs as streams: calls counted as they come, and co-occurrence with state per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seams.operators.behavior import parse_lines


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, seq, line) of the text files that appear in a folder."""
    raw = spark.readStream.text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def stream_calls(lines: DataFrame) -> DataFrame:
    """Running (component, target, calls, depth_sum); for the update or complete mode."""
    calls = parse_lines(lines).where("grammar = 'call_notation'")
    return calls.groupBy("component", "target").agg(F.count("*").alias("calls"), F.sum("depth").alias("depth_sum"))


def stream_windows(events: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """(file, before, after, n): additions to `window_pairs` from each batch; for the append or update mode.

    events: file, seq, ts (seconds), component. Each file's state holds the events of the last `seconds`,
    so it is bounded by their rate, and goes when the watermark is `seconds` past them. Events that are older than
    the watermark (`late` behind the newest of the batches before) are dropped. Events of one batch may come in any order; one that comes in a later batch than
    an event that follows it is counted with those before it, not with that one.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(frames))
        counts: dict[tuple[str, str], int] = {}
        for ts, seq, component in sorted(zip(rows.ts.astype(int), rows.seq.astype(int), rows.component)):
            held = [h for h in held if h[0] >= ts - seconds]
            for before in {h[2] for h in held if (h[0], h[1]) < (ts, seq)} - {component}:
                counts[before, component] = counts.get((before, component), 0) + 1
            held.append((ts, seq, component))
        state.update(tuple(map(list, zip(*held))))
        state.setTimeoutTimestamp(max(1000 * (max(h[0] for h in held) + seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], a, b, n) for (a, b), n in counts.items()], columns=["file", "before", "after", "n"])

    timed = events.where("ts is not null").withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    return timed.select("file", "seq", "ts", "component", "time").groupBy("file").applyInPandasWithState(run, "file string, before string, after string, n bigint", "ts array<bigint>, seq array<bigint>, component array<string>", "append", GroupStateTimeout.EventTimeTimeout)
