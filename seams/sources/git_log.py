"""Commits of a repository as a data source over `git log`."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "sha string, parent string, committed_ts bigint, author string, message string, paths array<string>"
_MARK, _FIELD = "\x1e", "\x1f"


def read_log(repository: str, days: int, most: int, since: float | None = None) -> Iterator[tuple]:
    """Commits of HEAD, newest first, with the paths changed against the first parent (of renames the new one). Nothing where git cannot read."""
    limit = f"--since={int(since)}" if since is not None else f"--since={days} days ago"
    command = ["git", "-C", repository, "log", "HEAD", limit, f"-n{most}", "-M", "--diff-merges=first-parent", "--root", "--name-status", "-z", f"--format={_MARK}%H{_FIELD}%P{_FIELD}%ct{_FIELD}%an{_FIELD}%B{_FIELD}"]
    try:
        done = subprocess.run(command, capture_output=True, check=False, timeout=600)
    except (OSError, subprocess.SubprocessError):
        return
    for entry in done.stdout.decode("utf-8", "replace").split(_MARK)[1:]:
        sha, parents, seconds, author, message, rest = entry.split(_FIELD, 5)
        marks, paths = [x.strip("\n") for x in rest.split("\0") if x.strip("\n")], []
        i = 0
        while i < len(marks):
            step = 3 if marks[i][:1] in ("R", "C") else 2
            paths += marks[i + step - 1 : i + step]
            i += step
        yield sha, (parents.split() or [None])[0], int(seconds), author, message.strip(), paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repository, self.days, self.most = options["path"], int(options.get("days", "365")), int(options.get("most", "1000"))
        self.since = options.get("since")

    def read(self, partition) -> Iterator[tuple]:
        yield from read_log(self.repository, self.days, self.most, float(self.since) if self.since else None)


class GitLog(DataSource):
    """Options: path, days, most, since (epoch seconds, instead of days)."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_history(spark: SparkSession, repository: str, days: int = 365, most: int = 1000, since: float | None = None) -> tuple[DataFrame, DataFrame]:
    """commits (sha, parent, committed_ts, author, message) and commit_files (sha, path)."""
    spark.dataSource.register(GitLog)
    reader = spark.read.format("git_log").option("days", str(days)).option("most", str(most))
    log = (reader.option("since", str(since)) if since is not None else reader).load(repository).cache()
    return log.drop("paths"), log.select("sha", F.explode("paths").alias("path"))
