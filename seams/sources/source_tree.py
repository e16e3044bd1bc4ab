"""Files of folders, hidden and underscored names included, as a data source.

Spark's own file index leaves out names that begin with a dot or an underscore, such as
__init__.py. This source lists paths on the driver and reads them in tasks, a slice of paths each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seams.config import CODE_SUFFIXES, SKIPPED_FOLDERS

SCHEMA = "path string, name string, content string, bytes binary, error string"


def list_files(root: str, suffixes: tuple[str, ...], recursive: bool = True) -> list[str]:
    """Paths below a folder (or the file itself) with one of the suffixes in any case, in order."""
    if os.path.isfile(root):
        return [root]
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in SKIPPED_FOLDERS) if recursive else []
        found += [os.path.join(folder, n) for n in names if n.lower().endswith(suffixes)]
    return sorted(found)


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["path"].split("\n")
        self.suffixes = tuple(options.get("suffixes", ",".join(CODE_SUFFIXES)).lower().split(","))
        self.recursive = options.get("recursive", "true") == "true"
        self.binary = options.get("binary", "false") == "true"
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", "200")))

    def partitions(self) -> list[InputPartition]:
        paths = sorted({p for r in self.roots for p in list_files(r, self.suffixes, self.recursive)})
        return [_Slice(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                yield path, os.path.basename(path), None if self.binary else raw.decode("utf-8", "ignore"), raw if self.binary else None, None
            except OSError as e:  # one unreadable file does not end the scan
                yield path, os.path.basename(path), None, None, str(e)


class SourceTree(DataSource):
    """Options: path (roots, one a line), suffixes (comma-joined), recursive, binary, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_files(spark: SparkSession, roots, suffixes=tuple(CODE_SUFFIXES), recursive: bool = True, binary: bool = False) -> DataFrame:
    """(path, name, content, bytes, error) of the files below roots."""
    spark.dataSource.register(SourceTree)
    roots = [roots] if isinstance(roots, str) else list(roots)
    return spark.read.format("source_tree").option("suffixes", ",".join(suffixes)).option("recursive", str(recursive).lower()).option("binary", str(binary).lower()).load("\n".join(roots))
