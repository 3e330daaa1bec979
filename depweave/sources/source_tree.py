"""A data source for source trees: ``spark.read.format("source_tree").option("path", root)``.

Spark's own file sources skip names that begin with ``_``, which loses every ``__init__.py``; this one keeps them. The
driver lists names (hidden files and folders left out, links not followed), executors read contents, a batch of files each.
Options: path (folder, seen by driver and executors alike), roots (comma list of folders below it, default all), suffixes
(comma list, default .py,.pyi,.pyx; ``*`` for all), batch (files a partition, default 200), content (default true).
Rows: path relative to ``path``, source, error. A file that can't be read or decoded has a null source and an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from depweave.schema import FILES


@dataclass
class Batch(InputPartition):
    files: list[str]


def listed(root: str, folders: list[str], suffixes: tuple[str, ...]) -> Iterator[str]:
    """Relative paths in a fixed order."""
    for folder in folders or [""]:
        for at, dirs, names in os.walk(os.path.join(root, folder)):
            dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(at, d)))
            for name in sorted(names):
                if not name.startswith(".") and (not suffixes or name.endswith(suffixes)):
                    yield os.path.relpath(os.path.join(at, name), root)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        split = lambda x: [p.strip() for p in x.split(",") if p.strip()]
        self.root = options["path"]
        self.folders = split(options.get("roots", ""))
        suffixes = options.get("suffixes", ".py,.pyi,.pyx")
        self.suffixes = () if suffixes == "*" else tuple(split(suffixes))
        self.batch = int(options.get("batch", "200"))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[Batch]:
        paths = sorted(set(listed(self.root, self.folders, self.suffixes)))
        return [Batch(paths[i : i + self.batch]) for i in range(0, len(paths), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple[str, str | None, str | None]]:
        for path in partition.files:
            if not self.content:
                yield path, None, None
                continue
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", newline="") as f:
                    yield path, f.read(), None
            except (OSError, UnicodeDecodeError) as error:
                yield path, None, f"{type(error).__name__}: {error}"[:300]


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_tree(spark: SparkSession, path: str, roots: list[str] | None = None, content: bool = True, suffixes: str | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("path", path).option("roots", ",".join(roots or [])).option("content", str(content).lower())
    return (reader.option("suffixes", suffixes) if suffixes else reader).load()
