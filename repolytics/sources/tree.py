"""Source files by a reader that never enters ignored folders.

The folder is walked once, while the read is planned; ignored names are left out before
anything below them is listed.  Files are dealt to partitions by their sizes.  Files above
the size cap and files that are no UTF-8 text come as rows without content that say so, in
the same pass as the others.  The folder must be mounted where the executors run.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from repolytics.functions.predicates import LANGUAGES
from repolytics.operators.code import IGNORED_DIRS, MAX_FILE_BYTES

BY_MARK = {mark: language for language, marks in LANGUAGES.items() for mark in marks.split()}
PARTITION_BYTES = 32 << 20
FILE_BYTES = 64 << 10  # what opening a file counts as


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, float]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: frozenset[str], most: int, each: int):
        self.root, self.ignored, self.most, self.each, self.languages = root, ignored, most, each, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Languages are chosen before files are dealt; other filters are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("language",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.languages = wanted if self.languages is None else self.languages & wanted
            else:
                yield f

    def listed(self) -> Iterator[tuple[str, str, int, float]]:
        """Relative path, language, bytes, mtime of every source file outside ignored folders, in order."""
        folders = [""]
        while folders:
            folder = folders.pop()
            try:
                found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
            except OSError:
                continue  # it went meanwhile, or may not be read
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in self.ignored:
                        folders.append(path)
                elif entry.is_file(follow_symlinks=False):
                    language = BY_MARK.get(os.path.splitext(entry.name)[1].lower())
                    if language and (self.languages is None or language in self.languages):
                        stat = entry.stat(follow_symlinks=False)
                        yield path, language, stat.st_size, stat.st_mtime

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for file in self.listed():
            held.append(file)
            size += min(file[2], self.most) + FILE_BYTES
            if size >= self.each:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, language, size, changed in partition.files:
            content, problem = None, "truncated" if size > self.most else None
            if problem is None:
                try:
                    with open(os.path.join(self.root, path), "rb") as file:
                        content = file.read().decode()
                except UnicodeDecodeError:
                    problem = "skipped"
                except OSError:
                    continue
            yield path, language, size, datetime.fromtimestamp(changed, UTC), content, problem


class Tree(DataSource):
    """Options: path, ignored (names with commas between them), maxBytes, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, language string, bytes bigint, mtime timestamp, content string, problem string"

    def reader(self, schema) -> TreeReader:
        ignored = self.options.get("ignored")
        names = IGNORED_DIRS if ignored is None else [n for n in ignored.split(",") if n]
        return TreeReader(self.options["path"], frozenset(names), int(self.options.get("maxBytes", MAX_FILE_BYTES)), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def source_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, language, bytes, mtime, content, problem (truncated, skipped or null) of the source files below a folder."""
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a reader with pushFilters otherwise
    return spark.read.format("source_tree").options(path=root, **options).load()
