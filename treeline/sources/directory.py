"""A directory tree as a table: a batch source that also reads empty files and names with a leading dot or underscore."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import IGNORED

SCHEMA = "path string, kind string, content binary"


def scan(top: str, ignored: tuple[str, ...] = IGNORED) -> Iterator[tuple[str, str]]:
    """(relative path, 'blob' or 'tree') in depth-first name order; symbolic links and special files are passed over."""
    stack = [("", top)]
    while stack:
        rel, full = stack.pop()
        if rel:
            yield rel, "tree"
        below = []
        with os.scandir(full) as entries:
            for e in sorted(entries, key=lambda e: e.name.encode("utf-8", "surrogateescape")):
                if e.name in ignored or e.is_symlink():
                    continue
                name = f"{rel}/{e.name}" if rel else e.name
                if e.is_dir(follow_symlinks=False):
                    below.append((name, e.path))
                elif e.is_file(follow_symlinks=False):
                    yield name, "blob"
        stack += reversed(below)


class Slice(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        super().__init__(0)
        self.paths = paths


class Reader(DataSourceReader):
    """The driver lists names; executors read bytes, so the folder must be one that they share."""

    def __init__(self, options: dict):
        self.top = options["path"]
        self.per_task = int(options.get("filesPerTask", "2000"))

    def partitions(self) -> list[InputPartition]:
        found = list(scan(self.top))
        return [Slice(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [Slice([])]

    def read(self, part: Slice) -> Iterator[tuple]:
        for path, kind in part.paths:
            if kind == "tree":
                yield path, kind, None
            else:
                with open(os.path.join(self.top, path), "rb") as f:
                    yield path, kind, f.read()


class DirectorySource(DataSource):
    """``spark.read.format("directory").load(folder)`` after ``spark.dataSource.register(DirectorySource)``."""

    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
