"""``fstree``: a directory tree as a DataFrame, listed by the executors (hidden and underscore names included on request)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes bigint, mtime_us bigint, error string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options.get("path", "."))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.extensions = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.most = int(options.get("partitions", "256"))

    def _shown(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough; those opened are listed flat, the others with all below them."""
        if not self.recursive:
            return [_Folder(self.root, False)]
        done: list[InputPartition] = []
        level = [self.root]
        while level and len(done) + len(level) < self.most:
            below: list[str] = []
            for folder in level:
                done.append(_Folder(folder, False))
                try:
                    with os.scandir(folder) as entries:
                        below += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and self._shown(e.name))
                except OSError:
                    continue
            level = below
        return done + [_Folder(f, True) for f in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not self.hidden and any(p.startswith(".") for p in partition.path.split(os.sep) if p):
            return
        folders = [partition.path]
        while folders:
            folder = folders.pop()
            try:
                with os.scandir(folder) as entries:
                    listed = sorted(entries, key=lambda e: e.name)
            except OSError as error:
                yield folder, None, None, str(error)
                continue
            for entry in listed:
                if not self._shown(entry.name):
                    continue
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if partition.deep:
                            folders.append(entry.path)
                        continue
                    dot = entry.name.rfind(".")
                    ext = entry.name[dot:].lower() if 0 < dot < len(entry.name) - 1 else ""
                    if self.extensions and ext not in self.extensions:
                        continue
                    stat = entry.stat()
                    yield entry.path, stat.st_size, stat.st_mtime_ns // 1000, None
                except OSError as error:
                    yield entry.path, None, None, str(error)


class FileTreeSource(DataSource):
    """Options: path, recursive (true), hidden (false), extensions (comma list, lower case, with dots), partitions (256)."""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def list_files(spark: SparkSession, path: str, recursive: bool = True, hidden: bool = False, extensions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The files below a folder; with a limit the first ones by path."""
    spark.dataSource.register(FileTreeSource)
    found = spark.read.format("fstree").option("path", path).option("recursive", str(recursive)).option("hidden", str(hidden)).option("extensions", ",".join(extensions or [])).load()
    return found.orderBy("path").limit(limit) if limit else found
