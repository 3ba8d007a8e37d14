"""A data source that lists files and reads their first bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"%PDF"
SCHEMA = "path string, length long, named_pdf boolean, error string"


@dataclass
class Files(InputPartition):
    """Files of a task, as (path, length); a length of None stands for a path without files."""

    files: list[tuple[str, int | None]]


def _split(path: str) -> tuple[str, str]:
    """The part of a path before the first segment with a wildcard, and the rest."""
    parts = path.split("/")
    at = next((i for i, p in enumerate(parts) if set(p) & set("*?[")), len(parts))
    return "/".join(parts[:at]) or "/", "/".join(parts[at:])


class HeadReader(DataSourceReader):
    def __init__(self, path: str, most: int, per_partition: int):
        self.path, self.most, self.per_partition = path, most, per_partition

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith(("/", "file:")) else __import__("os").path.abspath(self.path))

    def partitions(self) -> list[Files]:
        """The listing, one call for each folder that a pattern names, dealt in ranges."""
        from pyarrow import fs

        store, path = self._open()
        base, pattern = _split(path.rstrip("/"))
        if pattern:
            depth = pattern.count("/")
            infos = [i for i in store.get_file_info(fs.FileSelector(base, recursive=depth > 0, allow_not_found=True)) if i.path.removeprefix(base.rstrip("/") + "/").count("/") == depth and fnmatchcase(i.path.removeprefix(base.rstrip("/") + "/"), pattern)]
        else:
            infos = store.get_file_info([path])
        found = []
        for info in infos:
            inner = store.get_file_info(fs.FileSelector(info.path)) if info.type == fs.FileType.Directory else [info]
            found += [(i.path, i.size) for i in inner if i.type == fs.FileType.File]
        found = sorted(found) or [(self.path, None)]
        return [Files(found[i : i + self.per_partition]) for i in range(0, len(found), self.per_partition)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        paths, sizes, errors = [], [], []
        for path, size in partition.files:
            paths.append(path)
            sizes.append(size)
            errors.append("E002" if size is None else "E001" if size > self.most else "E003" if size == 0 else self._head(store, path))
        named = [p.lower().endswith(".pdf") for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(named, pa.bool_()), pa.array(errors, pa.string())], names=["path", "length", "named_pdf", "error"])

    def _head(self, store, path: str) -> str | None:
        try:
            with store.open_input_file(path) as f:
                return None if f.read_at(len(MAGIC), 0) == MAGIC else "E001"
        except OSError:
            return "E001"


class DocumentHeads(DataSource):
    """Format document_heads: options path, most (the largest size allowed) and per_partition (files of a task)."""

    @classmethod
    def name(cls) -> str:
        return "document_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("most", 5 << 30)), int(self.options.get("per_partition", 10_000)))
