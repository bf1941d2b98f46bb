"""A data source over a landing folder: raw files, or saved OCR annotations, in batch or as a stream.

``spark.dataSource.register(LandingSource)``, then ``spark.read`` or ``readStream`` with format ``landing`` and a path.
Option ``kind``: ``files`` (path, modified, length, file_hash, content: a row a file) or ``annotations`` (path, line,
document_id, annotations as JSON text: a row for each line that is a JSON object). Option ``pattern`` filters names, and
``filesPerPartition`` says how many files a task reads.

A stream's offset is the time of change and the path of the last file in the order of both: each file is read once, also
over restarts, as long as files appear whole and with times that don't go back (a rename within the store does). Names
that begin with a dot or underscore are being written, or not data, and are left out.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "files": "path string, modified timestamp, length bigint, file_hash string, content binary",
    "annotations": "path string, line int, document_id string, annotations string",
}


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        self.files = files


class _Folder:
    """The files of a folder and their rows."""

    def __init__(self, options: dict):
        self.kind, self.pattern = options.get("kind", "files"), options.get("pattern", "*")
        self.each = max(1, int(options.get("filesPerPartition", 16)))
        if self.kind not in SCHEMAS:
            raise ValueError(f"unknown kind {self.kind}; known: {sorted(SCHEMAS)}")
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change in nanoseconds, path, size) in order."""
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        kept = [i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and fnmatch.fnmatch(i.base_name, self.pattern)]
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in kept)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        return [Files(files[k : k + self.each]) for k in range(0, len(files), self.each)]

    def rows(self, partition: Files) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for changed, path, size in partition.files:
            with store.open_input_stream(path) as stream:
                content = stream.read()
            if self.kind == "files":
                yield path, datetime.fromtimestamp(changed / 1e9, UTC), size, hashlib.sha256(content).hexdigest(), content
            else:
                yield from _annotations(path, content)


def _annotations(path: str, content: bytes) -> Iterator[tuple]:
    for k, line in enumerate(content.decode("utf-8", "replace").splitlines()):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            found = row.get("annotations")
            yield path, k, row.get("document_id"), None if found is None else json.dumps(found, ensure_ascii=False)


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return self.folder.dealt(self.folder.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.folder.listed()
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = ((o["changed"], o["path"]) for o in (start, end))
        return self.folder.dealt([f for f in self.folder.listed() if lo < f[:2] <= hi])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class LandingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMAS[_Folder(self.options).kind]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Folder(self.options))
