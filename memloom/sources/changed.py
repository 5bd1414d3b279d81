"""Changed files as a stream: a file comes again whenever its modification time has moved on.

Spark's own file stream takes every path once. Here the offset is the greatest
(modification time, path) seen, and a batch holds the files beyond the last offset, dealt to
tasks in groups; only their first bytes are read. A file that changes while a
batch is made comes with the next one. A file that is put in place with a
modification time before the offset doesn't come; the index of the whole folder finds it.

    spark.dataSource.register(changed.ChangedFiles)
    spark.readStream.format("changed_files").option("folder", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from memloom.config import DEFAULT

SCHEMA = "path string, last_modified string, size long, head binary"
#: Files of a task.
GROUP = 500


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a plain one is local) and the name within."""
    if path.startswith("file:") or ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Group(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, prefix: str, head: int, most: int):
        self.folder, self.prefix, self.head, self.most = folder, prefix, head, most

    def _listed(self) -> list[tuple[int, str, int]]:
        """(modification time in microseconds, path below the folder, size) of all files."""
        system, root = opened(self.folder)
        root = root.rstrip("/")
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [(f.mtime_ns // 1000, f.path[len(root) + 1 :], f.size) for f in found if f.type == fs.FileType.File]

    def initialOffset(self) -> dict:  # noqa: N802 (names of the interface)
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        at, path, _ = max(self._listed(), default=(-1, "", 0))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        files = sorted((p, at, size) for at, p, size in self._listed() if low < (at, p) <= high)
        return [Group(files[k : k + GROUP]) for k in range(0, len(files), GROUP)] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        system, root = opened(self.folder)
        for path, at, size in partition.files:
            stamp = datetime.fromtimestamp(at // 1000 / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at // 1000 % 1000:03d}Z"
            if size > self.most:
                yield (f"{self.prefix}/{path}", None, None, None)  # too large: unreadable
                continue
            try:
                with system.open_input_file(f"{root.rstrip('/')}/{path}") as file:
                    head = file.read(self.head)
            except FileNotFoundError:
                continue  # gone since the batch was planned
            yield (f"{self.prefix}/{path}", stamp, size, head)

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    """Options: folder, prefix (of the paths given; `memory`), headBytes and maxBytes (larger files are unreadable)."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> Reader:  # noqa: N802
        get = self.options.get
        return Reader(get("folder"), get("prefix") or "memory", int(get("headBytes") or DEFAULT.file_head_bytes), int(get("maxBytes") or DEFAULT.file_max_bytes))
