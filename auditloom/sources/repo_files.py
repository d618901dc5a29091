"""Files of repositories as a data source: ``spark.read.format("repo_files")``, and the same as a stream of new files."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "repo_id string, path string, size bigint, modified timestamp, place string"

#: Folders that are listed to plan a scan; what lies below is listed by the tasks.
PLANNED_FOLDERS = 1000
#: Tasks of a scan, whatever the number of folders.
MOST_TASKS = 128


def opened(root: str):
    """``(store, path)`` of a path or URI."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return store, base.rstrip("/")


class Folders(InputPartition):
    """Folders ``(repo_id, top, path, deep)`` of repositories; ``deep``: with all below it, else only the files right in it."""

    def __init__(self, folders: list[tuple], since_ms: int = -1, until_ms: int = -1):
        self.folders, self.since_ms, self.until_ms = folders, since_ms, until_ms


class _Walk:
    """What batch and stream readers share: planning by folders, listing inside a task."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.skipped = frozenset(filter(None, options.get("skipDirs", "").split(",")))
        self.repos = frozenset(filter(None, options.get("repos", "").split(",")))
        self.planned = int(options.get("plannedFolders", PLANNED_FOLDERS))

    def shares(self, since_ms: int = -1, until_ms: int = -1) -> list[Folders]:
        """Folders are opened breadth-first until enough are known, so the parts of one huge repository spread, too.

        They are dealt in turn, so a folder with any number of folders in it makes no more tasks than others.
        """
        from collections import deque

        from pyarrow import fs

        store, base = opened(self.root)
        wanted = deque(
            (e.base_name, e.path, e.path) for e in store.get_file_info(fs.FileSelector(base))
            if e.type == fs.FileType.Directory and (not self.repos or e.base_name in self.repos)
        )
        shallow: list[tuple] = []
        while wanted and len(shallow) < self.planned and len(shallow) + len(wanted) < self.planned:
            repo_id, top, path = wanted.popleft()
            shallow.append((repo_id, top, path, False))
            for entry in store.get_file_info(fs.FileSelector(path)):
                if entry.type == fs.FileType.Directory and entry.base_name not in self.skipped:
                    wanted.append((repo_id, top, entry.path))
        known = shallow + [(*w, True) for w in wanted]
        return [Folders(known[i::MOST_TASKS], since_ms, until_ms) for i in range(min(len(known), MOST_TASKS))] or [Folders([])]

    def rows(self, part: Folders) -> Iterator[tuple]:
        store, _ = opened(self.root)
        for folder in part.folders:
            yield from self._files(store, part, *folder)

    def _files(self, store, part: Folders, repo_id: str, top: str, path: str, deep: bool) -> Iterator[tuple]:
        from pyarrow import fs

        left = [path]
        while left:
            try:
                entries = store.get_file_info(fs.FileSelector(left.pop()))
            except FileNotFoundError:
                continue  # removed since it was planned
            for entry in entries:
                if entry.type == fs.FileType.Directory:
                    if deep and entry.base_name not in self.skipped:
                        left.append(entry.path)
                    continue
                changed = int(entry.mtime_ns // 1_000_000) if entry.mtime_ns is not None else 0
                if part.until_ms < 0 or part.since_ms <= changed < part.until_ms:
                    yield repo_id, entry.path[len(top) + 1 :], entry.size, entry.mtime, entry.path


class RepoFilesReader(_Walk, DataSourceReader):
    def partitions(self) -> list[Folders]:
        return self.shares()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)


class RepoFilesStream(_Walk, DataSourceStreamReader):
    """New and changed files by the time of their last change; an offset is a time in milliseconds."""

    def __init__(self, options: dict):
        super().__init__(options)
        # Files of the last moments may still be written.
        self.settled_ms = int(float(options.get("settleSeconds", "2")) * 1000)

    def initialOffset(self) -> dict:
        return {"until_ms": 0}

    def latestOffset(self) -> dict:
        return {"until_ms": int(time.time() * 1000) - self.settled_ms}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.shares(start["until_ms"], end["until_ms"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RepoFiles(DataSource):
    """Rows ``(repo_id, path, size, modified, place)`` of all files below ``<path>/<repo_id>/``.

    Options: ``path`` (a path or URI of any store that Arrow opens), ``skipDirs`` (names of folders that are never
    entered, parted by commas), ``repos`` (only these), ``plannedFolders`` (how many folders the planner lists before
    it leaves the rest to the tasks).  Hidden files and names that begin with ``_`` count like all others.  A task
    hands on one file after the other.  As a stream: files whose last change lies between two batches; a file that is
    changed comes again.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoFilesReader:
        return RepoFilesReader(self.options)

    def streamReader(self, schema) -> RepoFilesStream:
        return RepoFilesStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``repo_files`` known to the session."""
    spark.dataSource.register(RepoFiles)
