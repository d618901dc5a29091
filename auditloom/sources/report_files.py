"""Reports as files, one JSON document per repository: ``df.write.format("repo_reports")``."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .repo_files import opened

CURRENT = "_current"
#: Folders a run's reports are dealt to, since many files in one folder are slow to list.
BUCKETS = 256
#: Bytes of reports that a reading task hands on at once.
READ_BYTES = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    files: int


class ReportWriter(DataSourceWriter):
    """A run writes into a folder of its own, and one small file says which folder holds.

    A task that runs again writes the same files again.  Until the run is committed, readers see the one before; a run
    that fails leaves nothing: only the driver makes folders, so tasks that outlive the run have nowhere to write.
    """

    def __init__(self, root: str):
        self.root, self.run = root, f"run-{uuid.uuid4().hex}"
        store, base = opened(root)
        for bucket in _buckets():
            store.create_dir(f"{base}/{self.run}/{bucket}", recursive=True)

    def write(self, iterator) -> Written:
        store, base = opened(self.root)
        n = 0
        for row in iterator:
            name = quote(row["repo_id"], safe="")
            with store.open_output_stream(f"{base}/{self.run}/{_bucket(row['repo_id'])}/{name}.json") as out:
                out.write(row["report"].encode())
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        store, base = opened(self.root)
        with store.open_output_stream(f"{base}/{CURRENT}.{self.run}") as out:
            out.write(self.run.encode())
        before = current_run(self.root)
        store.move(f"{base}/{CURRENT}.{self.run}", f"{base}/{CURRENT}")
        if before:
            store.delete_dir(f"{base}/{before}")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, base = opened(self.root)
        for left in range(9, -1, -1):
            if store.get_file_info(f"{base}/{self.run}").type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(f"{base}/{self.run}")
            except OSError:  # a task that is still running has put a file into a folder that was being emptied
                if not left:
                    raise
                time.sleep(0.1)


def _buckets() -> list[str]:
    return [f"{i:02x}" for i in range(BUCKETS)]


def _bucket(repo_id: str) -> str:
    from zlib import crc32

    return f"{crc32(repo_id.encode()) % BUCKETS:02x}"


class RepoReports(DataSource):
    """Sink for ``(repo_id, report)``: ``<path>/<run>/<two digits>/<repo_id>.json``, the run named by ``<path>/_current``."""

    @classmethod
    def name(cls) -> str:
        return "repo_reports"

    def schema(self) -> str:
        return "repo_id string, report string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def current_run(path: str) -> str | None:
    """Folder of the last committed run, or None."""
    from pyarrow import fs

    store, base = opened(path)
    if store.get_file_info(f"{base}/{CURRENT}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{base}/{CURRENT}") as source:
        return source.read().decode()


def write_report_files(reports: DataFrame, path: str) -> None:
    """One JSON document per repository below ``path``; replaces those of the run before, all at once.

    ``reports`` has a row per ``repo_id``; all its columns go into the document.  Of several rows of a repository any
    one stays.  Rows without ``repo_id`` are an error.  ``path`` is a path or URI of any store that Arrow opens.
    """
    reports.sparkSession.dataSource.register(RepoReports)
    known = F.coalesce("repo_id", F.raise_error(F.lit("a report needs a repo_id")))
    rows = reports.select(known.alias("repo_id"), F.to_json(F.struct(*reports.columns)).alias("report"))
    rows.write.format("repo_reports").mode("overwrite").save(path)


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """``(repo_id, report)`` of the last committed run.

    A task lists a folder of the run and hands on its reports one after the other; the driver knows no file.
    """
    run = current_run(path)
    if run is None:
        return spark.createDataFrame([], "repo_id string, report string")
    store, base = opened(path)

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["report"])
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                held, size = [], 0
                for file in store.get_file_info(fs.FileSelector(f"{base}/{run}/{bucket}", allow_not_found=True)):
                    if not file.path.endswith(".json"):
                        continue
                    with store.open_input_stream(file.path) as source:
                        held.append(source.read().decode())
                    size += file.size
                    if size > READ_BYTES:
                        yield names(held)
                        held, size = [], 0
                yield names(held)

    buckets = spark.createDataFrame([(b,) for b in _buckets()], "bucket string").repartition(BUCKETS // 4, "bucket")
    return buckets.mapInArrow(read, "report string").select(F.get_json_object("report", "$.repo_id").alias("repo_id"), "report")
