"""A batched vector sink as a Python data source: small batches, a few attempts each, a quota of failures, all or nothing.

Every task sends its rows in batches and reports in its commit message what was written and what
failed. The driver adds the messages up: above the quota it aborts, and the store is as before;
otherwise a manifest with the new files is written, and only what a manifest names is in the store.
A task that runs again writes other files, and the lost attempt's are in no manifest.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a batch, attempts, the share of failed batches above which a write is aborted.
BATCH, ATTEMPTS, QUOTA = 50, 3, 0.5
SHAPE = "tenant string, id long, vector array<double>"
#: Writes a batch of rows (dictionaries of SHAPE's fields) to a file; raises if it can't.
Put = Callable[[list[dict], str], None]


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path there; file:/ is as good as file:///."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def put_parquet(rows: list[dict], path: str) -> None:
    fs, p = located(path)
    schema = pa.schema([("tenant", pa.string()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
    with fs.open_output_stream(p) as out:
        pyarrow.parquet.write_table(pa.Table.from_pylist(rows, schema=schema), out)


@dataclass
class Sent(WriterCommitMessage):
    """What became of a task's rows."""

    batches: int
    failed_batches: int
    rows: int
    failed_rows: int
    empty_rows: int
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, put: Put, batch: int, attempts: int, quota: float, delay: float):
        self.path, self.put, self.batch, self.attempts, self.quota, self.delay = path, put, batch, attempts, quota, delay
        self.fresh = f"new-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator) -> Sent:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/{self.fresh}", recursive=True)
        sent, rows = Sent(0, 0, 0, 0, 0, []), []
        for row in iterator:
            if row.vector is None or not sum(x or 0.0 for x in row.vector):  # a failed embedding is all zeros
                sent.empty_rows += 1
                continue
            rows.append(row.asDict())
            if len(rows) == self.batch:
                self._send(rows, sent)
                rows = []
        if rows:
            self._send(rows, sent)
        return sent

    def _send(self, rows: list[dict], sent: Sent) -> None:
        sent.batches += 1
        for attempt in range(self.attempts):
            name = f"{self.fresh}/{uuid.uuid4().hex}.parquet"
            try:
                self.put(rows, f"{self.path}/{name}")
            except Exception:  # noqa: BLE001  whatever a store raises, the batch is tried again and then counted
                time.sleep(self.delay * 2**attempt if attempt + 1 < self.attempts else 0)
                continue
            sent.rows += len(rows)
            sent.files.append(name)
            return
        sent.failed_batches += 1
        sent.failed_rows += len(rows)

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m is not None]
        report = {c: sum(getattr(m, c) for m in done) for c in ("batches", "failed_batches", "rows", "failed_rows", "empty_rows")}
        if report["failed_batches"] > self.quota * report["batches"]:
            raise RuntimeError(f"{report['failed_batches']} of {report['batches']} batches failed")
        fs, root = located(self.path)
        number, held = _manifest(self.path)
        body = {"report": report, "files": [*held["files"], *(f for m in done for f in m.files)]}
        name = f"{root}/manifest-{number + 1:08d}.json"
        with fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(body).encode())
        fs.move(f"{name}.part", name)

    def abort(self, messages: list[Sent | None]) -> None:
        fs, root = located(self.path)
        if fs.get_file_info(f"{root}/{self.fresh}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.fresh}")


def _manifest(path: str) -> tuple[int, dict]:
    """The newest manifest and its number; 0 and an empty one if there is none."""
    fs, root = located(path)
    found = sorted(f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    if not found:
        return 0, {"files": [], "report": {}}
    with fs.open_input_stream(f"{root}/{found[-1]}") as f:
        return int(found[-1][9:17]), json.loads(f.read())


def write_vectors(rows: DataFrame, path: str, put: Put = put_parquet, batch: int = BATCH, attempts: int = ATTEMPTS, quota: float = QUOTA, delay: float = 0.0) -> dict:
    """Append rows (tenant, id, vector) to the store at path (a URI that all executors reach); the counts of the write.

    batches, failed_batches, rows, failed_rows, empty_rows (zero vectors, which are failed embeddings, and null ones).
    A batch that fails is tried `attempts` times, with delay seconds between, doubled each time. If
    more than quota of the batches fail, the write raises and the store stays as it was. One write
    at a time.
    """
    name = f"vectors_{uuid.uuid4().hex[:12]}"

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(path, put, batch, attempts, quota, delay)

    rows.sparkSession.dataSource.register(Sink)
    rows.selectExpr("cast(tenant as string) as tenant", "cast(id as long) as id", "cast(vector as array<double>) as vector").write.format(name).mode("append").save()
    return _manifest(path)[1]["report"]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all writes that were committed."""
    files = _manifest(path)[1]["files"]
    return spark.read.schema(SHAPE).parquet(*(f"{path}/{f}" for f in files)) if files else spark.createDataFrame([], SHAPE)
