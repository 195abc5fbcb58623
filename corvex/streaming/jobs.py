"""The state of jobs in a stream of their reports: status and progress by job, and jobs that have stopped reporting."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from ..sources.storage import shared_folder
from .ingest import stream_of

#: A job may end, and later reports of one that has ended change nothing.
TERMINAL = ("completed", "failed", "cached", "lost")
SHAPE = "job_id long, status string, progress double, reports long, at timestamp"
#: What the operator returns: a time is its milliseconds there.
CHANGE = SHAPE.replace("at timestamp", "at long")
#: Reports that a task holds to put together those of one job.
PACKED = 1 << 18
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _values(column: pa.ChunkedArray) -> list:
    """A column of numbers as a list with None for null."""
    values = column.fill_null(0).to_numpy().tolist()
    return [None if null else x for null, x in zip(column.is_null().to_numpy().tolist(), values)] if column.null_count else values


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).sort_by([("job_id", "ascending"), ("order", "ascending")])
    told = rows["status"].combine_chunks().dictionary_encode()
    words = [*told.dictionary.to_pylist(), None]
    status = list(map(words.__getitem__, told.indices.fill_null(len(words) - 1).to_numpy().tolist()))
    columns = [_values(rows["order"]), _values(rows["ms"]), status, _values(rows["progress"])]
    job, null = rows["job_id"].fill_null(0).to_numpy(), rows["job_id"].is_null().to_numpy()
    start = np.flatnonzero(np.concatenate([[True], (job[1:] != job[:-1]) | (null[1:] != null[:-1])]))
    none = np.iinfo(np.int64).min
    newest = np.maximum.reduceat(rows["ts"].cast(pa.int64()).fill_null(none).to_numpy(), start)
    spans = zip(start.tolist(), [*start[1:].tolist(), len(job)])
    reports = [pickle.dumps([c[a:b] for c in columns]) for a, b in spans]
    newest = pa.array(newest, mask=newest == none).cast(rows.schema.field("ts").type)
    return pa.RecordBatch.from_arrays([pa.array(job[start], mask=null[start]), newest, pa.array(reports, pa.binary())], names=["job_id", "ts", "reports"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each job among some PACKED reports: job_id, ts (the newest), reports (in order: order, ms, status, progress)."""
    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= PACKED:
            yield _packed(held)
            held, size = [], 0
    if size:
        yield _packed(held)


class JobStates(StatefulProcessor):
    """Folds a job's reports (order, ms, status, progress), packed, in order and tells each change of its row.

    Reports are known by their order number: one that is not above the last is late or told twice and changes
    nothing. A null status or progress keeps the one before. A job that has not ended and reports nothing for
    `silence` seconds of event time is lost, by a timer that each report sets anew; a report revives it.
    """

    def __init__(self, silence: int, terminal: tuple[str, ...] = TERMINAL):
        self.silence, self.terminal = silence, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last long, status string, progress double, reports long, at long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, status, progress, reports, at, timer = self.job.get() or (-1, None, None, 0, 0, 0)
        before = reports
        told = [x for r in rows for x in zip(*pickle.loads(r["reports"]))]
        for order, ms, new, share in sorted(told, key=itemgetter(0)):
            if order <= last or (status in self.terminal and status != "lost"):
                continue
            last, reports, at = order, reports + 1, at if ms is None else max(at, ms)
            status = new if new is not None else "running" if status == "lost" else status
            progress = progress if share is None else share
        if reports == before:
            return
        due = 0 if status in self.terminal or not at else at + 1000 * self.silence
        if timer != due:  # each call of the state is a message to the JVM and back
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.job.update((last, status, progress, reports, at, due))
        yield self.row(key, status, progress, reports, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last, status, progress, reports, at, timer = self.job.get()
        if status not in self.terminal and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.job.update((last, "lost", progress, reports, at, 0))
            yield self.row(key, "lost", progress, reports, timer)

    def row(self, key, status, progress, reports, at) -> Row:
        return Row(job_id=key[0], status=status, progress=progress, reports=reports, at=at or None)

    def close(self) -> None:
        pass


def job_changes(reports: DataFrame, silence: int, late: str = "1 hour", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """A stream of reports (job_id, order, ts, status, progress) as a stream of the changes of jobs' rows.

    late: how far behind the newest report one may be; time stands at the newest less that, and timers run by it.
    The operator takes rows to Python one by one, so a job's reports of a batch are put together before
    it; one that is too late still counts if it comes with one of its job that is not. Without order none counts.
    """
    spark = reports.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one that has timers; for good, as the stream starts later
    rows = reports.filter(F.col("order").isNotNull()).select(F.col("job_id").cast("long"), F.col("order").cast("long"), "ts", F.unix_millis("ts").alias("ms"), F.col("status").cast("string"), F.col("progress").cast("double"))
    rows = rows.repartition("job_id").mapInArrow(packed, "job_id long, ts timestamp, reports binary")
    changes = rows.withWatermark("ts", late).groupBy("job_id").transformWithState(JobStates(silence, terminal), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
    return changes.withColumn("at", F.timestamp_millis("at"))


def follow_jobs(reports: DataFrame, path: str, checkpoint: str, silence: int, late: str = "1 hour", terminal: tuple[str, ...] = TERMINAL):
    """Changes of jobs written to path by batch; a batch that runs again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return job_changes(reports, silence, late, terminal).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each job in what follow_jobs() wrote."""
    rows = spark.read.schema(f"{SHAPE}, batch int").parquet(path)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "reports", "at"), F.struct("batch", "reports", "at")).alias("x")).select("job_id", "x.*")


@query("stream_job_states", """
    WITH l AS (SELECT user_id AS job_id, event_id, nullif(event_type, 'view') AS status, CASE WHEN event_id % 3 = 0 THEN value END AS progress FROM events),
    d AS (SELECT *, coalesce(min(CASE WHEN status = 'logout' THEN event_id END) OVER (PARTITION BY job_id), 9223372036854775807) AS stop FROM l)
    SELECT job_id, max_by(status, event_id) FILTER (status IS NOT NULL) AS status, round(max_by(progress, event_id) FILTER (progress IS NOT NULL), 6) AS progress, count(*) AS reports FROM d WHERE event_id <= stop GROUP BY job_id""")
def stream_jobs(spark, sf):
    """All events as reports of their user's job, which ends at its first logout; no job is silent for a year."""
    path = shared_folder(spark, "jobs")
    e = stream_of(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("order"), F.col("ts").cast("timestamp").alias("ts"), F.nullif("event_type", F.lit("view")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("progress"))
    follow_jobs(e, f"{path}/out", f"{path}/log", 365 * 86_400, "1 day", ("logout", "lost")).awaitTermination()
    return current_jobs(spark, f"{path}/out").select("job_id", "status", F.round("progress", 6).alias("progress"), "reports")
