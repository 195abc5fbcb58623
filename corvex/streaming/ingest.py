"""Structured Streaming: landed pages to index tables, and the latest status of jobs. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import chunking as C
from ..operators import html as H
from ..operators import retrieval as R
from ..registry import query, table
from ..sources.storage import is_folder, remove, shared_folder


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is a folder of files or one file: a stream's path must be a folder."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def first_landed(pages: DataFrame, within: str = "7 days", time_col: str | None = None) -> DataFrame:
    """Pages with their normalised address as `norm`, each address once: the state holds addresses for as long as `within`.

    time_col: the pages' event time; without one it is the time at which a page is read. Of pages of
    one batch with one address any may be the one that stays.
    """
    at = F.col(time_col) if time_col else F.current_timestamp()
    return pages.withColumn("norm", U.normalised(F.col("url"))).withColumn("__landed", at).withWatermark("__landed", within).dropDuplicatesWithinWatermark(["norm"]).drop("__landed")


def index_pages(pages: DataFrame, path: str, checkpoint: str, within: str = "7 days"):
    """Extract, chunk and tokenise pages as they land; each batch is appended to chunks and postings.

    A page that landed before, in whichever batch, is not indexed again. A batch's folder is named by
    its number, so a batch that runs again replaces its own output. The index is made of the stored
    chunks, so pages are extracted once and both tables hold the same ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = C.chunk_pages(H.extracted(batch.select("url", "html")))
        rows.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        rows = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/chunks/batch={number}")
        keyed = rows.select(F.xxhash64("source_url").alias("doc_id"), "page_number", "content")
        index = R.build_index(keyed)
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        remove(batch.sparkSession, index.path)

    return first_landed(pages, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame) -> DataFrame:
    """user_id, event_id, status: the newest event of each job, as a running aggregate."""
    return events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by window and type; windows end for good once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("stream_latest_status", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS status, count(*) AS n FROM events GROUP BY user_id")
def stream_status(spark, sf):
    path = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    q = latest_status(stream_of(spark, sf, "events")).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_page_index")
def stream_index(spark, sf):
    path = shared_folder(spark, "pages")
    index_pages(stream_of(spark, sf, "pages"), path, f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/chunks").drop("batch")
