"""Keyed state of the streams: pages that land again, reports that come late or twice, jobs that fall silent, restarts."""

import datetime
import pickle

import pyarrow as pa
from pyspark.sql import functions as F

from corvex.operators import chunking as C
from corvex.operators import html as H
from corvex.functions import urls as U
from corvex.streaming.ingest import first_landed, index_pages, stream_index
from corvex.streaming import jobs as J
from corvex.streaming.jobs import current_jobs, follow_jobs


def page(i, url):
    return (i, url, f"<title>T{i % 7}</title><main><p>" + f"word{i % 7} talks all day long. " * 20 + "</p></main>")


def test_pages_that_land_again_are_indexed_once(spark, tmp_path):
    urls = [f"http://h.org/{i}" for i in range(7)]
    landed = [[page(i, urls[i]) for i in range(4)], [page(8 + i, urls[1 + i] + "#part") for i in range(3)] + [page(4, urls[4])], [page(14 + i, urls[i] + "/") for i in range(7)]]
    shape = "page_id long, url string, html string"
    stream = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    land = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: index_pages(stream(), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    rows = lambda: sorted((r.source_url.split("#")[0].rstrip("/"), r.page_number, r.content) for r in spark.read.parquet(str(tmp_path / "out" / "chunks")).collect())
    land(landed[0])
    land(landed[1])
    run()
    land(landed[2])  # a restart from the checkpoint
    run()
    once = spark.createDataFrame([page(i, urls[i]) for i in range(7)], shape)
    x = once.select("url", H.extract_page("html").alias("x"))
    want = C.chunk_pages(x.select("url", H.page_title(F.col("x.title"), U.path(F.col("url")), F.col("url")).alias("title"), F.col("x.markdown").alias("markdown")))
    texts = lambda found: sorted((u, n) for u, n, _ in found)
    assert texts(rows()) == sorted((r.source_url, r.page_number) for r in want.collect()) and len({u for u, _, _ in rows()}) == 7
    before = rows()
    run()
    assert rows() == before
    postings = spark.read.parquet(str(tmp_path / "out" / "postings"))
    assert postings.select("doc_id").distinct().count() == 7 and postings.groupBy("doc_id", "page_number", "token").count().filter("count > 1").isEmpty()


def test_a_table_may_be_a_folder_of_files_or_one_file(spark, tiny, tmp_path):
    whole = spark.read.parquet(f"{tiny}/pages.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert stream_index(spark, str(tmp_path)).count() == stream_index(spark, tiny).count() > 0


def test_first_landed_keeps_all_columns(spark):
    assert first_landed(spark.createDataFrame([page(1, "http://a/b#c")], "page_id long, url string, html string")).columns == ["page_id", "url", "html", "norm"]


def test_jobs_end_are_lost_and_ignore_what_was_told_before(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    files = [
        [(1, 1, at(0), "running", 0.1), (1, 2, at(1), None, 0.5), (2, 1, at(0), "running", None), (3, 1, at(1), "running", 0.2)],
        [(1, 2, at(1), None, 0.5), (1, 3, at(5), "completed", None), (1, 4, at(6), "failed", 0.0), (2, 3, at(6), None, 0.7), (2, 2, at(5), "waiting", 0.6)],
        [(2, 9, at(200), "failed", None), (4, 1, at(200), "running", 0.0)],
        [(4, 2, at(201), None, 0.9), (2, 3, at(200), "running", 0.1)],
    ]
    shape = "job_id long, order long, ts timestamp, status string, progress double"
    run = lambda: follow_jobs(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"), 3600, "10 minutes").awaitTermination()
    for rows in files:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {r.job_id: (r.status, r.progress, r.reports) for r in current_jobs(spark, str(tmp_path / "out")).collect()}
    assert got[1] == ("completed", 0.5, 3)
    assert got[2] == ("failed", 0.7, 4)
    assert got[3] == ("lost", 0.2, 1) and got[4] == ("running", 0.9, 2)


def test_the_state_operator_gets_a_row_for_each_job(monkeypatch):
    at = lambda i: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=i)
    rows = [(None if i % 4 == 3 else i % 4, 1000 - i, None if i % 4 == 2 else at(i), i, "running" if i % 5 else None, i / 8 if i % 3 else None) for i in range(1000)]
    shape = pa.schema({"job_id": pa.int64(), "order": pa.int64(), "ts": pa.timestamp("us", "UTC"), "ms": pa.int64(), "status": pa.string(), "progress": pa.float64()})
    batches = [pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows[i : i + 30]], shape) for i in range(0, 1000, 30)]
    (out,) = J.packed(iter(batches))
    got = {r["job_id"]: r for r in out.to_pylist()}
    assert out.num_rows == len(got) == 4 and {k: r["ts"] for k, r in got.items()} == {0: at(996), 1: at(997), 2: None, None: at(999)}
    for job, r in got.items():
        assert list(zip(*pickle.loads(r["reports"]))) == sorted((x[1], *x[3:]) for x in rows if x[0] == job)
    monkeypatch.setattr(J, "PACKED", 100)
    assert sum(b.num_rows for b in J.packed(iter(batches))) == 4 * 9 and not list(J.packed(iter([])))


def test_jobs_with_reports_that_lack_time_or_order(spark, tmp_path):
    t0, shape = datetime.datetime(2024, 1, 1), "job_id long, order long, ts timestamp, status string, progress double"
    rows = [(1, 1, None, "running", 0.5), (1, 2, t0, None, None), (2, 1, None, None, 0.25), (3, None, t0, "failed", 1.0), (None, 1, t0, "", 0.0)]
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(str(tmp_path / "in"))
    follow_jobs(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"), 3600).awaitTermination()
    got = {tuple(r) for r in current_jobs(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "running", 0.5, 2, t0), (2, None, 0.25, 1, None), (None, "", 0.0, 1, t0)}
