"""The service's operations as functions over stored tables: intake, questions, listings, deletion, history.

Every operation takes a tenant. A table is a folder of versions below one root, and a pointer that
says which one holds; appends add files to it, a deletion writes a new version, and then the pointer
moves. Pointers are numbered and the highest complete one holds, so a crash leaves the old version or the new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text as X
from .functions import urls as U
from .operators import chunking as C
from .operators import html as H
from .operators import relational as L
from .operators import retrieval as R
from .plans import answering as A
from .plans.handles import IndexHandles
from .sources.storage import remove, state_of

TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "messages": schemas.MESSAGES, "jobs": schemas.JOBS}


class Service:
    def __init__(self, spark: SparkSession, root: str, now: Column | None = None):
        """now: the clock, a column; the current time if it is left out."""
        self.spark, self.root, self.now = spark, root.rstrip("/"), now if now is not None else F.current_timestamp()
        self.handles = IndexHandles(spark, f"{self.root}/indexes")

    # tables

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """Pointers of a table in order: their numbers and the folders that they name."""
        base = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
        return sorted((int(number), folder) for number, _, folder in (n.removeprefix("holds-").partition("-") for n in names if n.startswith("holds-")))

    def _point(self, name: str, number: int, folder: str) -> None:
        """A pointer is an empty folder whose name says all, which a file system makes at once or not at all."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/holds-{number:08d}-{folder}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def table(self, name: str) -> DataFrame:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{versions[-1][1]}")

    def append(self, name: str, rows: DataFrame) -> None:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        full = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        versions = self._versions(name)
        folder = versions[-1][1] if versions else f"v-{uuid.uuid4().hex[:8]}"
        full.write.mode("append").parquet(f"{self.root}/{name}/{folder}")
        if not versions:
            self._point(name, 1, folder)

    def _replace(self, name: str, rows: DataFrame) -> None:
        """rows as the table's next version; older ones go once the pointer has moved."""
        versions, folder = self._versions(name), f"v-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        self._point(name, versions[-1][0] + 1 if versions else 1, folder)
        for number, old in versions:
            remove(self.spark, f"{self.root}/{name}/holds-{number:08d}-{old}")
            remove(self.spark, f"{self.root}/{name}/{old}")

    def _version(self, name: str) -> tuple:
        """What names a table's contents: its version's folder with its files' number, bytes and time."""
        versions = self._versions(name)
        return state_of(self.spark, f"{self.root}/{name}/{versions[-1][1]}") if versions else ()

    # intake

    def add_documents(self, user_id: str, texts: DataFrame) -> None:
        """Index extracted documents (name, text). Names that the tenant has indexed are left as they are."""
        known = self.documents(user_id).select(F.col("original_filename").alias("name"))
        new = texts.join(known, "name", "left_anti").withColumn("pdf_name", X.slug(X.stem(X.secure_filename(F.col("name"))), "none"))
        chunks = new.select("pdf_name", F.posexplode(C.fixed_windows(F.col("text"))).alias("i", "content")).withColumn("page_number", F.col("i") + 1)
        self._index(user_id, new, chunks, "pdf", F.col("name"))

    def add_pages(self, user_id: str, pages: DataFrame) -> None:
        """Index crawled pages (url, html), each site under its slug; sites that the tenant has indexed are left."""
        site = U.url_slug(U.base(F.col("url")), "web-site")
        known = self.documents(user_id).select(F.col("pdf_name"))
        new = pages.withColumn("pdf_name", site).join(known, "pdf_name", "left_anti")
        rows = C.chunk_pages(H.extracted(new.select("url", "html")))
        rows = rows.withColumn("pdf_name", U.url_slug(U.base(F.col("source_url")), "web-site"))
        self._index(user_id, new.withColumn("name", U.base(F.col("url"))), rows, "web", F.col("name"))

    def _index(self, user_id: str, new: DataFrame, chunks: DataFrame, kind: str, filename: Column) -> None:
        if not user_id:
            raise ValueError("a tenant is required")
        place = F.coalesce(F.col("source_url"), F.col("pdf_name")) if "source_url" in chunks.columns else F.col("pdf_name")
        chunks = chunks.withColumn("user_id", F.lit(user_id)).withColumn("doc_id", F.xxhash64("user_id", place))
        count = chunks.groupBy("pdf_name").agg(F.count("*").alias("chunks_count"))
        names = new.groupBy("pdf_name").agg(F.min(filename).alias("original_filename"))
        done = names.join(count, "pdf_name", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)))
        rows = done.select(F.lit(user_id).alias("user_id"), "pdf_name", "original_filename", F.lit(kind).alias("source_type"), F.lit("completed").alias("status"), "chunks_count", self.now.alias("created_at"))
        self.append("chunks", chunks)
        self.append("documents", rows)
        self.append("jobs", rows.select(F.xxhash64("user_id", "pdf_name").alias("job_id"), "user_id", "pdf_name", F.lit("completed").alias("status"), F.lit("Done").alias("stage"), F.lit(1.0).alias("progress")))

    # questions

    def ask(self, user_id: str, questions: DataFrame, pdf_name: str | None = None, least: float = R.MIN_SIMILARITY) -> DataFrame:
        """Answers to a batch of questions (qid, text) from one tenant's chunks, of one document or all; logged as messages.

        The index of those chunks is kept for later questions, until chunks change.
        """
        chunks = L.tenant_rows(self.table("chunks"), user_id)
        if pdf_name is not None:
            chunks = chunks.filter(F.col("pdf_name") == pdf_name)
        index, vectors = self.handles.get(user_id, pdf_name, self._version("chunks"), lambda: chunks.select("doc_id", "page_number", "content"))
        out = A.ask(questions, index, vectors, least).join(questions, "qid")
        path = f"{self.root}/answers/{uuid.uuid4().hex[:8]}"
        out.write.parquet(path)
        out = self.spark.read.parquet(path)
        asked = out.select("qid", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content"))
        said = out.select("qid", F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))
        self.append("messages", asked.unionByName(said).withColumn("user_id", F.lit(user_id)).withColumnRenamed("qid", "conversation_id"))
        return out

    # listings

    def documents(self, user_id: str) -> DataFrame:
        return L.tenant_rows(self.table("documents"), user_id)

    def processed(self, user_id: str) -> DataFrame:
        return self.documents(user_id).filter("status = 'completed'").select("pdf_name", "original_filename", F.coalesce("source_type", F.lit("pdf")).alias("source_type"), "chunks_count")

    def sites(self, user_id: str) -> DataFrame:
        return self.documents(user_id).filter(F.startswith("original_filename", F.lit("http")))

    def status(self, user_id: str, job_id: int) -> DataFrame:
        return L.tenant_rows(self.table("jobs"), user_id).filter(F.col("job_id") == job_id)

    def conversations(self, user_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """Newest first, with a title and the number of messages."""
        m = L.tenant_rows(self.table("messages"), user_id).groupBy("conversation_id")
        rows = m.agg(X.preview(F.min_by("content", "turn"), 50).alias("title"), F.least(F.count("*"), F.lit(1000)).alias("n_messages"))
        return L.page_of(rows, [F.desc("conversation_id")], offset, limit)

    def messages(self, user_id: str, conversation_id: int) -> DataFrame:
        return L.tenant_rows(self.table("messages"), user_id).filter(F.col("conversation_id") == conversation_id).orderBy("turn")

    # deletion

    def delete_document(self, user_id: str, pdf_name: str) -> bool:
        """A document or site with its chunks; whether there was one."""
        if self.documents(user_id).filter(F.col("pdf_name") == pdf_name).isEmpty():
            return False
        key = self.spark.createDataFrame([(user_id, pdf_name)], "user_id string, pdf_name string")
        for name in ("documents", "chunks", "jobs"):
            self._replace(name, L.delete_keys(self.table(name), key, ["user_id", "pdf_name"]))
        self.handles.invalidate(user_id, pdf_name)
        return True

    def delete_conversation(self, user_id: str, conversation_id: int) -> bool:
        if self.messages(user_id, conversation_id).isEmpty():
            return False
        key = self.spark.createDataFrame([(user_id, conversation_id)], "user_id string, conversation_id long")
        self._replace("messages", L.delete_keys(self.table("messages"), key, ["user_id", "conversation_id"]))
        return True
