"""Stored tables: the shared folder, keyword-index and vector stores, JSON and CSV files, sitemaps."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where spark.checkpoint.dir points, which all executors see; it goes when the application ends.

    Where that is unset, it lies in the warehouse, which a cluster shares; a session of one machine
    (master local) has it in that machine's folder for temporary files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        base = f"{tempfile.gettempdir() if alone else spark.conf.get('spark.sql.warehouse.dir')}/corvex-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def state_of(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """A path with its number of files, their bytes and when it was changed: other contents, another state."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sums = fs.getContentSummary(p)
    return path, sums.getFileCount(), sums.getLength(), fs.getFileStatus(p).getModificationTime()


def still_there(table: DataFrame) -> bool:
    """Whether the files of a stored table, which may lie in a folder that others clear, are there."""
    files = table.inputFiles()
    p = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0] if files else "/")
    return p.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Partitions that a task writes side by side; only with more of them are its rows sorted.
OPEN_FILES = 32


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the queries that run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Shuffle files of the queries that run within go when they end, not when the driver happens to collect its garbage."""
    return setting(spark, CLEANUP, "true")


#: Rows and bytes of an Arrow batch at most.
BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20))


def small_batches(spark: SparkSession) -> None:
    """Lower a session's Arrow batches, if they are larger; for good, as results are computed after their plan was made."""
    for key, most in BATCH:
        has = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key))
        if has is None or not 0 < int(has[1]) <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written and read again."""
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_by_position(spark: SparkSession, path: str, column: str, name: str) -> DataFrame:
    """The one column of a folder of CSV files (with headers) with each row's number, from 0, through the files in order."""
    rows = spark.read.schema(f"{column} string").csv(path, header=True, multiLine=True, escape='"').select(column, F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    within = F.row_number().over(Window.partitionBy("__file").orderBy("__at")) - 1  # a file's rows are read in order
    sizes = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sizes = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.withColumn("__within", within).join(sizes, "__file").select(column, (F.col("__base") + F.col("__within")).alias(name))


class IndexStore:
    """Keyword indexes by tenant and site: partitions of a table, so a search reads only its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, postings: DataFrame) -> None:
        """postings with user_id and site_slug; the partitions it holds replace stored ones."""
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
            postings.write.partitionBy("user_id", "site_slug").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def load(self, user_id: str, site_slug: str | None = None) -> DataFrame:
        if not user_id:
            raise ValueError("a tenant is required")
        rows = self.spark.read.parquet(self.path).filter(F.col("user_id") == user_id)
        return rows if site_slug is None else rows.filter(F.col("site_slug") == site_slug)

    def delete(self, user_id: str, site_slug: str) -> bool:
        """Drop one site's partition; whether there was one."""
        return remove(self.spark, f"{self.path}/user_id={user_id}/site_slug={site_slug}")


def upsert_vectors(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored vectors with those of new in place of equal keys. Keys hold the tenant, so tenants can't collide."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_vectors(stored: DataFrame, document: Column, tenant: Column) -> DataFrame:
    return stored.filter(~F.coalesce(document & tenant, F.lit(False)))


def sitemap_locations(xml: Column) -> tuple[Column, Column]:
    """Pages and further sitemaps that a sitemap names, whatever the namespace."""
    step = '/*[name()="{0}" or substring-after(name(), ":")="{0}"]'
    path = lambda *names: F.lit("".join(step.format(n) for n in names) + "/text()")
    return F.xpath(xml, path("urlset", "url", "loc")), F.xpath(xml, path("sitemapindex", "sitemap", "loc"))


def sitemap_pages(root: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """base, url: pages of the base domain that the sitemaps name, following indexes `depth` levels down.

    root: base, sitemap (address). files: sitemap, xml.
    """
    found, level = None, root.select("base", "sitemap")
    for _ in range(depth + 1):
        read = level.join(files, "sitemap")
        pages, maps = sitemap_locations(F.col("xml"))
        here = read.select("base", F.explode(F.transform(pages, lambda x: F.trim(x))).alias("url")).filter(F.startswith("url", "base"))
        found = here if found is None else found.unionByName(here)
        level = read.select("base", F.explode(F.transform(maps, lambda x: F.trim(x))).alias("sitemap"))
    return found.distinct()


def first_sitemap(tried: DataFrame) -> DataFrame:
    """base, urls: of the well-known addresses, in order, the first with pages. tried: base, priority, urls."""
    return tried.filter(F.size("urls") > 0).groupBy("base").agg(F.min_by("urls", "priority").alias("urls"))


def crawl(pages: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """base, url, depth: pages reached from each site's start over links, breadth first.

    pages: url, html. A level is a join of the frontier with the links and an anti-join with what was
    seen; admissible() says which links count. Only stored pages are results. Links are followed
    max_depth levels down. Each level is written to a shared folder, so plans don't grow by level.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "crawl")

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    norm = pages.select(U.normalised(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    links = F.regexp_extract_all("html", F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))
    edges = norm.select("url", F.explode(links).alias("href")).select("url", U.normalised(U.resolved(F.col("url"), F.col("href"))).alias("to")).distinct()
    edges = save(edges, "links")
    level = starts.select("base", "start", U.normalised(F.col("start")).alias("url")).withColumn("depth", F.lit(0))
    seen = level = save(level, "depth-0")
    for depth in range(1, max_depth + 1):
        nxt = level.join(edges, "url").select("base", "start", F.col("to").alias("url")).filter(U.admissible(F.col("url"), F.col("start"))).distinct()
        level = nxt.join(seen.select("base", "url"), ["base", "url"], "left_anti").withColumn("depth", F.lit(depth))
        level = save(level.join(norm.select("url"), "url", "left_semi").select("base", "start", "url", "depth"), f"depth-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("base", "url", "depth")


__all__ = ["IndexStore", "crawl", "csv_by_position", "delete_vectors", "exists", "first_sitemap", "is_folder", "remove", "shared_folder", "sitemap_pages", "small_batches", "state_of", "still_there", "stored", "tidy", "upsert_vectors"]
