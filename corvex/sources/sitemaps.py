"""Stored sitemaps as a Python data source: one row for each address that a sitemap names.

Files lie in order of host, in parts of their own, with a table of the hosts that each part spans. A
filter on host reaches the reader, which plans a task for each part that may hold the host and no
other. A host with very many sitemaps lies in several parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .sink import located
from .storage import shared_folder, stored

SHAPE = "host string, sitemap string, kind string, loc string, lastmod string"
#: Files that a task holds at once, and characters that the parser takes at once.
FILES, CHARS = 8, 1 << 16


def store_sitemaps(files: DataFrame, path: str, parts: int) -> None:
    """Write files (host, sitemap, xml) for sitemap_entries(), in some `parts` parts; path is a URI that all executors reach."""
    laid = files.select("host", "sitemap", "xml").repartitionByRange(parts, "host", "sitemap").sortWithinPartitions("host", "sitemap")
    laid.write.parquet(f"{path}/files")
    spans = files.sparkSession.read.schema(laid.schema).parquet(f"{path}/files").groupBy(F.col("_metadata.file_name").alias("file"))
    spans.agg(F.min("host").alias("low"), F.max("host").alias("high")).coalesce(1).write.parquet(f"{path}/spans")


def locations(xml: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(kind, address, lastmod) in order, whatever the namespace; kind is page or sitemap.

    Null names nothing; a file that breaks off or is no XML names what stands before the break.
    """
    parser, above = XMLPullParser(("start", "end")), []
    text = xml or ""
    try:
        for at in range(0, len(text), CHARS):
            parser.feed(text[at : at + CHARS])
            for event, e in parser.read_events():
                if event == "start":
                    above.append(e)
                    continue
                above.pop()
                names = [x.tag.rpartition("}")[2] for x in (*above, e)]
                if names in (["urlset", "url"], ["sitemapindex", "sitemap"]):
                    said = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in e}
                    if said.get("loc"):
                        yield ("page" if names[1] == "url" else "sitemap"), said["loc"], said.get("lastmod") or None
                    above[0].clear()  # read ones don't pile up
    except ParseError:
        return


@dataclass
class Part(InputPartition):
    file: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.hosts = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("host",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = asked if self.hosts is None else self.hosts & asked
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = located(self.path)
        spans = pyarrow.parquet.read_table(f"{root}/spans", filesystem=fs).to_pylist()
        within = lambda s: s["low"] is not None and any(s["low"] <= h <= s["high"] for h in self.hosts)
        return [Part(s["file"]) for s in spans if self.hosts is None or within(s)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:
            return
        fs, root = located(self.path)
        with fs.open_input_file(f"{root}/files/{partition.file}") as f:
            for batch in pyarrow.parquet.ParquetFile(f).iter_batches(FILES, columns=["host", "sitemap", "xml"]):
                for row in batch.to_pylist():
                    if self.hosts is None or row["host"] in self.hosts:
                        for named in locations(row["xml"]):
                            yield (row["host"], row["sitemap"], *named)


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """host, sitemap, kind (page, sitemap), loc, lastmod of what store_sitemaps() wrote.

    Filters by = and IN on host choose the parts that are read. Pushing filters to Python sources is
    switched on for the session.
    """
    name = f"sitemaps_{uuid.uuid4().hex[:12]}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SHAPE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(path)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def pages_of_sitemaps(entries: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """base, url, lastmod: pages of the base domain that the sitemaps name, following indexes `depth` levels down.

    roots: base, sitemap (address). A page that several sitemaps name has the latest lastmod. The
    sitemaps are parsed once. An index that names itself is followed no further than depth.
    """
    entries = stored(entries, shared_folder(entries.sparkSession, "sitemaps"))
    found, level = None, roots.select("base", "sitemap")
    for _ in range(depth + 1):
        read = level.distinct().join(entries, "sitemap")
        here = read.filter(F.col("kind") == "page").filter(F.startswith("loc", "base")).select("base", F.col("loc").alias("url"), "lastmod")
        found = here if found is None else found.unionByName(here)
        level = read.filter(F.col("kind") == "sitemap").select("base", F.col("loc").alias("sitemap"))
    return found.groupBy("base", "url").agg(F.max("lastmod").alias("lastmod"))
