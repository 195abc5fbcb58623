"""Extracted pages written out for inspection, by kind of extraction: one row is one file's name and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import word_count

SHAPE = "url string, name string, words long, chars long, body string, kind string"


def dumps_of(pages: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """url, name, words, chars, body, kind: every page once for each kind, whose column is its text (null: empty).

    pages: url, title and what the columns need. A name is the address's slug and the kind; pages of one
    slug have one name and different addresses. Markdown has a head with title, address, kind and words;
    html has none.
    """
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(text, F.lit("")).alias("text")) for kind, text in kinds.items()])
    rows = pages.select("url", "title", F.explode(items).alias("x")).select("url", "title", "x.kind", "x.text")
    rows = rows.withColumn("words", word_count(F.col("text")).cast("long")).withColumn("chars", F.length("text").cast("long"))
    ending = F.when(F.col("kind") == "html", ".html").otherwise(".md")
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit("# "), known("title"), F.lit("\nSource: "), known("url"), F.lit("\nMethod: "), F.col("kind"), F.lit("\nWords: "), F.col("words").cast("string"), F.lit("\n\n---\n\n"))
    body = F.when(F.col("kind") == "html", F.col("text")).otherwise(F.concat(head, F.col("text")))
    name = F.concat(U.url_slug(known("url"), "page"), F.lit("__"), F.col("kind"), ending)
    return rows.select("url", name.alias("name"), "words", "chars", body.alias("body"), "kind")


def write_dumps(pages: DataFrame, kinds: dict[str, Column], path: str) -> None:
    """Dumps as JSON lines in a folder for each kind, in place of what path held."""
    dumps_of(pages, kinds).write.partitionBy("kind").mode("overwrite").json(path)


def read_dumps(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Written dumps, of one kind or all; one kind's folder alone is read."""
    rows = spark.read.schema(SHAPE).json(path)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def compared(dumps: DataFrame) -> DataFrame:
    """A row for each address, with words and characters of every kind, to tell which extraction lost text."""
    kinds = [r.kind for r in dumps.select("kind").distinct().orderBy("kind").collect()]  # as many as there are folders
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    return dumps.groupBy("url").agg(*[pick(k, c) for k in kinds for c in ("words", "chars")])
