"""Shared folder, materialisation, Arrow limits and connected components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ordinal
from ..sources.storage import remove, shared_folder, small_batches, stored

#: Stands for a null document id inside an operator; it sorts before every id.
NULL_ID = -(2**63)

#: Ids that may be broadcast for a semi join: at 8 bytes each, a relation of some 10 MB.
BROADCAST_IDS = 400_000


#: Lists of the workspaces made since; see discarded_workspaces().
_NOTED: list[list["Workspace"]] = []


@contextmanager
def discarded_workspaces():
    """Workspaces made within are deleted at its end: for steps whose result has been stored elsewhere by then."""
    made: list[Workspace] = []
    _NOTED.append(made)
    try:
        yield
    finally:
        _NOTED.remove(made)
        for work in made:
            remove(work.spark, work.root)


class Workspace:
    """A folder of its own below spark.checkpoint.dir, for tables that cut lineage.

    All executors see the folder, so the loss of an executor costs only the tasks it was running.
    What is left of it goes when the application ends. Arrow batches are held to few rows and few
    bytes, so that very long texts stay within a worker's memory: a session's larger limits are
    lowered for good, as results are computed after an operator has returned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_folder(spark, name), 0
        for noted in _NOTED:
            noted.append(self)
        small_batches(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, self.path(name))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                if self.root.split("://")[-1].lstrip("/") in folder:
                    remove(self.spark, folder)


#: A key is hot if it has more than so many of a side's rows, and more than one in HOT_SHARE of them all.
HOT_ROWS, HOT_SHARE = 4096, 10_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counted: str | None = None, total: int | None = None) -> DataFrame:
    """left joined with right, which has one row for each key, whatever share of left one key has.

    Of hot keys there are HOT_SHARE at most, so their rows of right are broadcast; the others are
    joined by a shuffle. Both sides should be stored tables, as they are read twice. counted names a
    column of right with the key's number of left's rows; without it they are counted here. total is
    the number of left's rows, if it is known.
    """
    total = left.count() if total is None else total
    if total <= HOT_ROWS:
        return left.join(right, keys, how)
    least = max(HOT_ROWS, total // HOT_SHARE)
    if counted is None:
        many = left.groupBy(*keys).agg(F.count("*").alias("__count")).filter(F.col("__count") > least).select(*keys)
        hot = right.join(F.broadcast(many), keys, "left_semi")
    else:
        hot = right.filter(F.col(counted) > least)
    both = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, how)
    return both.unionByName(rest)


def unused(name: str, columns: list[str]) -> str:
    """A column's name that is not among columns, whatever their case."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name += "_"
    return name


def known_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def shown_id(c: Column) -> Column:
    return F.nullif(c, F.lit(NULL_ID))


def held_out(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def few(ids: DataFrame, work: Workspace, name: str) -> tuple[DataFrame, bool]:
    """A table of ids, stored, and whether a count proves that it may be broadcast."""
    ids = work.save(ids, name)
    return ids, ids.count() <= BROADCAST_IDS


def semi_by_id(docs: DataFrame, key: str, ids: DataFrame, name: str, work: Workspace) -> DataFrame:
    """Rows of docs whose key is among ids; ids are broadcast only if a count proves them few."""
    wanted = unused("wanted", docs.columns)
    ids, small = few(ids.select(F.col(name).alias(wanted)), work, "wanted")
    return docs.join(F.broadcast(ids) if small else ids, F.col(key) == F.col(wanted), "left_semi")


def anti_by_id(docs: DataFrame, key: str, ids: DataFrame, name: str, work: Workspace) -> DataFrame:
    """Rows of docs whose key is not among ids; ids are broadcast only if a count proves them few."""
    dropped = unused("dropped", docs.columns)
    ids, small = few(ids.select(F.col(name).alias(dropped)), work, "dropped")
    return docs.join(F.broadcast(ids) if small else ids, known_id(key) == F.col(dropped), "left_anti")


#: Parts whose sizes one task adds up in order.
SUMMED = 1000


def with_bases(parts: DataFrame, keys: list[str], part: str, size: str) -> DataFrame:
    """parts, one row for each keys and part (from 0), with base: the sum of size over the earlier parts of its keys.

    Runs of SUMMED parts are added up first, so a key with very many parts is not one task's.
    """
    run = F.floor(F.col(part) / SUMMED)
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy(*keys, run.alias("__run")).agg(F.sum(size).alias("__size"))
    runs = runs.select(*keys, "__run", F.coalesce(F.sum("__size").over(before(keys, "__run")), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum(size).over(before([*keys, "__run"], part)), F.lit(0))
    out = parts.withColumn("__run", run).withColumn("__within", within).join(runs, [*keys, "__run"])
    return out.withColumn("base", F.col("__base") + F.col("__within")).drop("__run", "__base", "__within")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp): for every end of an edge (a, b), the smallest node it reaches.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the
    logarithm of a component's width. Each round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = work.save(both, "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    labels = work.save(labels.select("node", F.least("node", "m").alias("comp"), "degree"), "labels")
    n_both, n_nodes = both.count(), labels.count()
    while True:
        near = join_hot(both, labels.select(F.col("node").alias("v"), "comp", "degree"), ["v"], counted="degree", total=n_both).groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        new = work.save(labels.join(near, "node").select("node", "degree", "comp", F.least("comp", "near").alias("to")), "nearer")
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("jump"))
        jumped = join_hot(new, jump, ["to"], total=n_nodes).select("node", "degree", F.col("comp").alias("was"), F.least("to", "jump").alias("comp"))
        jumped = work.save(jumped, "labels")
        work.drop(new, labels)
        labels = jumped.select("node", "comp", "degree")
        if jumped.filter("was <> comp").isEmpty():
            work.drop(both)
            return labels.select("node", "comp")


def numbered_texts(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, uid, text) of every row, and (uid, text) once: uid orders documents by id and names one text.

    It is the id itself unless an id is repeated; then rows of the same id and text share a uid, and
    texts of the same id are ordered by their SHA-256.
    """
    texts = docs.select(known_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.select("doc_id", F.col("doc_id").alias("uid"), "text")
        return texts, texts.select("uid", "text")
    named = texts.withColumn("sha", F.sha2("text", 256))
    order = work.save(ordinal(named.select("doc_id", "sha").distinct(), ["doc_id", "sha"], "uid"), "order")
    texts = named.join(order, ["doc_id", "sha"]).select("doc_id", "uid", "text")
    return texts, texts.dropDuplicates(["uid"]).select("uid", "text")
