"""Registry of queries: a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Bytes of input for each core below which a table is dealt out.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores.

    A small file of one row group is one task, however many splits it is planned as and however much
    work its texts are. Large inputs have more row groups than cores and are left without a shuffle.
    The size is the planner's estimate, so nothing is listed or read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


#: Tables whose rows are work enough to be dealt out.
HEAVY = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df
