"""Relational operators that keep the order-dependent results of list processing, by explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import shared_folder


def ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of the columns, without one task that sees them all.

    Rows are range-partitioned and stored with their partition and their place in it, so that counts
    and numbers come from the same ranges (which Spark draws anew each time); then they are numbered
    from their partition's base.
    """
    spark, part, place, base = df.sparkSession, "__p", "__i", "__base"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    path = shared_folder(spark, "ordinal")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = ranged.groupBy(part).agg(F.count("*").alias("__n")).select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    return ranged.join(F.broadcast(sizes), part).withColumn(name, F.col(base) + F.col(place)).drop(part, place, base)


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in the order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank from 1; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UPDATE by key: each non-null value of new replaces old's; keys that old lacks change nothing.

    Of several values of new for one key the greatest holds; where they have an order, see changes.apply_changes().
    """
    fields = [c for c in old.columns if c not in keys]
    renamed = new.groupBy(*keys).agg(*(F.max(c).alias(f"__new_{c}") for c in fields if c in new.columns))
    out = old.join(renamed, keys, "left")
    return out.select(*keys, *(F.coalesce(f"__new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in fields))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: on a conflict only the updated columns take new values."""
    fields = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in fields), F.lit(True).alias("__there"))
    o = old.withColumn("__had", F.lit(True))
    out = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("__had").isNull() | (F.col("__there").isNotNull() & F.lit(c in updated)), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
    return out.select(*keys, *(pick(c) for c in fields))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET: one page of a listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def tenant_rows(df: DataFrame, tenant: object, column: str = "user_id") -> DataFrame:
    """Rows of one tenant; a missing tenant is an error, not all rows."""
    if tenant is None or tenant == "":
        raise ValueError("a tenant is required")
    return df.filter(F.col(column) == F.lit(tenant))
