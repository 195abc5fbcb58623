"""Changes of a catalog: an ordered log folded by field, deletion along declared references, policies for reads and writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_folder, stored

# ---- change log ----------------------------------------------------------------------------------


def fold_changes(log: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each key: each field's last non-null value in the order of the log, whatever order its rows arrive in.

    Of values with equal order the greatest holds, so repeated changes change nothing. An aggregate
    with partial results, so one key may have any share of the log.
    """
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__value"))))["__value"]
    return log.groupBy(*keys).agg(*(last(c).alias(c) for c in fields))


def apply_changes(old: DataFrame, log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of old with the log's changes: UPDATE by key. Keys that old lacks change nothing, fields that the log lacks stay."""
    fields = [c for c in old.columns if c not in keys]
    changed = [c for c in fields if c in log.columns]
    new = fold_changes(log, keys, order, changed).select(*keys, *(F.col(c).alias(f"__new_{c}") for c in changed))
    out = old.join(new, list(keys), "left")
    return out.select(*keys, *(F.coalesce(f"__new_{c}", c).alias(c) if c in changed else F.col(c) for c in fields))


def job_states(log: DataFrame, key: str, order: Sequence[str], status: str, time: str, terminal: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """A job's row from the log of its changes: status and fields as last told, started_at, ended_at, changes.

    A job starts with its first change. It has ended if its last status is terminal: at the last change that says so.
    """
    folded = fold_changes(log, [key], order, [status, *fields])
    ends = F.when(F.col(status).isin(*terminal), F.col(time))
    times = log.groupBy(key).agg(F.min(time).alias("started_at"), F.max(ends).alias("__ended"), F.count("*").alias("changes"))
    out = folded.join(times, key)
    return out.withColumn("ended_at", F.when(F.col(status).isin(*terminal), F.col("__ended"))).drop("__ended")


# ---- deletion along references -------------------------------------------------------------------


@dataclass(frozen=True)
class Reference:
    """Rows of child that have no meaning without a row of parent: child_keys there are parent_keys here."""

    child: str
    child_keys: tuple[str, ...]
    parent: str
    parent_keys: tuple[str, ...]


def _pointed(rows: DataFrame, ref: Reference) -> DataFrame:
    return rows.select(*(F.col(p).alias(c) for p, c in zip(ref.parent_keys, ref.child_keys))).distinct()


def delete_closure(tables: dict[str, DataFrame], references: Sequence[Reference], doomed: dict[str, Column]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables without the doomed rows and all that refer to them, directly or not; and the rows that go, by table.

    doomed: a condition for rows of a table that are to go. Each step finds the children of the rows
    that the step before found; references may form cycles, or join a table with itself, as a key is found once. What is
    stored are the keys that references lose, so a table to which none refers is read but for its
    result, by joins on its keys alone. Children whose reference is null stay.
    """
    spark = next(iter(tables.values())).sparkSession
    path, step = shared_folder(spark, "closure"), 0
    lost: dict[Reference, DataFrame] = {}
    new = {name: tables[name].filter(c) for name, c in doomed.items()}
    while new:
        step += 1
        here: dict[Reference, DataFrame] = {}
        for i, ref in enumerate(references):
            if ref.parent not in new:
                continue
            keys = _pointed(new[ref.parent], ref).dropna()
            keys = keys.join(lost[ref], list(ref.child_keys), "left_anti") if ref in lost else keys
            keys = stored(keys, f"{path}/{step:03d}-{i}")
            if not keys.isEmpty():
                here[ref] = keys
        lost |= {ref: lost[ref].unionByName(keys) if ref in lost else keys for ref, keys in here.items()}
        new = {}
        for ref, keys in here.items():
            if any(r.parent == ref.child for r in references):
                rows = tables[ref.child].join(keys, list(ref.child_keys), "left_semi").select(*tables[ref.child].columns)
                new[ref.child] = new[ref.child].unionByName(rows) if ref.child in new else rows
    kept, removed = {}, {}
    for name, rows in tables.items():
        condition = F.coalesce(doomed[name], F.lit(False)) if name in doomed else F.lit(False)
        left, gone = rows.filter(~condition), [rows.filter(condition)] if name in doomed else []
        for ref, keys in lost.items():
            if ref.child == name:  # what one reference takes, the next doesn't see
                gone.append(left.join(keys, list(ref.child_keys), "left_semi").select(*rows.columns))
                left = left.join(keys, list(ref.child_keys), "left_anti").select(*rows.columns)
        kept[name], removed[name] = left, reduce(DataFrame.unionByName, gone) if gone else rows.limit(0)
    return kept, removed


def orphans(tables: dict[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """child, parent, orphans: for each reference, the rows of child whose parent is not there; null references are none."""
    out = []
    for ref in references:
        rows = tables[ref.child].dropna(subset=list(ref.child_keys)).join(_pointed(tables[ref.parent], ref), list(ref.child_keys), "left_anti")
        out.append(rows.agg(F.count("*").alias("orphans")).select(F.lit(ref.child).alias("child"), F.lit(ref.parent).alias("parent"), "orphans"))
    return reduce(DataFrame.unionByName, out)


# ---- policies ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Who may read and write which rows of a table: conditions on a row and the tenant. Without `writes`, `reads` holds for both."""

    table: str
    reads: Callable[[Column], Column]
    writes: Callable[[Column], Column] | None = None
    #: Further demands on what is written, by name, as columns or SQL: a row of which one is not true is refused by that name.
    checks: dict[str, Column | str] = field(default_factory=dict)


def owned(table: str, column: str = "user_id", **checks: Column | str) -> Policy:
    """The policy that rows are their owner's alone."""
    return Policy(table, lambda tenant: F.col(column) == tenant, checks=checks)


class Policies:
    """A registry. A table without a policy can be neither read nor written; of several policies of a table one must allow a row."""

    def __init__(self, *policies: Policy):
        self.of: dict[str, list[Policy]] = {}
        for p in policies:
            self.of.setdefault(p.table, []).append(p)

    def _allowed(self, name: str, tenant: object, write: bool) -> Column:
        if tenant is None or tenant == "":
            raise ValueError("a tenant is required")
        rules = [(p.writes if write and p.writes else p.reads)(F.lit(tenant)) for p in self.of.get(name, [])]
        return F.coalesce(reduce(Column.__or__, rules, F.lit(False)), F.lit(False))

    def readable(self, name: str, rows: DataFrame, tenant: object) -> DataFrame:
        """The rows that the tenant may see."""
        return rows.filter(self._allowed(name, tenant, False))

    def views(self, tables: dict[str, DataFrame], tenant: object, prefix: str = "") -> list[str]:
        """Temporary views of what the tenant may see, for SQL; their names."""
        for name, rows in tables.items():
            self.readable(name, rows, tenant).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in tables]

    def judged(self, name: str, rows: DataFrame, tenant: object) -> DataFrame:
        """rows with `refused`: null, or why a row may not be written ('policy' first, then the first check that fails)."""
        reason = F.when(~self._allowed(name, tenant, True), "policy")
        for p in self.of.get(name, []):
            for why, check in p.checks.items():
                reason = reason.when(~F.coalesce(F.expr(check) if isinstance(check, str) else check, F.lit(False)), why)
        return rows.withColumn("refused", reason)

    def split(self, name: str, rows: DataFrame, tenant: object) -> tuple[DataFrame, DataFrame]:
        """The rows of a write that may be written, and the refused ones with their reason."""
        judged = self.judged(name, rows, tenant)
        return judged.filter(F.col("refused").isNull()).drop("refused"), judged.filter(F.col("refused").isNotNull())
