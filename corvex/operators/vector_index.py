"""A vector index of cells: coarse centroids, rows stored by their nearest one, a few cells read for each query, exact scores.

Centroids are fitted on a bounded sample, every row is assigned and stored. How many cells a query
reads is measured: the fewest that hold the wanted share of the true neighbours of a bounded sample of
rows, whose neighbours are found by an exact search. So clustered vectors read few cells, and
vectors without structure read most of them, but none loses more than was asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder, small_batches, stored, tidy
from .relational import ordinal, top

#: Rows that centroids are fitted on, at most, and whose neighbours tell how many cells to read: those with the least hash of their id.
SAMPLE, TRIED = 8192, 64
#: Cells at most, and rows of a cell, some.
MAX_CELLS, CELL_ROWS = 4096, 256
#: Queries of one batch, which every task of a search holds; scores that a task makes at once.
MAX_QUERIES, SCORES = 10_000, 4_000_000
#: Pairs of a query and a row that a task holds before it leaves out all but the best.
PAIRS = 2_000_000


class VectorIndex:
    """rows: id, tenant, cell, vector (stored by cell, in a cell by tenant); centroids, of length 1; probes: cells that a query reads."""

    def __init__(self, path: str, rows: DataFrame, centroids: np.ndarray, probes: int):
        self.path, self.rows, self.centroids, self.probes = path, rows, centroids, probes


def matrix_of(vectors: pd.Series, width: int = 1) -> np.ndarray:
    """Vectors as rows; width is that of no rows."""
    return np.array(vectors.tolist(), np.float64) if len(vectors) else np.zeros((0, width))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def fit_centroids(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from rows that are spread over the sample."""
    rows = np.unique(unit(sample), axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)]
    for _ in range(steps):
        near = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, unit(sums), centres)
    return centres


def build_vector_index(vectors: DataFrame, id_col: str, vector_col: str, tenant_col: str | None = None, cells: int | None = None, recall: float = 0.95, k: int = 25, path: str | None = None) -> VectorIndex:
    """Every row of vectors (ids long, arrays of equal length) by its cell. Null vectors and such with nulls take no part.

    cells: as many as the rows are worth, by default. recall: the share of the k true neighbours
    that probes are chosen for.
    """
    spark = vectors.sparkSession
    path = path or shared_folder(spark, "cells")
    tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), tenant.alias("tenant"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = stored(rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())), f"{path}/given")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # bounded by SAMPLE
    given = matrix_of(sample.vector)
    centroids = fit_centroids(given, cells or min(MAX_CELLS, max(1, n // CELL_ROWS))) if n else np.zeros((1, 1))
    held = spark.sparkContext.broadcast(centroids)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            v = unit(matrix_of(b.vector, held.value.shape[1]))
            yield b.assign(cell=np.argmax(v @ held.value.T, axis=1).astype("int32"))

    dealt = rows.mapInPandas(assign, "id long, tenant string, vector array<double>, cell int")
    with tidy(spark):  # a cell that holds a large share of the rows is split, as Spark finds
        dealt.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "tenant", "id").write.partitionBy("cell").parquet(f"{path}/rows")
    out = load_rows(spark, path)
    index = VectorIndex(path, out, centroids, len(centroids))
    tried = sample.head(TRIED)
    if len(tried) and len(centroids) > 1:
        asked = spark.createDataFrame(tried[["id", "tenant", "vector"]], "id long, tenant string, vector array<double>")
        true = search_cells(index, asked, k, own_tenant=tenant_col is not None).toPandas()
        index.probes = enough_cells(true, tried, centroids, recall)
    spark.createDataFrame([(centroids.astype(float).tolist(), index.probes)], "centroids array<array<double>>, probes int").write.parquet(f"{path}/cells")
    return index


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, tenant string, vector array<double>, cell int").parquet(f"{path}/rows")


def load_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that build_vector_index() stored at path."""
    cells = spark.read.parquet(f"{path}/cells").first()
    return VectorIndex(path, load_rows(spark, path), np.array(cells["centroids"], np.float64), cells["probes"])


def enough_cells(true: pd.DataFrame, tried: pd.DataFrame, centroids: np.ndarray, recall: float) -> int:
    """The fewest cells, in order of a query's centroids, that hold the share of its true neighbours (query_id, cell)."""
    if not len(true):
        return len(centroids)
    order = np.argsort(-(unit(matrix_of(tried.vector)) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    row = {i: r for r, i in enumerate(tried.id)}
    ranks = np.sort(place[true.query_id.map(row).to_numpy(), true.cell.to_numpy()])
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1


class Best:
    """The k best rows of each query of a task so far, by similarity and id; found pairs are put in order PAIRS at a time."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.size = k, np.full(n, -np.inf), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, mine: np.ndarray, q: np.ndarray, v: np.ndarray, ids: np.ndarray, cell: np.ndarray, own: np.ndarray | None) -> None:
        """Queries `mine` against rows: what may be among the k best is kept, ties included. own: the queries' ids, whose rows are left out."""
        step = max(1, SCORES // max(1, len(v)))
        for lo in range(0, len(mine), step):
            some = mine[lo : lo + step]
            sims = q[some] @ v.T
            for j in np.flatnonzero(np.isin(ids, own[some])) if own is not None else ():
                sims[own[some] == ids[j], j] = -np.inf
            least = self.least[some]
            if len(v) > self.k and np.isinf(least).any():
                least = np.fmax(least, -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(~(sims < (least - 1e-6)[:, None]))  # similarities are rounded after this
            self.parts.append((some[i], np.round(sims[i, j], 6), ids[j], cell[j]))
            self.size += len(i)
            if self.size >= PAIRS:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Queries, similarities, ids and cells of the best."""
        if not self.parts:
            return ()
        query, sim, ids, cell = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -sim, query))
        start = np.flatnonzero(np.diff(query[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        last = order[place == self.k - 1]
        self.least[query[last]] = sim[last]
        kept = order[place < self.k]
        self.parts, self.size = [(query[kept], sim[kept], ids[kept], cell[kept])], len(kept)
        return self.parts[0]


def _cells_read(q: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray | None:
    """Bits, by cell, of the queries that read it; none if all do."""
    if probes >= len(centroids):
        return None
    reads = np.zeros((len(centroids), len(q)), bool)
    for lo in range(0, len(q), 500):
        order = np.argsort(-(q[lo : lo + 500] @ centroids.T), axis=1, kind="stable")[:, :probes]
        reads[order, np.arange(lo, lo + len(order))[:, None]] = True
    return np.packbits(reads, axis=1)


def search_cells(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, own_tenant: bool = True, others_only: bool = True) -> DataFrame:
    """query_id, rank, id, cell, sim: the k rows of the highest cosine (rounded to 6 places) in the cells that each query (id, tenant, vector) reads.

    Equal ones go by id. own_tenant: rows of the query's tenant alone, which the scan is told. others_only:
    a row is not its own neighbour. probes: cells a query reads; the index's, by default; with all of them the search is
    exact. A task multiplies blocks of rows with all queries that read them and passes on k rows a query.
    At most MAX_QUERIES queries; search_batches() takes more.
    """
    spark = queries.sparkSession
    asked = queries.select("id", "tenant", "vector").limit(MAX_QUERIES + 1).toPandas()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in a batch")
    q = unit(matrix_of(asked.vector, index.centroids.shape[1]))
    reads = _cells_read(q, index.centroids, min(probes or index.probes, len(index.centroids)))
    held = spark.sparkContext.broadcast((asked.id.to_numpy(), asked.tenant.to_numpy(), q, reads))
    small_batches(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, tenants, q, reads = held.value
        mine = {t: np.flatnonzero(tenants == t) for t in set(tenants)} if own_tenant else {None: np.arange(len(asked))}
        best = Best(len(asked), k)
        for b in parts:
            by = ([] if reads is None else ["cell"]) + (["tenant"] if own_tenant else [])
            for key, some in b.groupby(by, sort=False, dropna=False) if by else [((), b)]:
                want = mine.get(key[-1] if own_tenant and not pd.isna(key[-1]) else None, np.zeros(0, int))
                if reads is not None:
                    want = want[np.unpackbits(reads[key[0]], count=len(asked))[want] == 1]
                if len(want):
                    best.add(want, q, unit(matrix_of(some.vector)), some.id.to_numpy(), some.cell.to_numpy(), asked if others_only else None)
        if found := best.settle():
            query, sim, ids, cell = found
            for lo in range(0, len(ids), 100_000):
                at = np.flatnonzero(sim[lo : lo + 100_000] != -np.inf) + lo
                yield pd.DataFrame({"query_id": asked[query[at]], "id": ids[at], "cell": cell[at], "sim": sim[at]})

    rows = index.rows
    if reads is not None:  # partitions: other cells are not listed
        rows = rows.filter(F.col("cell").isin(np.flatnonzero(reads.any(axis=1)).tolist()))
    if own_tenant and 0 < asked.tenant.nunique() <= 10:
        rows = rows.filter(F.col("tenant").isin(sorted(set(asked.tenant))))
    near = rows.mapInPandas(run, "query_id long, id long, cell int, sim double")
    return top(near, ["query_id"], [F.desc("sim"), "id"], k)


def search_batches(index: VectorIndex, queries: DataFrame, k: int, **options) -> DataFrame:
    """search_cells() for any number of queries of distinct ids, MAX_QUERIES at a time."""
    n = queries.count()
    if n <= MAX_QUERIES:
        return search_cells(index, queries, k, **options)
    numbered = ordinal(queries, ["id"], "__at")
    parts = [numbered.filter(F.floor(F.col("__at") / MAX_QUERIES) == i).drop("__at") for i in range(-(-n // MAX_QUERIES))]
    return reduce(DataFrame.unionByName, (search_cells(index, part, k, **options) for part in parts))


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, wanted, hit: true neighbours (query_id, id) and how many of them were found; one row."""
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"))
