"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt out in blocks, each once, and every block gets a copy of the queries, in as few
bytes a component as the largest one needs. In its block every dimension has a sorted list, built
once. The task walks all lists at once, from both ends (a query's sign says which end is its best),
scores each candidate when it first appears, and keeps each query's k best. The values where the
lists stand bound every unseen candidate's score; a query is done once its k-th score is above that
bound. Blocks are searched in rounds, each of four times as many as all before, and a query carries
its k-th score into the next one: that ends walks, and a round passes on only what may enter the k
best, some 60 rows a query however many candidates there are.

In many dense dimensions the bound rarely stops a walk before the end; results are exact either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace
from .kernels import released

#: Bytes of a block's candidates as numbers of 8 bytes; the fewest candidates that a block is made for.
BLOCK_BYTES, LEAST_BLOCK = 32 << 20, 512
#: Blocks of a table of any size, if it has rows enough.
BLOCKS = 48
#: Blocks of the first round, and how many times as many are searched after each next one.
FIRST_ROUND, GROWTH = 4, 4
#: Stands for the k-th score of a query that has fewer.
NO_SCORE = -(2**63)
#: Queries that walk the lists together, and new candidates that they score at once.
QUERIES, SCORED = 1024, 4096
FIRST_DEPTH = 16


class Lists:
    """Candidates of one block in order of id, with a sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.largest = int(np.abs(self.vectors).max(initial=0))


def fagin(block: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its best candidates of other ids, as (ids, scores), scores falling, then ids rising.

    Vectors hold whole numbers. Equal scores go to the smaller id, so a query is done only when its
    k-th score is strictly above the bound. least: scores that a query's candidates must reach.
    """
    ids, vectors, lists = block.ids, block.vectors, block.lists
    n, dims = vectors.shape
    exact = dims * float(block.largest) * float(np.abs(queries).max(initial=0)) * (n + 1) < 2**52
    kind = np.float64 if exact else object
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    seen = np.zeros(n, bool)
    factor = n + 1  # a score and a place, in the order wanted, as one number
    nothing = -np.inf if exact else -(10**60)
    best = np.full((len(queries), k), nothing, kind)
    live, depth = np.arange(len(queries)), 0
    while len(live) and not seen.all():
        deeper = min(n, max(FIRST_DEPTH, 2 * depth))
        new = np.unique(np.concatenate([lists[depth:deeper].ravel(), lists[n - deeper : n - depth].ravel()]))
        new, depth = new[~seen[new]], deeper
        seen[new] = True
        for at in range(0, len(new), SCORED):
            some = new[at : at + SCORED]
            keys = (queries[live] @ vectors[some].T) * factor - some
            keys[query_ids[live][:, None] == ids[some][None, :]] = nothing
            keys = np.concatenate([best[live], keys], axis=1)
            best[live] = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:] if exact else np.sort(keys, axis=1)[:, -k:]
        if depth < n:
            high, low = (vectors[lists[at], np.arange(dims)] for at in (n - depth - 1, depth))
            q = queries[live]
            bound = np.maximum(q * high, q * low).sum(axis=1)
            kth = best[live].min(axis=1)
            done = (kth > bound * factor) & (kth != nothing)
            if least is not None:
                done |= bound < least[live]
            live = live[~done]
    out = []
    for i, row in enumerate(best):
        row = np.sort(row[row != nothing])[::-1]
        scores = np.array([-((-x) // factor) for x in row], row.dtype)  # places are below factor, so rounding up gives the score
        at = (scores * factor - row).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        good = slice(None) if least is None else scores >= least[i]
        out.append((ids[at][good], scores.astype(np.int64)[good]))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _search(k: int, width: int):
    """Rows come ordered by block, its candidates before the queries."""

    def found(block, asked):
        ids, vectors, least = (np.concatenate([a[c] for a in asked]) for c in range(3))
        hits = fagin(block, ids, vectors, k, least)
        table = pd.DataFrame({"query_id": np.repeat(ids, [len(i) for i, _ in hits]), "vec_id": np.concatenate([i for i, _ in hits]), "score": np.concatenate([s for _, s in hits])})
        return pa.RecordBatch.from_pandas(table.astype("int64"), preserve_index=False)

    def run(batches):
        at, parts, lists, asked = None, [], None, []
        for batch in batches:
            blocks, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asked"))
            ids, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "least"))
            vectors = matrix(batch.column("v"), width)
            for b in np.unique(blocks):
                if b != at:
                    if asked:
                        yield found(lists, asked)
                    at, parts, lists, asked = b, [], None, []
                mine = blocks == b
                if (c := mine & ~is_query).any():
                    parts.append((ids[c], vectors[c]))
                q = np.flatnonzero(mine & is_query)
                if len(q) and parts:
                    if lists is None:
                        lists = Lists(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
                    for lo in range(0, len(q), QUERIES):
                        some = q[lo : lo + QUERIES]
                        asked.append((ids[some], vectors[some], least[some]))
                        if sum(len(a[0]) for a in asked) >= QUERIES:
                            yield found(lists, asked)
                            asked = []
        if asked:
            yield found(lists, asked)

    return released(run)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def top_k(vectors: DataFrame, asked: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query.

    asked marks the rows that are queries; every other id's rows are candidates. All of them, if
    there are fewer than k. Rows with a null id, a null vector, or a vector holding null or
    non-finite components take no part; shorter vectors count as padded with zeros. Of rows that
    agree in id and vector one takes part; an id with several vectors is a query with each of them,
    ranked together, and never its own candidate. Other columns are not read unless asked does. An
    empty table gives an empty result.

    A block has some BLOCK_BYTES of candidates, so the table is shuffled once, and the queries once
    for each block.
    """
    work = Workspace(vectors.sparkSession, "topk")
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(v, scale).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).distinct()
    rows = work.save(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    n, width = size["n"], max(1, size["width"] or 0)
    bits = max(int(size["high"] or 0), -int(size["low"] or 0) - 1).bit_length() + 1
    kind = next(name for name, most in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)) if bits <= most)
    blocks = max(-(-8 * width * n // BLOCK_BYTES), min(BLOCKS, n // LEAST_BLOCK), 1)

    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    candidates = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "vec_id", "v", F.lit(NO_SCORE).alias("least"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, lo, hi = None, 0, FIRST_ROUND
    while True:
        hi = min(blocks, hi)
        queries = rows.filter("asked").withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        if best is not None:
            reached = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
            queries = queries.join(reached, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(NO_SCORE)))
        else:
            queries = queries.withColumn("least", F.lit(NO_SCORE))
        dealt = candidates.filter((F.col("block") >= lo) & (F.col("block") < hi)).unionByName(queries.select("block", "asked", "vec_id", "v", "least"))
        dealt = dealt.repartitionByRange(4 * (hi - lo), "block").sortWithinPartitions("block", "asked")
        found = dealt.mapInArrow(_search(k, width), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if hi == blocks:
            return found
        best, lo, hi = work.save(found, "best"), hi, hi * GROWTH
