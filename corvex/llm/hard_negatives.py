"""Hard negatives by one-dimensional distance keys.

Every vector x gets one more component, sqrt(M - |x|^2), where M is the largest |x|^2 there is; then
the distance of a query (whose own is 0) to x is |q|^2 + M - 2 q.x under a root, and the highest
inner product is the nearest row. Pivots are fitted on a bounded sample; every row is stored in order
of (its nearest pivot, its distance to it), in blocks that are intervals of that key. By the triangle
inequality a block's rows are no nearer to a query than the distance of the query's own key to the
block's interval, and no farther than the sum of the two. A search scans each query's blocks in order of that
bound, in rounds of ever more, and ends when no block that is left can hold a row in the annulus
that still matters: from a highest score inwards to the k-th score found so far or a lowest score.

In many dense dimensions distances differ little and most blocks are scanned; results are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ordinal
from .common import Workspace
from .kernels import released
from .topk import whole_numbers

#: Rows that pivots are fitted on, at most: those with the least hash of their id. Pivots at most, and rows for each.
SAMPLE, PIVOTS, ROWS_PER_PIVOT = 2048, 64, 512
#: Rows of a block, and blocks at most: the directory of blocks, 24 bytes each, goes to every task.
BLOCK, MAX_BLOCKS = 1024, 1 << 18
#: Blocks that a query's first round scans, and how many times as many have been scanned after each next one.
FIRST_ROUND, GROWTH = 8, 8
#: Queries of one block in one task, some; cells of a score matrix.
QUERIES, CELLS = 20_000, 4_000_000
#: Stand for no highest and no lowest score.
HIGHEST, LOWEST = 2**63 - 1, -(2**63)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit_pivots(sample: np.ndarray, most: float, n: int, steps: int = 6) -> np.ndarray:
    """At most n centres of augmented rows: k-means from rows that are spread over the sample."""
    rows = np.hstack([sample, np.sqrt(np.maximum(most - (sample**2).sum(1, keepdims=True), 0))])
    rows = np.unique(rows, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)]
    for _ in range(steps):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * rows @ centres.T, axis=1)
        centres = np.stack([rows[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (v**2).sum(1) + extra**2
    d = squares[:, None] + (pivots**2).sum(1)[None, :] - 2 * (v @ pivots[:, :-1].T + extra[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(d, 0))


def _keyed(pivots: np.ndarray, most: float):
    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v")).astype(np.float64)
            d = _distances(v, np.sqrt(np.maximum(most - (v**2).sum(1), 0)), pivots)
            near = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), *(batch.column(c) for c in ("vec_id", "label", "v"))], names=["pivot", "key", "vec_id", "label", "v"])

    return released(run)


class Directory:
    """What is known of blocks: their number, pivot and the ends of their key interval; and of all rows, the pivots and M."""

    def __init__(self, rows: list, pivots: np.ndarray, most: float):
        self.block = np.array([r["block"] for r in rows], np.int64)
        self.pivot = np.array([r["pivot"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high"))
        self.pivots, self.most = pivots, most

    def parts(self) -> tuple:
        return self.block, self.pivot, self.low, self.high, self.pivots, self.most


def wanted_blocks(parts: tuple, v: np.ndarray, hi: np.ndarray, least: np.ndarray, start: int, end: int) -> list[np.ndarray]:
    """For each query (rows of v) the blocks from place start to end in its order that can hold a score from least to hi.

    Distances are compared with a margin well above what rounding can do to them.
    """
    block, pivot, low, high, pivots, most = parts
    own = _distances(v, np.zeros(len(v)), pivots)[:, pivot]
    squares = (v**2).sum(1) + most
    slack = 1e-6 * np.sqrt(squares + 1)
    nearest = np.maximum(np.maximum(low[None, :] - own, own - high[None, :]), 0)
    farthest = own + high[None, :]
    inner = np.where(hi == HIGHEST, 0.0, np.sqrt(np.maximum(squares - 2 * hi.astype(np.float64), 0)))
    outer = np.where(least == LOWEST, np.inf, np.sqrt(np.maximum(squares - 2 * least.astype(np.float64), 0)))
    out = []
    for i in range(len(v)):
        near = np.flatnonzero(farthest[i] >= inner[i] - slack[i])  # the same in every round, so places in the order are, too
        order = near[np.argsort(nearest[i, near], kind="stable")[start:end]]
        out.append(block[order[nearest[i, order] <= outer[i] + slack[i]]])
    return out


def _ask(held, start: int, end: int, chunks: int):
    names = ["at", "hi", "lo", "vec_id", "label", "v"]

    def run(batches):
        parts = held.value
        step = max(1, CELLS // max(1, len(parts[0])))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                columns = {c: some.column(c) for c in names}
                blocks = wanted_blocks(parts, matrix(columns["v"]).astype(np.float64), columns["hi"].to_numpy(), some.column("least").to_numpy(), start, end)
                row = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
                if len(row):
                    chunk = columns["at"].to_numpy()[row] % chunks
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(chunk.astype(np.int64)), *(columns[c].take(pa.array(row)) for c in names)], names=["block", "chunk", *names])

    return released(run)


def best_in_block(ids, labels, rows, q_ids, q_labels, q_hi, q_lo, queries, k: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block with a score from lo to hi: rows of its label and another id, or of other labels.

    ids rise, so that of equal scores the smaller ids come first. Scores are whole numbers, exactly.
    """
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0))
    kind = np.float64 if rows.shape[1] * largest < 2**52 else object
    rows, queries = rows.astype(kind), queries.astype(kind)
    step = max(1, CELLS // max(1, len(rows)))
    for at in range(0, len(queries), step):
        scores = queries[at : at + step] @ rows.T
        scores = scores.astype(np.int64)
        for j, score in enumerate(scores):
            i = at + j
            fits = (labels == q_labels[i]) & (ids != q_ids[i]) if same else labels != q_labels[i]
            found = np.flatnonzero(fits & (score <= q_hi[i]) & (score >= q_lo[i]))
            if len(found) > 4 * k:  # ties at the k-th score stay in
                found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
            if len(found):
                found = found[np.argsort(-score[found], kind="stable")[:k]]
                yield i, found, score[found]


def _scan(k: int, same: bool):
    """Batches in order of block, chunk and asked: a block's rows, then its queries."""

    def run(batches):
        now, rows, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "chunk", "asked")], 1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if now != tuple(key[s, :2]):
                    now, rows, block = tuple(key[s, :2]), [], None
                part = {c: batch.column(c).slice(s, e - s) for c in ("at", "hi", "lo", "vec_id", "label", "v")}
                if not key[s, 2]:
                    rows.append((part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["v"])))
                    continue
                if block is None and rows:
                    ids, labels, v = (np.concatenate([r[i] for r in rows]) for i in range(3))
                    order = np.argsort(ids, kind="stable")
                    block, rows = (ids[order], labels[order], v[order]), []
                if block is None:
                    continue
                asked = {c: part[c].to_numpy() for c in ("at", "hi", "lo", "vec_id", "label")}
                found = list(best_in_block(*block, asked["vec_id"], asked["label"], asked["hi"], asked["lo"], matrix(part["v"]), k, same))
                if found:
                    who = np.repeat([i for i, _, _ in found], [len(f) for _, f, _ in found])
                    places, scores = np.concatenate([f for _, f, _ in found]), np.concatenate([x for _, _, x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(asked["at"][who]), pa.array(asked["hi"][who]), pa.array(block[0][places]), pa.array(scores)], names=["at", "hi", "found_id", "score"])

    return released(run)


class KeyedVectors:
    """Rows stored in order of (pivot, key): at (the row's number), block, vec_id, label, v; and the directory of blocks."""

    def __init__(self, rows: DataFrame, work: Workspace, block_rows: int | None = None):
        """rows: vec_id, label, v (whole numbers), each once."""
        self.work, spark = work, rows.sparkSession
        rows = work.save(rows, "rows")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("most"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
        n, width, most = size["n"], max(1, size["width"] or 0), float(size["most"] or 0.0)
        bits = max(int(size["high"] or 0), -int(size["low"] or 0) - 1).bit_length() + 1
        kind = next(name for name, m in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)) if bits <= m)
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).cast(f"array<{kind}>"))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).select("v").collect()
        sample = np.array([r["v"] for r in sample], np.float64).reshape(-1, width)
        pivots = fit_pivots(sample, most, min(PIVOTS, max(1, n // ROWS_PER_PIVOT))) if n else np.zeros((1, width + 1))
        keyed = rows.mapInArrow(_keyed(pivots, most), f"pivot int, key double, vec_id long, label long, v array<{kind}>")
        keyed = ordinal(keyed, ["pivot", "key", "vec_id", "label"], "at")
        first = keyed.groupBy("pivot").agg(F.min("at").alias("first"))  # PIVOTS rows at most
        block_rows = block_rows or max(BLOCK, -(-n // (MAX_BLOCKS - PIVOTS)))
        block = F.col("pivot").cast("long") * (1 << 40) + F.floor((F.col("at") - F.col("first")) / block_rows)
        self.rows = work.save(keyed.join(F.broadcast(first), "pivot").select(block.alias("block"), "pivot", "key", "at", "vec_id", "label", "v"), "blocks")
        ends = self.rows.groupBy("block", "pivot").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # MAX_BLOCKS rows at most
        self.n, self.blocks = n, len(ends)
        self.held = spark.sparkContext.broadcast(Directory(sorted(ends), pivots, most).parts())

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """at, hi, rank, found_id, score: for each query (at, hi, lo, need, vec_id, label, v) its k best rows with a score from lo to hi.

        same: rows of the query's label and another id; otherwise rows of other labels. need: how
        many rows it can find at most, if that is below k; with so many it is done.
        """
        work = self.work
        queries = work.save(queries, "queries")
        chunks = max(1, -(-queries.count() // QUERIES))
        order = Window.partitionBy("at", "hi").orderBy(F.desc("score"), "found_id")
        shape = "at long, hi long, found_id long, score long"
        kind = self.rows.schema["v"].dataType.simpleString()
        best, start, end = self.rows.sparkSession.createDataFrame([], f"{shape}, rank int"), 0, FIRST_ROUND
        while start < self.blocks:
            reached = best.groupBy("at", "hi").agg(F.count("*").alias("have"), F.min("score").alias("kth"))
            state = queries.join(reached, ["at", "hi"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
            state = state.filter((F.col("have") < F.col("need")) | (F.col("need") >= k))
            state = state.withColumn("least", F.when(F.col("have") >= k, F.greatest("lo", "kth")).otherwise(F.col("lo")))
            asked = state.select("at", "hi", "lo", "least", "vec_id", "label", "v").mapInArrow(_ask(self.held, start, end, chunks), f"block long, chunk long, at long, hi long, lo long, vec_id long, label long, v {kind}")
            asked = work.save(asked, "asked")
            there = asked.select("block", "chunk").distinct()
            if start and asked.isEmpty():  # bounds only rise, and so do those of what is left
                break
            rows = self.rows.join(F.broadcast(there) if self.blocks * chunks <= MAX_BLOCKS else there, "block")
            none = F.lit(0).cast("long")
            rows = rows.select("block", "chunk", F.lit(False).alias("asked"), none.alias("at"), none.alias("hi"), none.alias("lo"), "vec_id", "label", "v")
            dealt = rows.unionByName(asked.select("block", "chunk", F.lit(True).alias("asked"), "at", "hi", "lo", "vec_id", "label", "v"))
            dealt = dealt.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asked")
            found = dealt.mapInArrow(_scan(k, same), shape).unionByName(best.select("at", "hi", "found_id", "score"))
            before, best = best, work.save(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
            work.drop(asked, before)
            start, end = end, end * GROWTH
        return best


def hard_negatives(
    vectors: DataFrame, anchors: Column, k_positive: int = 5, k_negative: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * component)s. anchors marks the rows that are
    anchors. An anchor's positives are the k_positive best rows of its label and another id (all, if
    fewer); its negatives for a positive are the k_negative best rows of other labels with a score
    from percent / 100 of the positive's up to the positive's. Higher scores come first, equal
    ones by smaller id. Rows with a null id, a null label, a null vector, or a null or non-finite
    component take no part; shorter vectors count as padded with zeros; rows that agree in id, label
    and vector count once, an id with several labels or vectors is several rows. A positive without
    a negative has no row in the result, nor has one with a score below 0, where percent / 100 of
    it lies above it. Other columns are not read unless anchors does. An empty table gives an empty
    result. Components or scores beyond 64 bits raise an error.
    """
    work = Workspace(vectors.sparkSession, "negatives")
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole_numbers(v, scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = rows.groupBy("vec_id", "label", "v").agg(F.max("asked").alias("asked"))
    rows = work.save(rows, "distinct")
    stored = KeyedVectors(rows.select("vec_id", "label", "v"), work, block_rows)

    asked = rows.filter("asked").select("vec_id", "label").distinct()
    alike = stored.rows.groupBy("label").agg(F.count("*").alias("alike"))
    bounds = F.lit(HIGHEST).alias("hi"), F.lit(LOWEST).alias("lo"), F.least(F.col("alike") - 1, F.lit(k_positive)).cast("int").alias("need")
    queries = stored.rows.join(asked, ["vec_id", "label"], "left_semi").join(alike, "label").select("at", *bounds, "vec_id", "label", "v")
    queries = work.save(queries, "anchors")
    positives = stored.search(queries, k_positive, same=True).select("at", F.col("found_id").alias("positive_id"), F.col("score").alias("hi"))
    positives = work.save(positives.filter("hi >= 0"), "positives")

    part = F.lit(percent).cast("long")
    lo = part * F.expr("hi div 100") + F.floor((part * F.expr("hi % 100") + 99) / 100).cast("long")
    wanted = positives.select("at", "hi", lo.alias("lo")).distinct().join(queries.select("at", "vec_id", "label", "v"), "at")
    negatives = stored.search(wanted.withColumn("need", F.lit(k_negative)).select("at", "hi", "lo", "need", "vec_id", "label", "v"), k_negative, same=False)
    out = positives.join(negatives, ["at", "hi"]).join(queries.select("at", "vec_id"), "at")
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"))
