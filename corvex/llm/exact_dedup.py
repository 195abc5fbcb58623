"""Exact duplicates through an extendible-hash index on shared files.

The hash key of a text is the first 64 bits of the SHA-256 of its normalised form. A directory over
the leading bits of the key starts with one bucket; an overfull bucket is split by one more bit, and
the directory doubles whenever the bucket to split already uses all of its bits. The driver holds
the directory of the first MAX_DEPTH bits; a bucket that is overfull there has a perfect directory of
its own below, of as many more bits as its number of keys asks for, so splitting goes on at any size.
Each bucket is a range of keys with one owner task, which chains the entries of a key, comparing
their bytes. Input tasks first merge their own copies, so a text that fills a third of the table
reaches its owner as a few rows a task. The index (bucket files and directory) lies in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, anti_by_id, join_hot, known_id, shown_id, unused
from .kernels import LOWERED, UPPER, released, text_buffers

#: Distinct keys in a bucket before it splits.
CAPACITY = 4096
#: Bits of the driver's directory, at most: 2**18 entries of 5 bytes, which go to every task.
MAX_DEPTH = 18
#: Bytes of text that an input task merges before it passes them on.
MERGE_BYTES = 32 << 20


def _keys():
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            raw = data.tobytes().translate(LOWERED)
            digests = [hashlib.sha256(raw[s:e]).digest() for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], names=["doc_id", "sha"])

    return released(run)


def key_of(digest: bytes) -> int:
    """The hash key: the first 64 bits, signed, in the order of the unsigned value."""
    return int.from_bytes(digest[:8], "big") - 2**63


class Directory:
    """Entry i of slots names the bucket of the keys whose leading `depth` bits are i.

    below[b] is the number of further bits by which a bucket at the full depth is split; its parts
    are numbered in the upper half of a bucket's number.
    """

    def __init__(self):
        self.depth, self.slots, self.local, self.below = 0, np.zeros(1, np.int32), [0], np.zeros(1, np.int8)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        unsigned = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out = self.slots[(unsigned >> np.uint64(64 - self.depth)).astype(np.int64)].astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)
        more = self.below[out]
        if more.any():
            rest = unsigned << np.uint64(self.depth)
            part = np.where(more > 0, rest >> (64 - np.maximum(more, 1)).astype(np.uint64), np.uint64(0))
            out |= part.astype(np.int64) << 32
        return out

    def split(self, bucket: int) -> None:
        if self.local[bucket] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        mine = np.flatnonzero(self.slots == bucket)
        self.local[bucket] += 1
        self.slots[mine[len(mine) // 2 :]] = len(self.local)
        self.local.append(self.local[bucket])

    @classmethod
    def over(cls, counts: np.ndarray, capacity: int) -> "Directory":
        """counts: keys for each value of the leading bits, of a power of two of them."""
        out, bits, below = cls(), int(np.log2(len(counts))), {}
        sums = np.concatenate([[0], np.cumsum(counts)])
        todo = [(0, 0, len(counts))]
        while todo:
            bucket, lo, hi = todo.pop()
            keys = int(sums[hi] - sums[lo])
            if keys > capacity and out.local[bucket] < bits:
                out.split(bucket)
                mid = (lo + hi) // 2
                todo += [(bucket, lo, mid), (len(out.local) - 1, mid, hi)]
            elif keys > capacity:  # keys are hashes, so a part of 2**n has its 2**n-th of them
                below[bucket] = min(30, int(np.ceil(np.log2(keys / capacity))) + 1)
        out.below = np.zeros(len(out.local), np.int8)
        for bucket, more in below.items():
            out.below[bucket] = more
        return out


def _entries(directory: Directory):
    """Normalised texts with their bucket, copies within the task merged."""
    schema = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("sha", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])

    def flush(seen):
        for at in range(0, len(items := list(seen.items())), 500):
            part = items[at : at + 500]
            shas = [hashlib.sha256(t).digest() for t, _ in part]
            keys = np.array([key_of(s) for s in shas], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(directory.bucket(keys)), pa.array(keys), pa.array([t for t, _ in part], pa.binary()), pa.array(shas, pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], schema=schema)

    def run(batches):
        seen, size = {}, 0
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            raw = data.tobytes().translate(LOWERED)
            for doc, s, e in zip(batch.column("doc_id").to_pylist(), off[:-1], off[1:]):
                text = raw[s:e]
                if (had := seen.get(text)) is None:
                    seen[text], size = [doc, 1], size + len(text) + 100
                else:
                    had[0], had[1] = max(had[0], doc), had[1] + 1
            if size > MERGE_BYTES:
                yield from flush(seen)
                seen, size = {}, 0
        yield from flush(seen)

    return released(run)


def _own():
    """Chains of the keys of an owner's buckets; rows come ordered by key."""

    def out(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["bucket", "h", "chain", "sha", "keep_id", "group_size"])

    def run(batches):
        at, chain, ready = None, [], []
        for batch in batches:
            for bucket, h, text, sha, top, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "text", "sha", "top", "n"))):
                if (bucket, h) != at:
                    ready += [(*at, i, e[1], e[2], e[3]) for i, e in enumerate(chain)] if at else []
                    at, chain = (bucket, h), []
                for entry in chain:
                    if entry[0] == text:
                        entry[2], entry[3] = max(entry[2], top), entry[3] + n
                        break
                else:
                    chain.append([text, sha, top, n])
            if len(ready) > 5000:
                yield out(ready)
                ready = []
        ready += [(*at, i, e[1], e[2], e[3]) for i, e in enumerate(chain)] if at else []
        if ready:
            yield out(ready)

    return released(run)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the
    largest id stays. Null counts as the empty text, so null and empty texts form one group. A null
    id sorts before all others. Of repeated rows (same id and text) exactly one is marked kept. Other
    columns of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    texts = docs.select(known_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = work.save(texts.mapInArrow(_keys(), "doc_id long, sha binary"), "keys")
    total = rows.count()
    bits = min(max_depth, max(0, int(np.ceil(np.log2(max(1, total) / capacity))) + 2))  # of all rows, which no fewer keys can have
    counts = np.zeros(1 << bits, np.int64)
    lead = F.shiftright(F.conv(F.hex(F.substring("sha", 1, 3)), 16, 10).cast("int"), 24 - bits)
    for r in rows.select("sha").distinct().groupBy(lead.alias("lead")).count().collect():  # an entry of the directory each
        counts[r["lead"]] = r["count"]
    directory = Directory.over(counts, capacity)
    table = [(i, int(b), directory.depth, int(directory.local[b]), int(directory.below[b])) for i, b in enumerate(directory.slots)]
    work.save(spark.createDataFrame(table, "entry int, bucket int, depth int, local_depth int, below int"), "directory")
    entries = texts.mapInArrow(_entries(directory), "bucket long, h long, text binary, sha binary, top long, n long")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "h")
    index = work.save(owned.mapInArrow(_own(), "bucket long, h long, chain int, sha binary, keep_id long, group_size long"), "index")
    repeats = rows.groupBy("doc_id", "sha").agg(F.count("*").cast("int").alias("m"))
    out = join_hot(repeats, index.select("sha", "keep_id", "group_size"), ["sha"], counted="group_size", total=total).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), shown_id(F.col("keep_id")).alias("keep_id"), "group_size", ((F.col("doc_id") == F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, with all columns."""
    work = Workspace(docs.sparkSession, "exact")
    marked = exact_duplicates(docs).select(known_id("doc_id").alias("doc_id"), "kept", "text_sha256")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return anti_by_id(docs, "doc_id", marked.filter("not kept"), "doc_id", work)
    id_name, sha_name = (unused(n, docs.columns) for n in ("id", "sha"))
    upper = UPPER.decode()
    sha = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower()), 256)
    kept = marked.filter("kept").select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name))
    rows = docs.withColumn(id_name, known_id("doc_id")).withColumn(sha_name, sha).dropDuplicates([id_name, sha_name])
    return rows.join(kept, [id_name, sha_name], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
