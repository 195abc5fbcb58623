"""Best-fit packing of token sequences by linear grouping.

Only counts by length reach the driver, 2048 numbers at most. Large lengths are put in groups of
equal cardinality and rounded up to the largest of their group; the few sizes that remain are packed
by configurations, whose linear program is solved by column generation and rounded down. Actual
lengths then take the places of the rounded ones, and what is left over and all small pieces go
best-fit, longest first, into the gaps. The plan is run-length encoded, so its size depends on the
number of lengths, not of pieces. Pieces find their place by their rank among those of their length,
and ranks are counted in chunks, so that a length which a third of the pieces share is spread.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, known_id, shown_id, with_bases
from .kernels import cached, released

CAPACITY = 2048
#: Groups of large lengths, and the least large length as a part of the capacity, that are tried in turn.
SHAPES = ((64, 1 / 2), (64, 1 / 4), (128, 1 / 4), (128, 1 / 6))
#: Pieces of one length that are ranked together, some.
RANKED = 250


def byte_of() -> dict[str, int]:
    """The byte that each character stands for in the vocabulary of a byte-level tokenizer."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


#: What the faster library does, in the terms of a `tokenizers` file: a file that says anything else is left to `tokenizers`.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Fixed value: the pattern that `use_regex` stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(path: str):
    """A byte-level BPE vocabulary file of `tokenizers` for a faster library; None if its settings are other than that can do."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    same = spec["normalizer"] is None and all((spec["pre_tokenizer"] or {}).get(k) == v for k, v in SPLIT.items())
    same &= all(spec["model"].get(k) == v for k, v in MODEL.items()) and all(t.get(k) == v for t in spec["added_tokens"] for k, v in plain.items())
    if not same:
        return None
    letters, added = byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encoder(path: str):
    """Texts to token ids as `tokenizers` gives them, without special tokens added.

    The faster library gives the same ids, but its pattern can't backtrack over a million white
    spaces or so: what it refuses, and all texts of a file that it can't read, goes to `tokenizers`.
    """
    fast = load_encoding(path)

    def exact():
        from tokenizers import Tokenizer

        return cached(("tokenizer", path), lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if fast is not None:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                pass
        return exact().encode(text, add_special_tokens=False).ids

    return encode


def piece_starts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n tokens: all full, but for the first."""
    first = n % capacity
    return [0, *range(first, n, capacity)] if first and n > capacity else list(range(0, n, capacity))


def _tokenise(path: str, capacity: int):
    def run(batches):
        encode = cached(("encoder", path), lambda: encoder(path))
        for batch in batches:
            rows = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                ids = np.array([*encode(text or ""), 0], "<u4")
                starts = piece_starts(len(ids), capacity)
                for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc, i, s, e - s, zlib.crc32(ids[s:e].tobytes()), row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return released(run)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits: an unbounded knapsack, one more item a round."""
    value, choice = np.zeros(capacity + 1), []
    while len(choice) < capacity // int(sizes.min()):
        new, pick = value.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if worth[i] <= 0:
                continue
            better = value[: capacity + 1 - s] + worth[i] > new[s:] + 1e-12
            new[s:][better] = (value[: capacity + 1 - s] + worth[i])[better]
            pick[s:][better] = i
        choice.append(pick)
        if (pick < 0).all():
            break
        value = new
    made, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(choice):
        if pick[room] >= 0:
            made[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(value[capacity]), made


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, at most: the linear program, rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.float64)
    use = counts / np.diag(columns)
    for _ in range(40 * k):
        worth = np.linalg.solve(columns.T, np.ones(k))
        value, made = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, made.astype(np.float64))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        columns[:, out] = made
    return [(columns[:, i].astype(np.int64), int(use[i] + 1e-7)) for i in range(k) if use[i] + 1e-7 >= 1]


class Bins:
    """Classes of bins with the same content, by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, n: int, content: tuple) -> None:
        """content: (length, how many) runs."""
        if n:
            self.by_room[self.capacity - sum(length * m for length, m in content)].append((n, content))

    def best_fit(self, length: int, count: int) -> None:
        """Each of count pieces into the fullest bin that has room for it."""
        for room in range(length, self.capacity + 1):
            while count and self.by_room[room]:
                n, content = self.by_room[room].pop()
                each = room // length
                full = min(n, count // each)
                self.add(full, (*content, (length, each)))
                count -= full * each
                rest = n - full
                if rest and count:
                    self.add(1, (*content, (length, count)))
                    rest, count = rest - 1, 0
                if rest:
                    self.by_room[room].append((rest, content))
            if not count:
                return
        each = self.capacity // length
        self.add(count // each, ((length, each),))
        if count % each:
            self.add(1, ((length, count % each),))

    def classes(self) -> list[tuple[int, tuple]]:
        return [c for room in sorted(self.by_room) for c in self.by_room[room]]


def plan(counts: dict[int, int], capacity: int, n_groups: int, least: float) -> list[tuple[int, tuple]]:
    """Classes (number of bins, their (length, how many) runs) that hold counts[length] pieces."""
    bins = Bins(capacity)
    left = dict(counts)
    bins.add(left.pop(capacity, 0), ((capacity, 1),))
    large = sorted((n for n in left if n > least * capacity), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        groups: list[list[list[int]]] = []  # per group its (length, count) runs, longest first
        per = -(-total // n_groups)
        room = 0
        for n in large:
            count = left.pop(n)
            while count:
                if not room:
                    groups.append([])
                    room = per
                take = min(room, count)
                groups[-1].append([n, take])
                room, count = room - take, count - take
        sizes: dict[int, list[list[int]]] = {}
        for g in groups:
            sizes.setdefault(g[0][0], []).extend(g)  # groups of one rounded size are one
        size = np.array(sorted(sizes))
        runs = [sizes[s][::-1] for s in size]  # taken from the end: longest first
        number = np.array([sum(c for _, c in r) for r in runs])
        for made, times in configurations(size, number, capacity):
            slots = [i for i in np.flatnonzero(made) for _ in range(made[i])]
            while times > 0:
                need, n = {i: int(made[i]) for i in set(slots)}, times
                for i, m in need.items():
                    if not runs[i]:
                        n = 0
                        break
                    n = min(n, runs[i][-1][1] // m if runs[i][-1][1] >= m else 0)
                if n:
                    content = tuple((runs[i][-1][0], m) for i, m in need.items())
                    for i, m in need.items():
                        runs[i][-1][1] -= n * m
                        if not runs[i][-1][1]:
                            runs[i].pop()
                    bins.add(n, content)
                    times -= n
                    continue
                content: dict[int, int] = defaultdict(int)  # one bin across the ends of runs
                for i, m in need.items():
                    while m and runs[i]:
                        take = min(m, runs[i][-1][1])
                        content[runs[i][-1][0]] += take
                        runs[i][-1][1] -= take
                        m -= take
                        if not runs[i][-1][1]:
                            runs[i].pop()
                if not content:
                    break
                bins.add(1, tuple(content.items()))
                times -= 1
        for r in runs:
            for n, count in r:
                left[n] = left.get(n, 0) + count
    for n in sorted(left, reverse=True):
        if left[n]:
            bins.best_fit(n, left[n])
    return bins.classes()


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """The plan with the fewest bins of those tried; one that fills its bins as far as can be ends the search."""
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for shape in SHAPES:
        found = plan(counts, capacity, *shape)
        bins = sum(n for n, _ in found)
        if best is None or bins < best[0]:
            best = bins, found
        if bins == least:
            break
    return best[1]


def slots(classes: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): ranks from the first on go to sequences from the first on."""
    used, out, sequence = defaultdict(int), [], 0
    for n, content in classes:
        offset = 0
        for length, m in content:
            for _ in range(m):
                out.append((length, used[length], sequence, offset))
                used[length] += n
                offset += length
        sequence += n
    return sorted(out)


def _place(table):
    def run(batches):
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(rows[at, 3]), batch.column("row")], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row"])

    return released(run)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row.

    A document is its token ids and then id 0. Only one longer than the capacity is cut, into full
    pieces; its first one may be shorter. Null and empty texts are the one token 0. Null ids stay
    null; repeated rows are documents of their own: row numbers the rows of docs (in no order), so
    row and piece name a piece where ids repeat. Other columns of docs are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(known_id("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    pieces = work.save(texts.mapInArrow(_tokenise(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, row long"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    rows = np.array(slots(best_plan(counts, capacity)) if counts else np.zeros((0, 4)), np.int64).reshape(-1, 4)
    chunks = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "length long, chunks long")
    turn = F.xxhash64("row", "piece")
    dealt = pieces.join(F.broadcast(chunks), "length").withColumn("turn", turn).withColumn("chunk", F.pmod("turn", "chunks"))
    sizes = with_bases(dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")), ["length"], "chunk", "n")
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("turn", "row", "piece")) - 1
    ranked = dealt.withColumn("within", within).join(sizes.select("length", "chunk", "base"), ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "row", (F.col("base") + F.col("within")).alias("rank"))
    out = ranked.mapInArrow(_place(spark.sparkContext.broadcast(rows)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row long")
    return out.withColumn("doc_id", shown_id(F.col("doc_id")))
