"""Mixing sources to target weights by blocks.

The words of a source, document after document in a pseudorandom order, are cut into blocks of a
fixed length. A source has as many slots as meet its target; multinomial draws deal them out over the
output shards, run by run, so that a source's total is fixed and its count in each shard is drawn. A
source's slots are numbered through the shards, and slot j takes block permutation(j): a Feistel
network that walks its cycle until it is below the number of blocks, with other keys in each pass
over the source. Blocks and slots are joined by index, which spreads a hot source like any other.

Sources are a table like any other: their order, the water level of the targets, the slots and the
draws are made by tasks, whose number grows with the slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ordinal
from .common import Workspace, join_hot, known_id, shown_id, unused, with_bases
from .kernels import mix64, released, signed, text_buffers, words

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are ordered together, some, to give documents their places.
ORDERED = 1000
#: A source has so many blocks at least, if it has so many words: smaller ones have shorter blocks, to come near their targets.
LEAST_BLOCKS = 100
#: Slots of a shard, on average; of a run, whose draw is made at once; and of a task, some.
SHARD_SLOTS, RUN_SLOTS, TASK_SLOTS = 1024, 4096, 100_000


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """The target of weight 1 where targets are unit * weight, but cap * size at most, and share `share` of all sizes.

    sources: size, weight. Each round adds up what is at its cap; the level rises until no more are.
    """
    some = sources.filter("size > 0")
    total, full, unit = None, -1, 0.0
    while True:
        at_cap = F.lit(unit) * F.col("weight") > F.lit(cap) * F.col("size")
        r = some.agg(F.sum("size").alias("all"), F.count_if(at_cap).alias("full"), F.sum(F.when(at_cap, F.col("size")).otherwise(0)).alias("capped"), F.sum(F.when(~at_cap, F.col("weight"))).alias("free")).first()
        total = share * (r["all"] or 0) if total is None else total
        if not r["free"] or r["full"] == full:
            return unit
        full, unit = r["full"], (total - cap * (r["capped"] or 0)) / r["free"]


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources (none, source, size) in order of code point, null last, with src, weight and target."""
    ranked = ordinal(sources, ["none", "source"], "src")
    each = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(each, (F.col("src") % len(weights) + 1).cast("int")))
    unit = water_level(ranked, share, cap) if share < cap else float("inf")
    return ranked.withColumn("target", F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(unit) * F.col("weight"), F.lit(cap) * F.col("size"))))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = np.array(index, np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw(n: int, n_shards: int, key: tuple[int, ...]) -> np.ndarray:
    """The shards of n slots in order: a multinomial draw of their counts over shards of equal share."""
    return np.sort(np.random.default_rng(key).integers(0, n_shards, n))


def _slots(n_shards: int, seed: int):
    def run(batches):
        for batch in batches:
            for src, run_no, n, n_blocks in zip(*(batch.column(c).to_pylist() for c in ("src", "run", "n", "n_blocks"))):
                slot = np.arange(run_no * RUN_SLOTS, run_no * RUN_SLOTS + n)
                block = np.zeros(n, np.int64)
                for turn in np.unique(slot // n_blocks):
                    at = slot // n_blocks == turn
                    block[at] = permuted(slot[at] % n_blocks, n_blocks, (seed * 1000 + src) * 1000 + int(turn))
                order = mix64(slot.astype(np.uint64) + np.uint64((src + 1) * 0x9E3779B97F4A7C15 % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(draw(n, n_shards, (seed, src, run_no))), pa.array(signed(order)), pa.array(np.full(n, src, np.int64)), pa.array(block)], names=["shard", "slot_order", "src", "block"])

    return released(run)


class Mixture:
    """placed: doc_id, tie, src, size, start, source_size, target, block_words. sources: a row for each.
    taken: a row for each document's part of each slot: shard, slot_order, src, block, doc_id, tie,
    start, first_word, n_words."""

    def __init__(self, placed: DataFrame, sources: DataFrame, taken: DataFrame):
        self.placed, self.sources, self.taken = placed, sources, taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 128, seed: int = 17) -> Mixture:
    """Draw a mixture of docs (doc_id, text, source) by targets that share `share` of all sizes.

    Sources are ordered by code point, null last; they weigh `weights`, repeating, and none gets more
    than cap times its size. A document's size is its number of words [^\\x20\\x09-\\x0D]+; null and
    empty texts have size 0 and are never taken. No word is taken more than floor(cap) times. A
    source's blocks have block_words words, or a hundredth of its size if that is less; its total
    differs from its target by half a block, and by what its last, shorter block misses. Reruns
    agree. Null ids sort first; repeated rows are rows of their own. Other columns of docs are not
    read. Of an empty table the mixture is empty.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    rows = docs.select(known_id("doc_id").alias("doc_id"), F.xxhash64(text).alias("tie"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = work.save(rows, "sizes")
    sources = work.save(rows.groupBy("none", "source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "totals")
    sources = targets(sources, weights, share, cap).withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("size") / LEAST_BLOCKS))).cast("long"))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("size") / F.col("block_words")))
    slots = F.least(F.lit(int(cap)) * F.col("n_blocks"), F.round(F.col("target") * F.col("n_blocks") / F.col("size")).cast("long"))
    sources = sources.withColumn("slots", F.when(F.col("size") > 0, slots).otherwise(0))
    sources = work.save(sources.select("none", "source", "src", "n", F.col("size").alias("source_size"), "target", "block_words", "n_blocks", "slots"), "sources")

    named = join_hot(rows, sources.drop("n_blocks", "slots"), ["none", "source"], counted="n")
    named = named.withColumn("turn", F.xxhash64("doc_id", "tie", F.lit(seed))).withColumn("chunk", F.pmod("turn", F.ceil(F.col("n") / ORDERED)))
    in_chunk = Window.partitionBy("src", "chunk").orderBy("turn", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    chunks = with_bases(work.save(named.groupBy("src", "chunk").agg(F.sum("size").alias("words")), "chunks"), ["src"], "chunk", "words")
    placed = named.withColumn("start", F.sum("size").over(in_chunk) - F.col("size")).join(chunks.select("src", "chunk", "base"), ["src", "chunk"])
    placed = work.save(placed.select("doc_id", "tie", "src", "size", (F.col("start") + F.col("base")).alias("start"), "source_size", "target", "block_words"), "places")

    total = sources.agg(F.sum("slots")).first()[0] or 0
    n_shards, n_tasks = max(1, -(-total // SHARD_SLOTS)), max(1, -(-total // TASK_SLOTS))
    many = 1000 * RUN_SLOTS  # in two steps, so that no row holds all runs of a source
    runs = sources.filter("slots > 0").select("src", "n_blocks", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / many))).alias("part")).repartition(n_tasks, "src", "part")
    first, left = F.col("part") * 1000, F.col("slots") - F.col("part") * many
    runs = runs.select("src", "n_blocks", "slots", F.explode(F.sequence(first, first + F.floor((F.least(left, F.lit(many)) - 1) / RUN_SLOTS))).alias("run"))
    runs = runs.select("src", "run", F.least(F.lit(RUN_SLOTS), F.col("slots") - F.col("run") * RUN_SLOTS).alias("n"), "n_blocks").repartition(n_tasks, "src", "run")
    drawn = runs.mapInArrow(_slots(n_shards, seed), "shard long, slot_order long, src long, block long")

    block = F.col("block_words")
    low, end = F.col("block") * block, F.col("start") + F.col("size")
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    parts = parts.withColumn("first_word", F.greatest(low, "start") - F.col("start")).withColumn("n_words", F.least(low + block, end) - F.greatest(low, "start"))
    # The planner takes slots for as few as the sources that they come from, and would broadcast them.
    taken = drawn.hint("merge").join(parts.select("src", "block", "doc_id", "tie", "start", "first_word", "n_words"), ["src", "block"])
    return Mixture(placed, sources, taken)


def mixing_digest(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mixture takes, repeats counted)."""
    key = ["src", "start", "doc_id", "tie"]
    took = mixture.taken.groupBy(*key).agg(F.sum("n_words").alias("words"))
    shown = ["doc_id", "size", "source_size", "target"]
    held = mixture.placed.filter("size > 0").join(took, key, "left").select(*shown, F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
    out = held.unionByName(mixture.placed.filter("size = 0").select(*shown, F.lit(0).cast("long").alias("taken")))
    return out.withColumn("doc_id", shown_id(F.col("doc_id")))


def _texts(parts_name: str):
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            pick, out, places = [], [], []
            for i, parts in enumerate(batch.column(parts_name)):
                raw = data[off[i] : off[i + 1]]
                start, end, _ = words(raw, np.array([0, len(raw)]))
                body = raw.tobytes()
                for p in parts.as_py():
                    lo, hi = p["first_word"], p["first_word"] + p["n_words"]
                    a, b = 0 if lo == 0 else start[lo], len(raw) if hi == len(start) else end[hi - 1]
                    pick.append(i)
                    out.append(body[a:b].decode())
                    places.append((p["shard"], p["slot_order"], p["start"], lo))
            if out:
                names = [c for c in batch.schema.names if c not in ("text", parts_name)]
                own = [pa.array(c, pa.int64()) for c in zip(*places)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(pick)) for c in names), pa.array(out, pa.string()), *own], names=[*names, "text", *("shard", "slot_order", "start", "first_word")])

    return released(run)


def mixed_documents(docs: DataFrame, mixture: Mixture, places: bool = False) -> DataFrame:
    """The texts that the mixture takes, with the columns of docs; a document taken twice comes twice.

    Rows come shard after shard, a shard's within one partition, in the order of its slots. places
    adds shard, place (which orders a shard's blocks) and first_word (of the part in its document),
    an underscore behind a name that docs has. A block's part of a document keeps the white space
    between its words; a document that lies within one block is whole. n_chars, if there, is the
    length of the part.
    """
    taken = F.struct("shard", "slot_order", "start", "first_word", "n_words")
    names = docs.columns
    id_name, tie_name, parts_name = (unused(n, names) for n in ("id", "tie", "parts"))
    parts = mixture.taken.groupBy("doc_id", "tie", "start").agg(F.collect_list(taken).alias(parts_name))  # a document's size bounds them
    parts = parts.select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name), parts_name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("text", text).withColumn(id_name, known_id("doc_id")).withColumn(tie_name, F.xxhash64("text"))
    if not mixture.placed.groupBy("doc_id", "tie").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([id_name, tie_name])  # each repeated row has parts of its own
    others = [c for c in names if c != "text"]
    shown = [f"`{c}`" for c in others]
    joined = rows.join(parts, [id_name, tie_name]).select(*(F.col(c) for c in shown), "text", parts_name)
    own = ["shard", "slot_order", "start", "first_word"]
    plain = [f"c{i}" for i in range(len(others))]  # names that can't clash with the operator's own
    fields = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, others))
    out = joined.toDF(*plain, "text", parts_name).mapInArrow(_texts(parts_name), f"{fields}, text string, {', '.join(f'{c} long' for c in own)}")
    out = out.repartition("shard").sortWithinPartitions("shard", "slot_order", "start")
    where = dict(zip(others, plain))
    cols = [F.col("text") if c == "text" else F.col(where[c]) for c in names]
    cols = [F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else x for c, x in zip(names, cols)]
    cols = [x.alias(c) for c, x in zip(names, cols)]
    if places:
        cols += [F.col(c).alias(unused(n, names)) for c, n in (("shard", "shard"), ("slot_order", "place"), ("first_word", "first_word"))]
    return out.select(*cols)
