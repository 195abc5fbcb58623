"""Phrase collocations: frequent word n-grams of each language, counted exactly and scored by their weakest cut.

Words that are frequent in a language get dense ids, and everything else breaks a piece, so a text is
a list of ids with zeros between its runs. An n-gram is a key of n ids in 16 bytes. Tasks sort and
run-length count the keys of some million places before anything is shuffled; keys are then dealt
out, as lists, by ranges, drawn from a sample of places, and sorted by radix and run-length counted in their
range. Longer n-grams are counted only where both n-grams within, one word shorter, can be frequent:
a bitmap of those, of bounded size, is looked up, and what it lets through wrongly is counted
exactly as well and falls to the same threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ordinal
from .common import Workspace, join_hot
from .kernels import fixed_binary, mix64, released, slices, text_buffers

#: Longest phrase in words; occurrences of a phrase; share of a longer phrase that drops a phrase, in percent; phrases of a language.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Words whose ids a task holds at once, at some 150 bytes each; a larger dictionary is applied in blocks.
MAX_WORDS = 300_000
#: A task passes on its counts of words when it has twice as many distinct ones.
COUNTED = 200_000
#: Places whose n-grams are counted together, and keys of a range, some.
PLACES, RANGE = 1 << 20, 1 << 19
#: Ids of a stored row: a Parquet page is measured after 100 rows at the earliest, and its reader holds 4096 rows at once.
ROW_IDS = 1 << 12
#: Rows of a batch that a task passes on: the JVM holds a batch as a whole, outside its heap.
PASSED = 1 << 16
#: Ranges at most.
MOST_RANGES = 20_000
#: Rows of ids that split points are drawn from, at most, and n-grams of each.
SAMPLED_ROWS, SAMPLED_KEYS = 256, 512
#: Bits of the bitmap: at most 32 MB, however many n-grams are frequent.
LEAST_BITS, MOST_BITS = 16, 28
#: A piece ends here, and between words stands what bytes.split() takes as white space once pieces are marked.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + MARK * len(ENDS))


def tokens(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09]+ in order, A-Z as small letters, with MARK (which is in no UTF-8) where a piece ends."""
    return raw.translate(TABLE).replace(MARK, b" \xff ").split()


def _texts(batch):
    """(number of the language's row, bytes) of each text of a batch, in slices."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in slices(offsets):
        for d in range(i, j):
            yield d, data[offsets[d] : offsets[d + 1]].tobytes()


def word_array(texts: list[bytes]) -> pa.DictionaryArray:
    """The tokens() of texts one after another, with MARK behind each text."""
    raw = b"".join(x for t in texts for x in (t, MARK)).translate(TABLE).replace(MARK, b" \xff ")
    data = np.frombuffer(raw, np.uint8)
    inner = (data != 32) & (data != 9)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]])))
    ends = np.concatenate([[0], np.cumsum(edge[1::2] - edge[::2])])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inner])])
    return words.dictionary_encode()


def _by_language(batch):
    """For each slice of a batch's texts: the first one's number, and numbers and bytes of the texts of each language."""
    langs = batch.column("lang").to_pylist()
    data, offsets = text_buffers(batch.column("text"))
    for i, j in slices(offsets):
        found: dict[str, list] = {}
        for d in range(i, j):
            found.setdefault(langs[d], []).append((d, data[offsets[d] : offsets[d + 1]].tobytes()))
        yield i, found


def _count_words(batches):
    held: dict[str, list] = {}
    size = 0

    def merge():
        for lang, parts in held.items():
            words = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
            f = np.bincount(words.indices.to_numpy(), np.concatenate([f for _, f in parts]), len(words.dictionary))  # exact below 2**53
            held[lang] = [(words.dictionary, f.astype(np.int64))]
        return sum(len(w) for [(w, _)] in held.values())

    def out():
        for lang, [(words, f)] in held.items():
            words, f = words.filter(there := pc.not_equal(words, pa.scalar(MARK, pa.large_binary()))), f[there.to_numpy(zero_copy_only=False)]
            for lo in range(0, len(f), PASSED):
                some = words[lo : lo + PASSED].cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(f[lo : lo + PASSED])], names=["lang", "word", "f"])
        held.clear()

    for batch in batches:
        for _, found in _by_language(batch):
            for lang, texts in found.items():
                words = word_array([raw for _, raw in texts])
                held.setdefault(lang, []).append((words.dictionary, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
                size += len(words.dictionary)
            if size >= 5 * COUNTED:
                size = merge()
                if size >= 2 * COUNTED:
                    yield from out()
                    size = 0
    if held:
        merge()
        yield from out()


class Ids(dict):
    def __missing__(self, word):
        return 0


def _by_lang(held) -> dict[str, Ids]:
    out: dict[str, Ids] = {}
    for lang, word, n in zip(*(held.value.column(c).to_pylist() for c in ("lang", "word", "id"))):
        out.setdefault(lang, Ids())[word] = n
    return out


def _unknown(held):
    """at, lang, word: each text's distinct words that the dictionary lacks."""

    def run(batches):
        by_lang = _by_lang(held)
        for batch in batches:
            at, langs = batch.column("at").to_pylist(), batch.column("lang").to_pylist()
            for d, raw in _texts(batch):
                new = [w.decode() for w in set(tokens(raw)).difference(by_lang.get(langs[d], ()), (MARK,))]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([at[d]] * len(new), pa.int64()), pa.array([langs[d]] * len(new), pa.string()), pa.array(new, pa.string())], names=["at", "lang", "word"])

    return released(run)


def _encode(held):
    """Ids of the words of the texts, with 0 for a word without id, a piece's end and a text's end.

    A slice of texts is cut into rows of ROW_IDS ids, n of them a row's own; the first ones of the
    row behind follow, so that each n-gram lies within the row in which it starts. at and part name a row.
    """

    def run(batches):
        by_lang, none = _by_lang(held), Ids()
        for batch in batches:
            at = batch.column("at").to_pylist()
            more = batch.column("more") if "more" in batch.schema.names else None
            for i, by in _by_language(batch):
                parts = []
                for lang, texts in by.items():
                    known, plain = by_lang.get(lang, none), []
                    for d, raw in texts:
                        if more is None or not more[d].is_valid:
                            plain.append(raw)
                            continue
                        found, rare = tokens(raw), Ids({x["word"].encode(): x["id"] for x in more[d].as_py()})
                        ids = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
                        parts += [np.maximum(ids, np.fromiter(map(rare.__getitem__, found), np.uint32, len(found))), np.zeros(1, np.uint32)]
                    if plain:
                        words = word_array(plain)
                        parts.append(np.fromiter(map(known.__getitem__, words.dictionary.to_pylist()), np.uint32, len(words.dictionary))[words.indices.to_numpy()])
                ids = np.concatenate(parts)
                cut = range(0, len(ids), ROW_IDS)
                rows = [ids[lo : lo + ROW_IDS + LONGEST - 1].tobytes() for lo in cut]
                own = [min(ROW_IDS, len(ids) - lo) for lo in cut]
                yield pa.RecordBatch.from_arrays([pa.array([at[i]] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(own, pa.int64()), pa.array(rows, pa.binary())], names=["at", "part", "n", "ids"])

    return released(run)


def joined(batch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows one after another, and whether each is its row's own.

    No n-gram of a row's own place runs into the next row: what follows is in the row, or a 0 ends its texts.
    """
    rows = batch.column("ids").cast(pa.large_binary())
    if not len(rows):
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    ids = np.frombuffer(data, np.uint32, (offsets[-1] - offsets[0]) // 4, offsets[0])
    first, own = (offsets[:-1] - offsets[0]) // 4, batch.column("n").to_numpy()
    return ids, np.arange(len(ids)) - np.repeat(first, np.diff(offsets) // 4) < np.repeat(own, np.diff(offsets) // 4)


def radix_order(key: np.ndarray) -> np.ndarray:
    """Order of rows of two unsigned 64-bit numbers: least significant digit first, 16 bits at a time, digits that never differ left out."""
    order = None
    for column in (1, 0):
        x = key[:, column]
        differs = int(np.bitwise_or.reduce(x ^ x[0])) if len(x) else 0
        for shift in range(0, 64, 16):
            if differs >> shift & 0xFFFF:
                digit = (x >> np.uint64(shift)).astype(np.uint16)
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(key)) if order is None else order


def run_lengths(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if count is None and not key[:, 1].any():
        first, sums = np.unique(key[:, 0], return_counts=True)
        return np.stack([first, np.zeros(len(first), np.uint64)], 1), sums.astype(np.int64)
    order = radix_order(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    sums = np.diff(np.append(start, len(key))) if count is None else np.add.reduceat(count[order], start)
    return key[start], sums.astype(np.int64)


def key_of(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that start at the places: ids of 32 bits from the highest on, zeros behind them."""
    key = np.zeros((len(at), 2), np.uint64)
    for k in range(n):
        key[:, k // 2] |= ids[at + k].astype(np.uint64) << np.uint64(32 * (1 - k % 2))
    return key


def packed(key: np.ndarray) -> pa.Array:
    """Keys as binary values of 16 bytes whose order is that of the numbers."""
    return fixed_binary(key.astype(">u8"))


def unpacked(column: pa.Array) -> np.ndarray:
    """The keys of packed()."""
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, ">u8", 2 * len(column), first).reshape(-1, 2).astype(np.uint64)


def bit_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(mix64(key[:, 0]) + key[:, 1]) >> np.uint64(64 - bits)).astype(np.int64)


def starts(ids: np.ndarray, own: np.ndarray, n: int, bitmap: tuple[int, bytes] | None) -> np.ndarray:
    """Own places of ids where an n-gram starts that has no zero and, with a bitmap of (n - 1)-grams, whose two are in it."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    fine = own[: len(ids) - n + 1].copy()
    for k in range(n):
        fine &= ids[k : len(ids) - n + 1 + k] != 0
    at = np.flatnonzero(fine)
    if bitmap is not None and len(at):
        bits, held = bitmap
        table = np.frombuffer(held, np.uint8)
        for k in (0, 1):
            bit = bit_of(key_of(ids, at + k, n - 1), bits)
            at = at[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    return at


def _count(n: int, held, cuts: bytes):
    """Distinct n-grams of every PLACES places or so with their counts and the range they belong to. cuts: the ranges' ends, packed."""

    def out(parts):
        key = np.concatenate(parts)
        parts.clear()
        key, count = run_lengths(key)
        as_bytes = np.ascontiguousarray(key.astype(">u8")).view("S16").ravel()
        ends = np.searchsorted(as_bytes, np.frombuffer(cuts, "S16"))
        part = np.repeat(np.arange(len(ends) + 1), np.diff(np.concatenate([[0], ends, [len(key)]])))
        part = part.astype(np.int32)
        for lo in range(0, len(key), PASSED):
            yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + PASSED]), packed(key[lo : lo + PASSED]), pa.array(count[lo : lo + PASSED])], names=["part", "key", "f"])

    def run(batches):
        bitmap, parts, size = held.value, [], 0
        for batch in batches:
            ids, own = joined(batch)
            for lo in range(0, len(ids), PLACES // 4):
                hi = lo + PLACES // 4
                at = starts(ids[lo : hi + n - 1], own[lo:hi], n, bitmap)
                parts, size = [*parts, key_of(ids[lo : hi + n - 1], at, n)], size + len(at)
                if size >= PLACES:
                    yield from out(parts)
                    parts, size = [], 0
        if size:
            yield from out(parts)

    return released(run)


def _listed(count):
    """What count() gives, with one row for each batch's n-grams of a range, as the JVM takes longer over a row than over its bytes."""

    def run(batches):
        for batch in count(batches):
            part = batch.column("part").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends, key = np.append(start, len(part)), unpacked(batch.column("key")).astype(">u8")
            cut = lambda x, width: pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((width * ends).astype(np.int32)), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(part[start]), cut(key, 16), cut(batch.column("f").to_numpy(), 8)], names=["part", "keys", "counts"])

    return released(run)


def _sample(n: int, held):
    """Of each row of ids: its places, its n-grams, and some of their keys, evenly spread."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, own = joined(batch.slice(i, 1))
                at = starts(ids, own, n, held.value)
                key = key_of(ids, at[np.linspace(0, len(at) - 1, min(len(at), SAMPLED_KEYS)).astype(int)] if len(at) else at, n)
                yield pa.RecordBatch.from_arrays([pa.array([int(own.sum())]), pa.array([len(at)]), pa.array([key.astype(">u8").tobytes()], pa.binary())], names=["places", "found", "keys"])

    return released(run)


def _sum(least: int):
    """Keys of a range with the sums of their counts, those of at least `least`."""

    def run(batches):
        key, count, new, size = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            return run_lengths(np.concatenate([key, *(k for k, _ in new)]), np.concatenate([count, *(c for _, c in new)]))

        for batch in batches:
            new.append((np.frombuffer(b"".join(batch.column("keys").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64), np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)))
            size += len(new[-1][1])
            if size >= max(RANGE, len(key)):  # what has been merged is merged again only when as much is new
                (key, count), new, size = merged(), [], 0
        key, count = merged()
        for lo in range(0, len(key), PASSED):
            fine = np.flatnonzero(count[lo : lo + PASSED] >= least) + lo
            if len(fine):
                yield pa.RecordBatch.from_arrays([packed(key[fine]), pa.array(count[fine])], names=["key", "f"])

    return released(run)


def _bit_numbers(bits: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_of(unpacked(batch.column("key")), bits) + 1)], names=["bit"])

    return run


def bitmap_of(keys: DataFrame, n: int) -> tuple[int, bytes]:
    """A bitmap with the bits of all n keys: its number of bits, a power of two of MOST_BITS at most, and its bytes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))
    numbers = keys.select("key").mapInArrow(_bit_numbers(bits), "bit long")
    parts = numbers.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for row in parts.collect():  # 4096 bytes each, 2**MOST_BITS bits at most
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return bits, out.tobytes()


def frequent_ngrams(ids: DataFrame, n: int, least: int, bitmap: tuple[int, bytes] | None, work: Workspace) -> DataFrame:
    """key, f: the n-grams of ids with at least `least` occurrences, stored."""
    spark = ids.sparkSession
    held = spark.sparkContext.broadcast(bitmap)
    row = F.xxhash64("at", "part")
    rows = [r["row"] for r in ids.select(row.alias("row")).orderBy("row").limit(SAMPLED_ROWS).collect()]
    sample = ids.filter(row.isin(rows)).select("n", "ids").mapInArrow(_sample(n, held), "places long, found long, keys binary").collect() if rows else []
    places, found = (sum(r[c] for r in sample) for c in ("places", "found"))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, total * found // max(1, places) // RANGE)))
    keys = np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in sample), "S16"))
    cuts = np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]]) if len(keys) else keys
    counted = ids.select("n", "ids").mapInArrow(_listed(_count(n, held, cuts.tobytes())), "part int, keys binary, counts binary")
    summed = counted.repartitionById(len(cuts) + 1, "part").select("keys", "counts").mapInArrow(_sum(least), "key binary, f long")
    return work.save(summed, f"ngrams-{n}")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words, at most 4.

    Words are [^\\x20\\x09]+ with A-Z small, within pieces that end at [.,;:!?\\x0A-\\x0D]; a null
    language is 'und', a null text empty. Everything is counted over all rows, repeated ones as often as they
    are there. n: the language's words. a: the phrase's occurrences, overlaps included, `least` at
    least. l and r: those of its two parts at the cut with the lowest score, floor(2,000,000 a / (l + r)); of
    equal ones the first. A phrase inside a longer one that has at least `covered` percent of its
    occurrences is left out. Order: score and a falling, phrase rising in UTF-8's byte order. Other
    columns of docs are not read. An empty table gives an empty result.
    """
    if not 2 <= longest <= 4:
        raise ValueError("a key holds 4 words")
    spark = docs.sparkSession
    work = Workspace(spark, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(released(_count_words), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = work.save(counts, "counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = ordinal(counts.filter(F.col("f") >= least), ["lang", "word"], "id")
    words = work.save(words.withColumn("id", F.col("id") + 1), "words")
    n_words = words.count()
    if n_words >= 1 << 32:
        raise ValueError("more frequent words than ids of 32 bits")

    # The most frequent words go to every task; the others, each a small share of all words, are joined.
    common = words if n_words <= max_words else words.orderBy(F.desc("f"), "id").limit(max_words)
    held = spark.sparkContext.broadcast(common.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow())
    texts = texts.withColumn("at", F.monotonically_increasing_id())
    if n_words > max_words:
        texts = work.save(texts, "texts")
        rare = texts.mapInArrow(_unknown(held), "at long, lang string, word string").join(words.select("lang", "word", "id"), ["lang", "word"])
        texts = texts.join(rare.groupBy("at").agg(F.collect_list(F.struct("word", "id")).alias("more")), "at", "left")
    ids = work.save(texts.mapInArrow(_encode(held), "at long, part int, n long, ids binary"), "ids")

    found, bitmap = [], None
    for n in range(2, longest + 1):
        found.append(frequent_ngrams(ids, n, least, bitmap, work))
        size = found[-1].count()
        if not size:
            break
        bitmap = bitmap_of(found[-1], size) if n < longest else None
    work.drop(ids)
    return _best(found, words, totals, covered, top, work)


def _part(start: int, n: int):
    """Words start to start + n (from 0) of a key, as a key."""
    return F.concat(F.substring("key", 4 * start + 1, 4 * n), F.lit(bytes(16 - 4 * n)))


def _best(found: list[DataFrame], words: DataFrame, totals: DataFrame, covered: int, top: int, work: Workspace) -> DataFrame:
    single = words.select(F.unhex(F.rpad(F.lpad(F.hex("id"), 8, "0"), 32, "0")).alias("key"), "f")
    wide = lambda c: c.cast("decimal(38,0)")
    all_counts, cuts, inner = single, None, None
    for n, df in enumerate(found, 2):
        all_counts = all_counts.unionByName(df)
        each = [F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, n - k).alias("right")) for k in range(1, n)]
        rows = df.select("key", F.lit(n).alias("words"), F.col("f").alias("a"), F.explode(F.array(*each)).alias("cut")).select("key", "words", "a", "cut.*")
        cuts = rows if cuts is None else cuts.unionByName(rows)
        if n > 2:
            subs = F.array(*(_part(s, m) for m in range(2, n) for s in range(n - m + 1)))
            rows = df.select(F.explode(subs).alias("key"), "f")
            inner = rows if inner is None else inner.unionByName(rows)
    all_counts, cuts = work.save(all_counts, "all"), work.save(cuts, "cuts")
    cuts = work.save(join_hot(cuts, all_counts.select(F.col("key").alias("left"), F.col("f").alias("l")), ["left"]), "left")
    cuts = join_hot(cuts, all_counts.select(F.col("key").alias("right"), F.col("f").alias("r")), ["right"])
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    rows = cuts.groupBy("key", "words", "a").agg(weakest).select("key", "words", "a", "cut.score", "cut.l", "cut.r")
    if inner is not None:
        longer = inner.groupBy("key").agg(F.max("f").alias("longer"))
        rows = rows.join(longer, "key", "left").filter(F.col("longer").isNull() | (100 * wide(F.col("longer")) < covered * wide(F.col("a")))).drop("longer")
    number = lambda i: F.conv(F.hex(F.substring("key", 4 * i + 1, 4)), 16, 10).cast("long")
    rows = work.save(rows.withColumn("id", number(0)), "scored")
    rows = join_hot(rows, words.select("id", "lang"), ["id"]).drop("id")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = work.save(rows.withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place"), "best")
    ids = F.array(*(number(i) for i in range(4)))
    spelled = rows.select("key", F.posexplode(F.slice(ids, F.lit(1), F.col("words"))).alias("i", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = rows.join(spelled, "key").join(totals, "lang")
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
