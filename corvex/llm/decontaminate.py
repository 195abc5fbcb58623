"""Benchmark decontamination: token windows of documents are looked up in a broadcast hash set of the benchmark's n-grams.

Built-in functions only. A document's words are cut into chunks that overlap by a window, so a very
long text is many small rows; each chunk's windows are hashed, looked up and compared as strings with
the benchmark's window of that hash, in one stage and without a shuffle. Only hits, and one mark for
each document, go on: hits that overlap or touch become maximal spans, and benchmark items are kept
as sets of items that share a window, so that an item that is quoted often costs little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ordinal
from .common import BROADCAST_IDS, Workspace, join_hot, known_id, shown_id, unused

#: Words are what lies between these characters, once A-Z are small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
WINDOW = 10
#: Words of a chunk.
CHUNK = 2048
#: Windows that are broadcast at once, at some 120 bytes each; more are looked up in blocks of so many.
MAX_WINDOWS = 400_000
#: Stands for the document itself among its hits.
MARK = -1
KEY = ["doc_id", "sha", "part"]


def lowered(text: Column) -> Column:
    """A-Z as small letters; no other letter changes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(of: Column, at: Column, n: int, most: int) -> Column:
    """Windows of n words that start at one of the first `most` words: place, n, the words joined by spaces."""
    last = F.least(F.size(of) - n, F.lit(most - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((at + i).cast("long").alias("pos"), F.lit(n).cast("long").alias("n"), F.array_join(F.slice(of, i + 1, n), " ").alias("t")))


def benchmark_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(t, n, sid): each window once, with the set of items that hold it; (sid, items): those sets."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("n"))
    each = items.select("item", "n", F.explode_outer(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.col("n")), " "))).alias("t"))
    held = work.save(each.groupBy("t").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sets = work.save(ordinal(held.select("items").distinct(), ["items"], "sid"), "sets")
    return work.save(held.join(sets, "items").select("t", "n", "sid"), "numbered"), sets


def _hits(rows: DataFrame, windows: DataFrame, lengths: list[int], marks: bool) -> DataFrame:
    """KEY, pos, n, sid of every window that is among `windows`, and with marks a row (MARK, words, MARK) for each row of rows."""
    longest = max(lengths, default=1)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, CHUNK + longest - 1).alias("w"), F.size("w").alias("all")))
    rows = rows.select(*KEY, F.explode_outer(chunks).alias("c"))
    none = F.array().cast("array<struct<pos:bigint,n:bigint,t:string>>")
    mark = F.array(F.struct(F.lit(MARK).cast("long").alias("pos"), F.col("c.all").cast("long").alias("n"), F.lit("").alias("t")))
    found = [F.when(F.col("c.at") == 0, mark).otherwise(none)] if marks else [none]
    found += [_windows(F.col("c.w"), F.col("c.at"), n, CHUNK) for n in lengths]
    rows = rows.select(*KEY, F.explode_outer(F.concat(*found)).alias("x")).select(*KEY, "x.pos", "x.n", "x.t")
    known = windows.select(F.xxhash64("t").alias("h"), F.col("t").alias("known"), "sid")
    if marks:
        known = known.unionByName(windows.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.lit("").alias("known"), F.lit(MARK).cast("long").alias("sid")))
    return rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(known), "h").filter(F.col("t") == F.col("known")).select(*KEY, "pos", "n", "sid")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, sha (SHA-256 of the text), n_words, n_hit, spans, items.

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one
    window. A word of a document is hit if it lies in an occurrence of a window. spans are maximal
    runs of hit words (start, end), counted from 0, in order; items are the ids, as text in order,
    of all items with a window that occurs. Null and empty texts have no words; null ids stay null;
    a null item id counts as the empty text, items that share an id count once. Repeated rows have
    equal rows each. Other columns, whatever their names, are not read. Empty tables give no rows or
    no hits. The list of a document's items is in one row, as its digest needs it.

    The benchmark's windows are broadcast, in blocks of max_windows: each further block reads docs anew.
    """
    work = Workspace(docs.sparkSession, "contamination")
    windows, sets = benchmark_windows(benchmark, size, item_col, item_text_col, work)
    counts = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # size rows at most
    blocks = max(1, -(-sum(counts.values()) // max_windows))
    # Rows of one id and text in one partition share a key: they have the same hits, and a repeated row is spread as its copies are.
    rows = docs.select(known_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "part", words(F.col("text")).alias("w"))
    of = lambda b: windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(blocks)) == b)
    hits = reduce(DataFrame.unionByName, (_hits(rows, of(b), sorted(counts), b == 0) for b in range(blocks)))

    hits = hits.groupBy(*KEY, "pos", "n", "sid").agg(F.count("*").alias("times"))
    hit = F.col("sid") != MARK
    hits = hits.withColumn("end", F.when(hit, F.col("pos") + F.col("n")).otherwise(F.lit(MARK)))
    place = Window.partitionBy(*KEY).orderBy("pos", "end", "sid")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce((F.col("pos") > reach).cast("long"), F.lit(1)))
    hits = hits.withColumn("span", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    marked = F.when(~hit, F.struct("n", "times"))
    spans = hits.groupBy(*KEY, "span").agg(F.min("pos").alias("start"), F.max("end").alias("end"), F.max(marked).alias("mark"), F.collect_set("sid").alias("sids"))
    one = F.when(F.col("mark").isNull(), F.struct("start", "end"))
    rows = spans.groupBy(*KEY).agg(F.max("mark").alias("mark"), F.array_sort(F.collect_list(one)).alias("spans"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("mark").isNull(), F.col("sids"))))).alias("sids"))
    rows = work.save(rows.select(*KEY, "mark", "spans", "sids"), "found")

    asked = rows.filter(F.size("sids") > 0).select(*KEY, F.explode("sids").alias("sid"))
    small = sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] <= BROADCAST_IDS
    named = asked.join(F.broadcast(sets), "sid") if small else join_hot(work.save(asked, "asked"), sets, ["sid"])
    named = named.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = rows.filter(F.size("sids") > 0).join(named, KEY).unionByName(rows.filter(F.size("sids") == 0).withColumn("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = named.select(*KEY, F.col("mark.n").alias("n_words"), n_hit.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mark.times"))).alias("copy"))
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), "sha", "n_words", "n_hit", "spans", "items")


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of contamination()'s rows."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """docs with text less the words in spans and what stands between two words of one span."""
    gaps, pieces = (unused(c, docs.columns) for c in ("gaps", "pieces"))
    names, cased = docs.columns, WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumn(gaps, F.split(t, cased, -1))
    docs = docs.withColumn(pieces, F.zip_with(F.col(gaps), F.regexp_extract_all(t, F.lit(cased), F.lit(0)), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"].cast("int")))
    starts = F.concat(F.transform(spans, lambda x: x["start"].cast("int")), F.array(F.size(gaps) - 1))
    kept = F.zip_with(ends, starts, lambda b, a: F.concat(F.array_join(F.slice(pieces, b + 1, a - b), ""), F.get(gaps, a)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text))).select(*(F.col(f"`{c}`") for c in names))


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop: str = "spans", **options) -> DataFrame:
    """The rows and columns of docs without the hit words of their texts (drop="spans") or without rows that have any (drop="documents").

    Of a span goes what stands between its words, too. options are those of contamination(). Rows
    without a hit stay as they are, null texts too.
    """
    if drop not in ("spans", "documents"):
        raise ValueError(f"drop is 'spans' or 'documents', not {drop!r}")
    work = Workspace(docs.sparkSession, "decontaminate")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    names = docs.columns
    key, sha, spans = (unused(c, names) for c in ("hit_id", "hit_sha", "hit_spans"))
    hit = contamination(docs, benchmark, **options).filter("n_hit > 0")
    hit = work.save(hit.select(known_id("doc_id").alias(key), F.col("sha").alias(sha), F.col("spans").alias(spans)).dropDuplicates([key, sha]), "hit")
    rows = docs.withColumn(key, known_id(id_col)).withColumn(sha, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    small = hit.agg(F.coalesce(F.sum(F.size(spans) + 8), F.lit(0))).first()[0] <= BROADCAST_IDS
    if drop == "documents":
        ids = hit.select(key, sha)
        return rows.join(F.broadcast(ids) if small else ids, [key, sha], "left_anti").select(*(F.col(f"`{c}`") for c in names))
    joined = rows.join(F.broadcast(hit), [key, sha], "left") if small else join_hot(rows, hit, [key, sha], "left")
    return _without(joined, text_col, spans).select(*(F.col(f"`{c}`") for c in names))
