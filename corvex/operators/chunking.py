"""Chunkers. The stateful ones are folds over arrays, so a document never leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import let, split_words, strip, word_count

STRINGS = "array<string>"
WINDOW, STRIDE = 512, 462
SMALL_PAGE, LARGEST, OVERLAP, LEAST, SHORT = 250, 300, 50, 60, 20


def fixed_windows(text: Column, size: int = WINDOW, stride: int = STRIDE) -> Column:
    """Windows of size words every stride words, joined by single spaces; the last may lie within its predecessor."""

    def windows(words):
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride)), lambda s: s < F.size(words))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))

    return let(split_words(text), windows)


def paragraphs(text: Column, at: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, at), strip), lambda p: p != "")


def merge_short(paras: Column, least: int = SHORT) -> Column:
    """A paragraph of fewer than `least` words takes in its successor."""
    zero = F.struct(F.array().cast(STRINGS).alias("o"), F.lit("").alias("b"))

    def step(a, p):
        grown = F.struct(a["o"].alias("o"), F.concat(a["b"], F.lit("\n\n"), p).alias("b"))
        full = F.struct(F.array_append(a["o"], a["b"]).alias("o"), p.alias("b"))
        return F.when(a["b"] == "", F.struct(a["o"].alias("o"), p.alias("b"))).when(word_count(a["b"]) < least, grown).otherwise(full)

    return F.aggregate(paras, zero, step, lambda a: F.when(a["b"] == "", a["o"]).otherwise(F.array_append(a["o"], a["b"])))


def pack_sentences(text: Column, largest: int = LARGEST) -> Column:
    """Sentences packed up to `largest` words; a longer one is cut every `largest` words."""
    zero = F.struct(F.array().cast(STRINGS).alias("o"), F.array().cast(STRINGS).alias("c"), F.lit(0).alias("w"))
    none = F.array().cast(STRINGS)

    def state(o, c, w):
        return F.struct(o.alias("o"), c.alias("c"), w.cast("int").alias("w"))

    def flushed(a):
        return F.when(F.size(a["c"]) > 0, F.array_append(a["o"], F.array_join(a["c"], " "))).otherwise(a["o"])

    def step(a, s):
        n = word_count(s)
        return (
            F.when(n > largest, state(F.concat(flushed(a), fixed_windows(s, largest, largest)), none, F.lit(0)))
            .when((a["w"] + n > largest) & (F.size(a["c"]) > 0), state(flushed(a), F.array(s), n))
            .otherwise(state(a["o"], F.array_append(a["c"], s), a["w"] + n))
        )

    packed = F.aggregate(F.split(text, r"(?<=[.!?])[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"), zero, step, flushed)
    return F.filter(packed, lambda c: strip(c) != "")


def sliding_paragraphs(paras: Column, largest: int = LARGEST, overlap: int = OVERLAP) -> Column:
    """Windows of whole paragraphs up to `largest` words, each starting with the last ones of its
    predecessor that have `overlap` words at most; a longer paragraph is packed by sentences."""
    none = F.array().cast(STRINGS)
    zero = F.struct(none.alias("o"), none.alias("c"), F.lit(0).alias("w"))

    def state(o, c, w):
        return F.struct(o.alias("o"), c.alias("c"), w.cast("int").alias("w"))

    def flushed(a):
        return F.when(F.size(a["c"]) > 0, F.array_append(a["o"], F.array_join(a["c"], "\n\n"))).otherwise(a["o"])

    def tail(paras):
        start = F.struct(none.alias("k"), F.lit(0).alias("w"), F.lit(True).alias("open"))

        def take(t, p):
            n = word_count(p)
            fits = t["open"] & (t["w"] + n <= overlap)
            return F.when(fits, F.struct(F.array_prepend(t["k"], p).alias("k"), (t["w"] + n).alias("w"), F.lit(True).alias("open"))).otherwise(F.struct(t["k"].alias("k"), t["w"].alias("w"), F.lit(False).alias("open")))

        return F.aggregate(F.reverse(paras), start, take, lambda t: t["k"])

    def step(a, p):
        n = word_count(p)
        kept = tail(a["c"])
        return (
            F.when(n > largest, state(F.concat(flushed(a), pack_sentences(p, largest)), none, F.lit(0)))
            .when((a["w"] + n > largest) & (F.size(a["c"]) > 0), state(flushed(a), F.array_append(kept, p), word_count(F.array_join(kept, " ")) + n))
            .otherwise(state(a["o"], F.array_append(a["c"], p), a["w"] + n))
        )

    return F.aggregate(paras, zero, step, flushed)


def link_share(markdown: Column) -> Column:
    """Share of lines that are a link, with or without a star before it (a hyphen doesn't count)."""
    lines = F.split(strip(markdown), r"\r\n|[\n\r\x{0b}\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.size(F.filter(lines, lambda line: line.rlike(r"^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*\*?[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*\[.+\]\(.+\)"))) / F.size(lines)


def page_windows(markdown: Column, at: str = r"\n{2,}") -> Column:
    """A page's texts before numbering: none if blank or mostly links, one if short, else sliding windows."""
    text = strip(markdown)
    return (
        F.when((text == "") | markdown.isNull() | (link_share(markdown) > 0.6), F.array().cast(STRINGS))
        .when(word_count(text) <= SMALL_PAGE, F.array(text))
        .otherwise(sliding_paragraphs(merge_short(paragraphs(text, at))))
    )


def chunk_pages(pages: DataFrame, at: str = r"\n{2,}") -> DataFrame:
    """Chunks of pages (url, title, markdown): content, page_number, word_count, chunk_id, source_url, page_title.

    Texts of fewer than 60 words are dropped, after numbering. The title and URL put in front are
    not counted.
    """
    rows = pages.select("url", F.coalesce("title", F.lit("")).alias("title"), F.posexplode(page_windows(F.col("markdown"), at)).alias("i", "body"))
    rows = rows.withColumn("word_count", word_count(F.col("body")).cast("long")).filter(F.col("word_count") >= LEAST)
    number = (F.col("i") + 1).cast("long")
    content = F.concat(F.lit("["), "title", F.lit("]\nSource: "), "url", F.lit("\n\n"), "body")
    chunk_id = F.concat(U.url_slug(F.col("url"), ""), F.lit("-c"), number.cast("string"))
    return rows.select(content.alias("content"), number.alias("page_number"), "word_count", chunk_id.alias("chunk_id"), F.col("url").alias("source_url"), F.col("title").alias("page_title"))


def chunk_documents(docs: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Chunks of extracted documents (doc_id, text): doc_id, page_number (from 1), content."""
    rows = docs.select("doc_id", F.posexplode(fixed_windows(F.col("text"), size, stride)).alias("i", "content"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("page_number"), "content")
