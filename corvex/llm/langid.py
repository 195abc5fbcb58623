"""Language identification by words first, then by shorter and shorter character n-grams.

A known word is scored by its log frequency in each language. An unseen word is scored by its
n-grams of 5 characters; if none of them is known, by those of 4, and so on down to 1. A text's
score for a language is the sum over its words, so the order of work is that of reading it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, held_out, known_id, shown_id
from .kernels import released

LETTERS = r"[^\W\d_]+"
LONGEST = 5
#: Documents that the model is fitted on, at most, each language having an equal share: distinct texts with the
#: least hash, whole, whatever their length. Words of its dictionary, at most, likewise: each language's most frequent.
MAX_DOCS, MAX_WORDS = 4000, 400_000
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 300_000


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams with marks at its ends, which single characters do without."""
    if n == 1:
        return list(word)
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def table_of(counts: list[dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies by key: a row of one value a language, all of them in one matrix."""
    keys = sorted(set().union(*counts))
    found = np.array([[c.get(k, 0) for c in counts] for k in keys], np.float64).reshape(len(keys), len(counts)) + 0.5
    return {k: i for i, k in enumerate(keys)}, np.log(found / found.sum(0)).astype(np.float32) if len(keys) else found.astype(np.float32)


def model_of(by_lang: dict[str, dict[str, int]]) -> tuple:
    """Languages in order, the table of words, and those of n-grams: plain data, so workers need no class to read it."""
    langs = sorted(by_lang)
    grams_of = []
    for n in range(1, LONGEST + 1):
        counts: list[dict[str, int]] = []
        for lang in langs:
            counts.append(c := {})
            for word, times in by_lang[lang].items():
                for g in grams(word, n):
                    c[g] = c.get(g, 0) + times
        grams_of.append(table_of(counts))
    return langs, table_of([by_lang[lang] for lang in langs]), grams_of


def word_scores(model: tuple, word: str) -> np.ndarray:
    """A score for each language: of the word if it is known, or the mean of its longest n-grams that are."""
    langs, (row, logs), grams_of = model
    if word in row:
        return logs[row[word]]
    for n in range(LONGEST, 0, -1):
        row, logs = grams_of[n - 1]
        found = [i for i in map(row.get, grams(word, n)) if i is not None]
        if found:
            return logs[found].mean(axis=0)
    return np.zeros(len(langs), np.float32)


def _word_counts(batches):
    """lang, word, n: words of the texts that are learned from."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            c = Counter(re.findall(LETTERS, text.lower()))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def _predict(held):
    def run(batches):
        model, find = held.value, re.compile(LETTERS).findall
        known = model[0]
        ids, rows = {}, []
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = find(text.lower()) if text else []
                if not words or not known:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                if len(ids) > REMEMBERED:
                    ids, rows = {}, []
                for w in set(words).difference(ids):
                    ids[w] = len(rows)
                    rows.append(word_scores(model, w))
                counts = Counter(words)
                total = np.array([rows[ids[w]] for w in counts]).T.astype(np.float64) @ np.fromiter(counts.values(), np.float64)
                best = int(np.argmax(total))
                langs.append(known[best])
                scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return released(run)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (share of the best language).

    The model learns from rows that are not held out (crc32 of the id as text, modulo 5, is not 0)
    and have text and a language: whole texts of at most max_docs distinct ones, as many of each
    language; of their words the max_words most frequent ones, as many of each language. Of more
    than max_docs languages the most frequent are learned. Null text, text without letters, and
    every text if there is nothing to learn from: 'und' with score 0. Equal scores: the language
    that is first by code point. Repeated rows are scored alike; null ids stay null. Other columns
    of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "langid")
    texts = docs.select(known_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = texts.withColumn("held_out", held_out_of("doc_id"))
    usable = texts.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_docs)
    n_langs, by_lang = langs.count(), {}
    if n_langs:
        hashed = usable.withColumn("t", F.xxhash64("text"))
        each = work.save(hashed.groupBy("lang", "t").agg(F.min("doc_id").alias("doc_id")), "distinct")
        share = max(1, max_docs // n_langs)
        known = each.groupBy("lang").agg(F.count("*").alias("texts")).join(F.broadcast(langs.select("lang")), "lang", "left_semi")
        # Hashes are uniform: those low enough for four times the share, so that a language's rank is over few rows.
        # A language with few texts is ranked whole.
        low = each.join(F.broadcast(known), "lang").filter((F.col("texts") <= 4 * share) | (F.col("t") / 2.0**64 + 0.5 < F.lit(4.0 * share) / F.col("texts")))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("t", "doc_id"))
        some = low.withColumn("place", place).filter(F.col("place") <= share).select("lang", "t", "doc_id")
        chosen = hashed.join(F.broadcast(some), ["lang", "t", "doc_id"], "left_semi").select("lang", "text", "t").dropDuplicates(["lang", "t"])  # max_docs rows at most
        counts = chosen.select("lang", "text").mapInArrow(released(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        counts = counts.withColumn("place", place).filter(F.col("place") <= max(1, max_words // n_langs)).select("lang", "word", "n").toArrow()
        by_lang = {r["lang"]: {} for r in some.select("lang").distinct().collect()}  # a language of letterless texts is one, too
        for lang, word, n in zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n"))):
            by_lang[lang][word] = n
    model = spark.sparkContext.broadcast(model_of(by_lang))
    out = texts.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", shown_id(F.col("doc_id")))


def held_out_of(name: str):
    """held_out() where null ids are already replaced."""
    return F.when(shown_id(F.col(name)).isNull(), held_out_null()).otherwise(held_out(name))


def held_out_null():
    return F.pmod(F.crc32(F.lit("").cast("binary")), F.lit(5)) == 0
