"""Keyword and vector search, rank fusion, thresholds, reranking and merging, over batches of questions.

Lists are rows with explicit ranks. Scores are rounded to 6 places before they rank anything, so
that the order of additions can't change an order of results; equal scores go by document and page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import plugins
from ..functions.text import preview, strip, tokens, word_count
from ..sources.storage import shared_folder, small_batches, stored
from .keyword_index import CELLS, KEY, MAX_QUESTIONS, Best, KeywordIndex, build_index, in_batches, keyword_search, load_index, postings_of  # noqa: F401
from .relational import keep_first, top

DENSE_K, RRF_K, CANDIDATES, TOP_N, MERGED_WORDS = 25, 60, 40, 6, 600
MIN_SIMILARITY = 0.70


def store_vectors(corpus: DataFrame, embed: plugins.Embedder | None = None, path: str | None = None) -> DataFrame:
    """key, vector: the embeddings of a corpus (key, token list t), computed once and stored at path or in a shared folder."""
    embed = embed or plugins.HashingEmbedder()
    small_batches(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            t = b.column("t")
            v = (embed.of_lists(t, known) if hasattr(embed, "of_lists") else embed(t.to_pylist())).astype("float32")
            ends = np.arange(len(t) + 1, dtype=np.int32) * v.shape[1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], names=[*KEY, "vector"])

    rows = corpus.select(*KEY, "t").mapInArrow(run, "doc_id long, page_number long, vector array<float>")
    return stored(rows, path or shared_folder(corpus.sparkSession, "vectors"))


def build_both(chunks: DataFrame) -> tuple[KeywordIndex, DataFrame]:
    """The keyword index of chunks and their vectors."""
    index = build_index(chunks)
    return index, store_vectors(index.corpus)


def dense_search(vectors: DataFrame, questions: DataFrame, k: int = DENSE_K, embed: plugins.Embedder | None = None) -> DataFrame:
    """The k nearest stored vectors (key, vector) of each question by cosine, above 0: qid, qno, key, sim, rank.

    Every task multiplies blocks of its vectors with those of all questions of a batch, and passes
    on its k best of each question (more if some are equal). A last step takes the best.
    """
    embed = embed or plugins.HashingEmbedder()
    spark = vectors.sparkSession
    small_batches(spark)

    def search(batch: DataFrame) -> DataFrame:
        asked = batch.select("qid", "qno", tokens(F.col("text")).alias("t")).toPandas()  # MAX_QUESTIONS rows at most
        q = embed([list(t) for t in asked.t])
        held = spark.sparkContext.broadcast((asked.qid.to_numpy(), asked.qno.to_numpy(), q, np.linalg.norm(q, axis=1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qno, q, norms = held.value
            best, step = Best(len(qid), k, 0.0), max(1, CELLS // max(1, len(qid)))
            for whole in batches if len(qid) else ():
                for lo in range(0, whole.num_rows, step):
                    b = whole.slice(lo, step)
                    v = b.column("vector").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
                    both = norms[:, None] * np.linalg.norm(v, axis=1)[None, :]
                    sim = np.round(np.divide(q @ v.T, both, out=np.zeros_like(both), where=both > 0), 6)
                    best.add(sim, b.column("doc_id").to_numpy(), b.column("page_number").to_numpy(), 0.0)
            yield from best.rows("sim", qid=pa.array(qid), qno=pa.array(qno))

        near = vectors.select(*KEY, "vector").mapInArrow(run, "qid long, qno int, doc_id long, page_number long, sim double")
        return top(near, ["qid", "qno"], [F.desc("sim"), *KEY], k)

    return in_batches(search, questions)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def pool(dense: DataFrame) -> DataFrame:
    """One list a question from those of its queries: of equal 300-character beginnings the first
    query's copy stays, even if a later one scored higher; then by similarity. Adds pool_rank."""
    first = keep_first(dense, ["qid", F.substring("content", 1, 300)], ["qno", "rank"])
    return first.withColumn("pool_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "qno", "rank")))


def concatenated(sparse: DataFrame) -> DataFrame:
    """Keyword lists one after another; list_rank runs on through them."""
    return sparse.withColumn("list_rank", F.row_number().over(Window.partitionBy("qid").orderBy("qno", "rank")))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion on the first 200 characters: qid, the first-seen record, rrf, fused_rank.

    dense: qid, key, content, url, sim, pool_rank. sparse: qid, key, content, list_rank. A record of
    the keyword list alone has sim 0 and no url.
    """
    d = dense.select("qid", *KEY, "content", "url", "sim", F.lit(1).alias("list"), F.col("pool_rank").alias("r"))
    s = sparse.select("qid", *KEY, "content", F.lit("").alias("url"), F.lit(0.0).alias("sim"), F.lit(2).alias("list"), F.col("list_rank").alias("r"))
    both = d.unionByName(s).withColumn("key", F.substring("content", 1, 200))
    record = F.struct("list", "r", *KEY, "content", "url", "sim")
    one = both.groupBy("qid", "key").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("rrf"), F.min(record).alias("x"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "x.list", "x.r")
    return one.withColumn("fused_rank", F.row_number().over(order)).select("qid", "x.doc_id", "x.page_number", "x.content", "x.url", "x.sim", "rrf", "fused_rank")


def above_threshold(fused: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Similar enough, or found by keywords alone."""
    return fused.filter((F.col("sim") >= least) | ((F.col("sim") == 0) & (F.col("rrf") > 0)))


def rerank(kept: DataFrame, cap: int = CANDIDATES, n: int = TOP_N, scorer: plugins.Scorer | None = None) -> DataFrame:
    """Of the first cap candidates of each question the n best by similarity, or by a scorer's scores: adds final_rank.

    With a scorer, kept holds the question as `question`. Of each question's candidates the
    max(n + 4, 10) best by score are asked for, whose score replaces sim and is rerank_score too; the
    n best of them stay. A question for which the scorer fails is ranked by similarity.
    """
    first = top(kept, ["qid"], ["fused_rank"], cap, "pos")
    if scorer is None:
        return top(first, ["qid"], [F.desc("sim"), "pos"], n, "final_rank")
    scored = first.withColumn("rerank_score", plugins.scores(scorer)(F.col("question"), F.col("content")))
    failed = F.count_if(F.col("rerank_score").isNull()).over(Window.partitionBy("qid")) > 0  # cap rows at most
    scored = scored.withColumn("rerank_score", F.when(failed, F.lit(None)).otherwise(F.col("rerank_score")))
    scored = scored.withColumn("sim", F.coalesce("rerank_score", "sim"))
    requested = top(scored, ["qid"], [F.desc("sim"), "pos"], max(n + 4, 10), "final_rank")
    return requested.filter(F.col("final_rank") <= n)


def merge_adjacent(hits: DataFrame, largest: int = MERGED_WORDS) -> DataFrame:
    """Neighbouring chunks of one URL as one, while it has fewer than `largest` words.

    hits: qid, content, url, page_number, sim, rrf, final_rank. Scores become their maximum, the page
    the last one. Hits without URL come first, then URLs as first seen: adds place, from 1. A group
    is one question's hits of one URL, final_rank bounds it.
    """
    item = F.struct("page_number", "final_rank", "content", "sim", "rrf")
    groups = hits.filter("url <> ''").groupBy("qid", "url").agg(F.array_sort(F.collect_list(item)).alias("g"), F.min("final_rank").alias("seen"))
    kind = "struct<content:string,page_number:bigint,sim:double,rrf:double>"
    as_hit = lambda x: F.struct(x["content"].alias("content"), x["page_number"].alias("page_number"), x["sim"].alias("sim"), x["rrf"].alias("rrf")).cast(kind)
    state = lambda o, c: F.struct(o.alias("o"), c.alias("c"))

    def step(a, x):
        c = a["c"]
        one = F.struct(
            F.concat(F.regexp_replace(c["content"], r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+$", ""), F.lit("\n\n"), F.regexp_replace(x["content"], r"^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+", "")).alias("content"),
            x["page_number"].alias("page_number"), F.greatest(c["sim"], x["sim"]).alias("sim"), F.greatest(c["rrf"], x["rrf"]).alias("rrf"),
        ).cast(kind)
        joins = (x["page_number"] == c["page_number"] + 1) & (word_count(c["content"]) < largest)
        return F.when(joins, state(a["o"], one)).otherwise(state(F.array_append(a["o"], c), as_hit(x)))

    runs = F.aggregate(F.slice(F.col("g"), F.lit(2), F.size("g")), state(F.array().cast(f"array<{kind}>"), as_hit(F.element_at("g", 1))), step, lambda a: F.array_append(a["o"], a["c"]))
    with_url = groups.select("qid", "url", F.lit(1).alias("part"), "seen", F.posexplode(runs).alias("i", "x")).select("qid", "url", "part", "seen", "i", "x.*")
    bare = hits.filter("url = ''").select("qid", "url", F.lit(0).alias("part"), F.col("final_rank").alias("seen"), F.lit(0).alias("i"), "content", "page_number", "sim", "rrf")
    both = bare.unionByName(with_url)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("part", "seen", "i"))
    return both.withColumn("place", place).select("qid", "place", "url", "content", "page_number", "sim", "rrf")


def context(chunks: DataFrame) -> DataFrame:
    """One text a question: chunks numbered and labelled by title, URL or number. A question has TOP_N chunks at most."""
    title = F.col("title") if "title" in chunks.columns else F.lit("")
    label = F.coalesce(F.nullif(title, F.lit("")), F.nullif("url", F.lit("")), F.concat(F.lit("Source "), F.col("place").cast("string")))
    text = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), label, F.lit("\n"), strip(F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("place", text.alias("t"))))
    return chunks.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"), F.min_by("content", "place").alias("first_chunk"))


def citations(chunks: DataFrame) -> DataFrame:
    """type, page, preview, url and score of every chunk that stands in the context."""
    return chunks.select("qid", "place", F.lit("text").alias("type"), F.col("page_number").alias("page"), preview(F.col("content")).alias("content_preview"), F.col("url").alias("source_url"), F.round("sim", 3).alias("score"))
