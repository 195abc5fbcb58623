"""The question pipeline as one lazy plan over a batch: classify, decompose, search, fuse, filter, rerank, merge, answer."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..functions.text import ANSWER_DECLINES, says_any, strip, word_count
from ..operators import retrieval as R
from ..operators.relational import ordinal
from ..sources.storage import remove, shared_folder, tidy

NOTHING = "I couldn't find relevant information in the documentation."
NO_PARTS = "No relevant information found to answer the question."
NOT_COMBINED = "Unable to generate a final answer."
#: Into so many a failed batch is cut; so many are asked at a time.
PIECES = 8


def search_queries(questions: DataFrame) -> DataFrame:
    """qid, query_type, qno, text: the question, and for all but simple and troubleshooting ones up to
    three parts that differ from it, four in all."""
    q = questions.withColumn("query_type", plugins.classify(F.col("text")))
    parts = F.filter(plugins.sub_questions(F.col("text")), lambda s: s != F.col("text"))
    texts = F.when(F.col("query_type").isin("simple", "troubleshoot"), F.array("text")).otherwise(F.slice(F.array_prepend(parts, F.col("text")), 1, 4))
    return q.select("qid", "query_type", F.posexplode(texts).alias("qno", "text"))


def _few(queries: DataFrame):
    return F.broadcast if queries.count() <= R.MAX_QUESTIONS else lambda df: df  # a list has DENSE_K hits at most


def dense_candidates(queries: DataFrame, index: R.KeywordIndex, vectors: DataFrame) -> DataFrame:
    """The dense pool: records hold 1000 characters and a URL. The index's blocks are not needed."""
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    hits = _few(queries)(R.dense_search(vectors, queries))
    return R.pool(index.corpus.select(*R.KEY, "content").join(hits, R.KEY).withColumn("content", F.substring("content", 1, 1000)).withColumn("url", url))


def keyword_candidates(queries: DataFrame, index: R.KeywordIndex) -> DataFrame:
    """The concatenated keyword lists: records hold the whole text and no URL."""
    hits = _few(queries)(R.keyword_search(index, queries))
    return R.concatenated(index.corpus.select(*R.KEY, "content").join(hits, R.KEY))


def candidates(queries: DataFrame, index: R.KeywordIndex, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dense pool and the keyword lists. The texts of hits come from the index's corpus."""
    return dense_candidates(queries, index, vectors), keyword_candidates(queries, index)


def ask(questions: DataFrame, index: R.KeywordIndex, vectors: DataFrame, least: float = R.MIN_SIMILARITY, scorer: plugins.Scorer | None = None) -> DataFrame:
    """One row a question (qid, text): type, queries, chunks, context, answer, abstained.

    A question for which nothing passes the threshold gets the standard answer and abstains. scorer
    reranks what passes; without one, similarity does.
    """
    queries = search_queries(questions)
    kept = R.above_threshold(R.fuse(*candidates(queries, index, vectors)), least)
    if scorer is not None:
        kept = kept.join(questions.select("qid", F.col("text").alias("question")), "qid")
    hits = R.rerank(kept, scorer=scorer)
    text = R.context(R.merge_adjacent(hits))
    asked = queries.groupBy("qid").agg(F.first("query_type").alias("query_type"), F.count("*").alias("n_queries"))
    out = asked.join(text, "qid", "left")
    answer = F.when(F.col("context").isNull(), NOTHING).otherwise(plugins.answer(F.col("first_chunk")))
    abstained = F.col("context").isNull() | (says_any(answer, ANSWER_DECLINES) & (word_count(answer) < 60))
    return out.select("qid", "query_type", "n_queries", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("context", F.lit("")).alias("context"), answer.alias("answer"), abstained.alias("abstained"))


def combine_answers(questions: DataFrame, parts: DataFrame, chunks: DataFrame, combine=plugins.combine) -> DataFrame:
    """One row a question (qid, text): answer, made of its parts' answers, and images, those of the parts' contexts.

    parts: qid, qno, text, answer. chunks: qid, qno, place, type, page_number, content, image_path. Of
    chunks of type image those whose path holds data/ are served, below /static/, with their page and
    caption (the content), by part and place; one that stands in two contexts is listed twice. Without
    parts there is a standard answer, and another if combine gives null. Nulls in texts and answers are
    empty. A question has four parts of TOP_N chunks at most, so what is gathered for it is small.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("Sub-question: "), known("text"), F.lit("\nAnswer: "), known("answer"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("qno", line.alias("t")))), lambda x: x["t"])
    said = parts.groupBy("qid").agg(F.array_join(lines, "\n\n").alias("__parts"))
    served = F.translate(F.replace("image_path", F.lit("data/"), F.lit("/static/")), "\\", "/")
    image = F.struct(served.alias("url"), F.col("page_number").cast("long").alias("page"), F.col("content").alias("caption"))
    shown = chunks.filter((F.col("type") == "image") & F.contains("image_path", F.lit("data/")))
    shown = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("qno", "place", image.alias("image")))).alias("__images"))
    out = questions.select("qid", "text").join(said, "qid", "left").join(shown, "qid", "left")
    answer = F.when(F.col("__parts").isNull(), NO_PARTS).otherwise(F.coalesce(combine(F.col("text"), F.col("__parts")), F.lit(NOT_COMBINED)))
    images = F.when(F.col("__parts").isNotNull(), F.transform("__images", lambda x: x["image"]))
    return out.select("qid", answer.alias("answer"), F.coalesce(images, F.array().cast("array<struct<url:string,page:bigint,caption:string>>")).alias("images"))


def run_batch(questions: DataFrame, index: R.KeywordIndex, vectors: DataFrame, least: float = R.MIN_SIMILARITY, ask=ask, pieces: int = PIECES) -> DataFrame:
    """One row a question (qid, text): answer, n_sources, latency, error. A question that fails has an error and no answer.

    Null and blank questions are errors. If a batch fails, so many pieces of it are asked on their own,
    all failed batches' pieces together and as many at a time, until an error is that of its question
    alone. latency: seconds of the batch that the question was in.
    """
    spark = questions.sparkSession
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    shape = lambda answer, n, seconds, error: (F.coalesce(answer, F.lit("")).alias("answer"), n.cast("long").alias("n_sources"), seconds.cast("double").alias("latency"), error.cast("string").alias("error"))
    nothing, none = F.lit(""), F.lit(None)
    out = questions.filter(blank).select("qid", *shape(nothing, F.lit(0), F.lit(0.0), F.lit("no question")))
    asked = ordinal(questions.filter(~blank), ["qid"], "__at")
    path, total = shared_folder(spark, "answers"), asked.count()

    def attempt(span: tuple[int, int]) -> tuple[float, str | None]:
        start, error = time.time(), None
        part = asked.filter(F.col("__at").between(span[0], span[1] - 1)).drop("__at")
        try:
            ask(part, index, vectors, least).select("qid", "answer", F.col("n_chunks").cast("long").alias("n_chunks")).write.parquet(f"{path}/batch={span[0]}")
        except Exception as e:  # noqa: BLE001  any failure of a plan or a model is the question's
            error = str(e)[:200]
            remove(spark, f"{path}/batch={span[0]}")
        return round(time.time() - start, 3), error

    spans, done, failed = [(0, total)] if total else [], [], []
    with tidy(spark), ThreadPoolExecutor(pieces) as pool:
        while spans:
            again = []
            for (low, high), (seconds, error) in zip(spans, list(pool.map(attempt, spans))):
                if error is None:
                    done.append((low, seconds))
                elif high - low == 1:
                    failed.append((low, seconds, error))
                else:
                    step = -(-(high - low) // pieces)
                    again += [(at, min(at + step, high)) for at in range(low, high, step)]
            spans = again
    if done:
        answers = spark.read.schema(f"qid {questions.schema['qid'].dataType.simpleString()}, answer string, n_chunks long, batch long").parquet(path)
        times = spark.createDataFrame(done, "batch long, seconds double")  # a row for each batch that ran
        out = out.unionByName(answers.join(F.broadcast(times), "batch").select("qid", *shape(F.col("answer"), F.col("n_chunks"), F.col("seconds"), none)))
    if failed:
        errors = spark.createDataFrame(failed, "__at long, seconds double, message string")  # a row for each batch of one question that failed
        out = out.unionByName(asked.join(errors, "__at").select("qid", *shape(nothing, F.lit(0), F.col("seconds"), F.col("message"))))
    return out
