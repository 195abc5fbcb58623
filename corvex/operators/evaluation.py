"""Evaluation of question answering: merging systems' answers, scoring rows, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SCORED_DECLINES, flat_json, says_any, strip

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "resolution_rate"]
# Shares of question types.
TYPE_SHARES = {"simple": 0.40, "multi_part": 0.20, "troubleshoot": 0.20, "comparison": 0.10, "out_of_scope": 0.10}


def question_key(c: Column) -> Column:
    return F.lower(strip(c))


def merge_answers(rag: DataFrame, fin: DataFrame) -> DataFrame:
    """question, question_type, rag, fin: answers of two systems side by side.

    rag and fin: pos, question, question_type, answer. A question's partner has the same text in
    lower case without outer white space; of several the last one's answer counts. Failing that, the
    first whose key begins with the same 60 characters. Rows of fin whose exact key rag lacks are
    added, even if such a beginning matched them.
    """
    f = fin.withColumn("key", question_key(F.col("question")))
    last = Window.partitionBy("key").orderBy(F.desc("pos"))
    # A key keeps the place where it was first seen and takes the last one's answer.
    exact = f.withColumn("rn", F.row_number().over(last)).withColumn("seen", F.min("pos").over(Window.partitionBy("key"))).filter("rn = 1").select("key", "seen", F.col("answer").alias("exact"), F.lit(True).alias("hit"))
    short = exact.withColumn("start", F.substring("key", 1, 60))
    short = short.withColumn("rn", F.row_number().over(Window.partitionBy("start").orderBy("seen"))).filter("rn = 1").select("start", F.col("exact").alias("partial"))
    r = rag.withColumn("key", question_key(F.col("question"))).withColumn("start", F.substring("key", 1, 60))
    both = r.join(exact.drop("seen"), "key", "left").join(short, "start", "left")
    merged = both.select("question", "question_type", F.col("answer").alias("rag"), F.when(F.col("hit"), F.col("exact")).otherwise(F.col("partial")).alias("fin"))
    alone = f.join(r.select("key").distinct(), "key", "left_anti")
    return merged.unionByName(alone.select("question", F.coalesce("question_type", F.lit("simple")).alias("question_type"), F.lit(None).cast("string").alias("rag"), F.col("answer").alias("fin")))


def judged(reply: Column) -> Column:
    """The score in the first flat JSON object of a judge's reply; 0 if there is none."""
    return F.coalesce(F.from_json(flat_json(reply), "score double, reason string")["score"], F.lit(0.0))


def score(rows: DataFrame) -> DataFrame:
    """Scores of answers: rows of system, question_type, answer, error, latency and a judge's j1 to j4.

    Errors and empty answers score 0; the empty ones have no error and so count as valid later. For
    questions out of scope faithfulness says whether the answer declined, and precision is 1.
    """
    failed = F.col("error").isNotNull() | F.col("answer").isNull() | (F.col("answer") == "")
    declines = says_any(F.col("answer"), SCORED_DECLINES)
    out = F.col("question_type") == "out_of_scope"
    values = {
        "faithfulness": F.when(out, declines.cast("double")).otherwise(F.col("j1")),
        "answer_relevancy": F.col("j2"),
        "context_precision": F.when(out, 1.0).otherwise(F.col("j3")),
        "resolution_rate": F.when(out, F.col("j2")).otherwise(F.col("j4")),
    }
    scored = {m: F.when(failed, 0.0).otherwise(v) for m, v in values.items()}
    return rows.withColumns({"declined": ~failed & declines}).select("id", "system", "question_type", *(c.alias(m) for m, c in scored.items()), "latency", F.col("declined").alias("abstained"), "error")


def aggregate(scores: DataFrame) -> DataFrame:
    """Per system, overall (question_type null) and by type: means of the metrics, and n, of rows without error."""
    valid = scores.filter("error is null")
    means = [F.round(F.avg(m), 3).alias(m) for m in METRICS]
    return valid.groupingSets([["system"], ["system", "question_type"]], "system", "question_type").agg(*means, F.count("*").alias("n"))


def latencies(scores: DataFrame) -> DataFrame:
    """Per system mean, median and 95th percentile of positive latencies: the element at floor(n * p), from 0.

    Places come from counts of equal values, so no task sorts a whole system's rows.
    """
    ok = scores.filter("error is null and latency > 0").groupBy("system", "latency").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("system").orderBy("latency"))
    ok = ok.withColumn("upto", upto).withColumn("n", F.sum("m").over(Window.partitionBy("system")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("latency")))
    return ok.groupBy("system").agg(F.round(F.sum(F.col("latency") * F.col("m")) / F.sum("m"), 3).alias("latency_avg"), F.round(at(0.5), 3).alias("latency_p50"), F.round(at(0.95), 3).alias("latency_p95"))


def rates(scores: DataFrame) -> DataFrame:
    """Abstentions among valid rows, errors among all."""
    return scores.groupBy("system").agg(F.round(F.avg(F.when(F.col("error").isNull(), F.col("abstained").cast("double"))), 3).alias("abstention_rate"), F.round(F.avg(F.col("error").isNotNull().cast("double")), 3).alias("error_rate"), F.count_if(F.col("error").isNull()).alias("n"))


def quotas(count: int) -> dict[str, int]:
    """Questions of each type: their share of count, one at least; what is missing are simple ones."""
    out = {t: max(1, int(count * s)) for t, s in TYPE_SHARES.items()}
    out["simple"] += max(0, count - sum(out.values()))
    return out


def sample_questions(chunks: DataFrame, count: int) -> DataFrame:
    """question_type, i, url and chunk of a sample, the same on every run.

    The i-th question of a type takes a chunk of the i-th URL, counted round, the one with the least
    MD5 of type, i and chunk. chunks: url, chunk. Questions out of scope have no chunk.
    """
    spark = chunks.sparkSession
    wanted = spark.createDataFrame([(t, i) for t, n in quotas(count).items() for i in range(n)], "question_type string, i int")  # count rows
    from .relational import ordinal

    urls = ordinal(chunks.select("url").distinct(), ["url"], "u")
    total = urls.agg(F.count("*").alias("n_urls"))
    scoped = wanted.filter("question_type <> 'out_of_scope'").crossJoin(F.broadcast(total)).withColumn("u", F.pmod("i", "n_urls"))
    picked = scoped.join(urls, "u").join(chunks, "url")
    mark = F.md5(F.concat_ws("|", "question_type", F.col("i").cast("string"), F.col("chunk").cast("string")))
    one = picked.groupBy("question_type", "i").agg(F.min_by(F.struct("url", "chunk"), F.struct(mark, "chunk")).alias("x")).select("question_type", "i", "x.url", "x.chunk")
    rest = wanted.filter("question_type = 'out_of_scope'").select("question_type", "i", F.lit(None).cast("string").alias("url"), F.lit(None).cast(chunks.schema["chunk"].dataType).alias("chunk"))
    return one.unionByName(rest)
