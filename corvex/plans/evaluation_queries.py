"""Queries of the evaluation, with their SQL: labelled documents as answers of two systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X

from ..operators import evaluation as E
from ..registry import query, table
from .chunk_queries import sql_strip

DECLINES = " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in E.SCORED_DECLINES)
SQL_ROWS = """
    rows_of AS (
        SELECT doc_id AS id, system, CASE lang WHEN 'en' THEN 'simple' WHEN 'fr' THEN 'multi_part' WHEN 'de' THEN 'comparison' ELSE 'out_of_scope' END AS question_type,
            CASE WHEN doc_id % 11 = 0 THEN '' WHEN toxic = 1 THEN 'I couldn''t find it' ELSE text END AS answer, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error,
            CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE n_chars / 1000.0::DOUBLE END AS latency,
            CASE WHEN system = 'rag' THEN quality::DOUBLE ELSE 1.0 - toxic END AS j1, quality * 0.5::DOUBLE AS j2, 1.0::DOUBLE - toxic AS j3, (quality + 1 - toxic) / 2.0::DOUBLE AS j4
        FROM documents JOIN labels USING (doc_id), (SELECT unnest(['rag', 'fin']) AS system))"""
SQL_SCORES = f"""
    marked AS (SELECT *, error IS NOT NULL OR answer = '' AS failed, ({DECLINES}) AS declines FROM rows_of),
    scores AS (
        SELECT id, system, question_type, CASE WHEN failed THEN 0.0 WHEN question_type = 'out_of_scope' THEN declines::INTEGER::DOUBLE ELSE j1 END AS faithfulness,
            CASE WHEN failed THEN 0.0 ELSE j2 END AS answer_relevancy, CASE WHEN failed THEN 0.0 WHEN question_type = 'out_of_scope' THEN 1.0 ELSE j3 END AS context_precision,
            CASE WHEN failed THEN 0.0 WHEN question_type = 'out_of_scope' THEN j2 ELSE j4 END AS resolution_rate, latency, NOT failed AND declines AS abstained, error FROM marked)"""
HEAD = f"WITH {SQL_ROWS}, {SQL_SCORES}"
SQL_MEANS = ", ".join(f"round(avg({m}), 3) AS {m}" for m in E.METRICS)
SQL_LATENCY = """
    lat AS (SELECT system, round(avg(latency), 3) AS latency_avg, round(list(latency ORDER BY latency)[floor(count(*) * 0.5)::INTEGER + 1], 3) AS latency_p50, round(list(latency ORDER BY latency)[floor(count(*) * 0.95)::INTEGER + 1], 3) AS latency_p95
        FROM scores WHERE error IS NULL AND latency > 0 GROUP BY system)"""


def answers(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("system", F.explode(F.array(F.lit("rag"), F.lit("fin"))))
    i, quality, toxic = F.col("doc_id"), F.col("quality").cast("double"), F.col("toxic").cast("double")
    kind = F.when(F.col("lang") == "en", "simple").when(F.col("lang") == "fr", "multi_part").when(F.col("lang") == "de", "comparison").otherwise("out_of_scope")
    return d.select(
        i.alias("id"), "system", kind.alias("question_type"),
        F.when(i % 11 == 0, "").when(toxic == 1, "I couldn't find it").otherwise(F.col("text")).alias("answer"),
        F.when(i % 13 == 0, "timeout").alias("error"), F.when(i % 7 == 0, 0.0).otherwise(F.col("n_chars") / 1000.0).alias("latency"),
        F.when(F.col("system") == "rag", quality).otherwise(1 - toxic).alias("j1"), (quality * 0.5).alias("j2"), (1 - toxic).alias("j3"), ((quality + 1 - toxic) / 2).alias("j4"),
    )


@query("r17_scores", f"{HEAD} SELECT * FROM scores")
def r17(spark, sf):
    return E.score(answers(spark, sf))


@query("a1_a4_means", f"{HEAD} SELECT system, question_type, {SQL_MEANS}, count(*) AS n FROM scores WHERE error IS NULL GROUP BY GROUPING SETS ((system), (system, question_type))")
def a1(spark, sf):
    return E.aggregate(E.score(answers(spark, sf)))


@query("a2_a13_latency", f"{HEAD}, {SQL_LATENCY} SELECT * FROM lat")
def a2(spark, sf):
    return E.latencies(E.score(answers(spark, sf)))


@query("a3_rates", f"{HEAD} SELECT system, round(avg(abstained::INTEGER) FILTER (error IS NULL), 3) AS abstention_rate, round(avg((error IS NOT NULL)::INTEGER), 3) AS error_rate, count(*) FILTER (error IS NULL) AS n FROM scores GROUP BY system")
def a3(spark, sf):
    return E.rates(E.score(answers(spark, sf)))


@query("a9_k9_metric_chart", f"{HEAD}, m AS (SELECT system, {SQL_MEANS} FROM scores WHERE error IS NULL GROUP BY system) SELECT system, metric, value FROM m UNPIVOT (value FOR metric IN ({', '.join(E.METRICS)}))")
def a9(spark, sf):
    m = E.aggregate(E.score(answers(spark, sf))).filter("question_type is null")
    return m.unpivot(["system"], E.METRICS, "metric", "value")


@query("a10_resolution_chart", f"{HEAD}, " + "r AS (SELECT question_type, system, round(avg(resolution_rate), 3) AS v FROM scores WHERE error IS NULL AND question_type <> 'out_of_scope' GROUP BY ALL) SELECT question_type, coalesce(max(v) FILTER (system = 'rag'), 0) AS rag, coalesce(max(v) FILTER (system = 'fin'), 0) AS fin FROM r GROUP BY question_type")
def a10(spark, sf):
    m = E.aggregate(E.score(answers(spark, sf))).filter("question_type <> 'out_of_scope'")
    return m.groupBy("question_type").pivot("system", ["rag", "fin"]).agg(F.first("resolution_rate")).fillna(0.0, ["rag", "fin"])


@query("a11_latency_quality_chart", f"{HEAD}, {SQL_LATENCY}, m AS (SELECT system, {SQL_MEANS} FROM scores WHERE error IS NULL GROUP BY system) SELECT system, latency_avg, round((faithfulness + answer_relevancy + context_precision + resolution_rate) / 4, 6) AS quality FROM lat JOIN m USING (system)")
def a11(spark, sf):
    s = E.score(answers(spark, sf))
    m = E.aggregate(s).filter("question_type is null")
    quality = sum((F.col(x) for x in E.METRICS[1:]), F.col(E.METRICS[0])) / 4
    return m.join(E.latencies(s), "system").select("system", "latency_avg", F.round(quality, 6).alias("quality"))


SQL_FIN = """
    rag AS (SELECT item_id AS pos, text AS question, 'simple' AS question_type, 'rag ' || item_id AS answer FROM benchmark),
    fin AS (SELECT item_id AS pos, CASE item_id % 4 WHEN 0 THEN '  ' || translate(text, 'aeiou', 'AEIOU') || ' ' WHEN 1 THEN substring(text, 1, 60) || ' and more' WHEN 2 THEN 'fin ' || text ELSE text END AS question, CASE WHEN item_id % 2 = 0 THEN 'multi_part' END AS question_type, 'fin ' || item_id AS answer FROM benchmark
        UNION ALL SELECT item_id + 100000, text, NULL, 'again ' || item_id FROM benchmark WHERE item_id % 4 = 3)"""


@query("j1_j2_j3_merge", f"""
    WITH {SQL_FIN}, f AS (SELECT *, lower({sql_strip('question')}) AS key FROM fin),
    e AS (SELECT key, min(pos) AS seen, max_by(answer, pos) AS answer FROM f GROUP BY key),
    s AS (SELECT substring(key, 1, 60) AS start, min_by(answer, seen) AS answer FROM e GROUP BY ALL),
    r AS (SELECT *, lower({sql_strip('question')}) AS key FROM rag)
    SELECT md5(r.question) AS question_md5, r.question_type, r.answer AS rag, CASE WHEN e.key IS NOT NULL THEN e.answer ELSE s.answer END AS fin FROM r LEFT JOIN e USING (key) LEFT JOIN s ON s.start = substring(r.key, 1, 60)
    UNION ALL SELECT md5(question), coalesce(question_type, 'simple'), NULL, answer FROM f WHERE key NOT IN (SELECT key FROM r)""")
def j1(spark, sf):
    b = table(spark, sf, "benchmark")
    i, t = F.col("item_id"), F.col("text")
    rag = b.select(i.alias("pos"), t.alias("question"), F.lit("simple").alias("question_type"), F.concat(F.lit("rag "), i.cast("string")).alias("answer"))
    q = F.when(i % 4 == 0, F.concat(F.lit("  "), F.translate(t, "aeiou", "AEIOU"), F.lit(" "))).when(i % 4 == 1, F.concat(X.prefix(t, 60), F.lit(" and more"))).when(i % 4 == 2, F.concat(F.lit("fin "), t)).otherwise(t)
    fin = b.select(i.alias("pos"), q.alias("question"), F.when(i % 2 == 0, "multi_part").alias("question_type"), F.concat(F.lit("fin "), i.cast("string")).alias("answer"))
    again = b.filter(i % 4 == 3).select((i + 100000).alias("pos"), t.alias("question"), F.lit(None).cast("string").alias("question_type"), F.concat(F.lit("again "), i.cast("string")).alias("answer"))
    m = E.merge_answers(rag, fin.unionByName(again))
    return m.select(F.md5("question").alias("question_md5"), "question_type", "rag", "fin")


@query("r16_judge_replies", r"""
    SELECT event_id, coalesce(CAST(regexp_extract(regexp_extract(reply, '(?s)\{[^{}]*\}', 0), '"score": ([0-9.]+)', 1) AS DOUBLE), 0.0) AS score
    FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'no idea {"score": 0}' ELSE 'Well: {"score": 0.' || user_id || ', "reason": "x"} {' END AS reply FROM events)""")
def r16(spark, sf):
    reply = F.when(F.col("event_type") == "view", 'no idea {"score": 0}').otherwise(F.concat(F.lit('Well: {"score": 0.'), F.col("user_id").cast("string"), F.lit(', "reason": "x"} {')))
    return table(spark, sf, "events").select("event_id", E.judged(reply).alias("score"))


@query("w12_r19_question_sample", f"""
    WITH w AS (SELECT question_type, unnest(generate_series(0, n - 1))::INTEGER AS i FROM (VALUES {", ".join(f"('{t}', {n})" for t, n in E.quotas(80).items())}) v(question_type, n)),
    u AS (SELECT source AS url, row_number() OVER (ORDER BY source) - 1 AS u FROM (SELECT DISTINCT source FROM documents)),
    p AS (SELECT question_type, i, url, doc_id AS chunk, md5(question_type || '|' || i || '|' || doc_id) AS mark FROM w JOIN u ON u.u = w.i % (SELECT count(*) FROM u) JOIN documents d ON d.source = u.url WHERE question_type <> 'out_of_scope')
    SELECT question_type, i, arg_min(url, (mark, chunk)) AS url, arg_min(chunk, (mark, chunk)) AS chunk FROM p GROUP BY ALL
    UNION ALL SELECT question_type, i, NULL, NULL FROM w WHERE question_type = 'out_of_scope'""")
def w12(spark, sf):
    """A sample of 80 questions over all sources; sampling is the feature."""
    d = table(spark, sf, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("chunk"))
    return E.sample_questions(d, 80)


@query("a16_chunk_quality", "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 3) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (quality, toxic)")
def quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.cube("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("avg_chars"))


