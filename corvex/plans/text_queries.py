"""Queries of the scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..registry import query, table

WS = X.WS
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


# The same definitions in SQL, over the column or expression x.
def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    raw = f"string_split_regex(lower(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}_\\-]+')"
    parts = f"flatten(list_transform({raw}, lambda t: CASE WHEN contains(t, '-') THEN list_append(string_split(t, '-'), t) ELSE [t] END))"
    return f"list_filter(list_transform({parts}, lambda t: trim(t, '-')), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


def sql_host(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def sql_path(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def sql_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("f1_word_count", f"SELECT doc_id, len({sql_words('text')}) AS words FROM documents")
def f1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


@query("f2_tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS token_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def f2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5"))


@query("f3_identifier", r"""
    SELECT page_id, CASE WHEN s = '' THEN 'default' WHEN regexp_matches(s[1], '\p{N}') THEN 'item-' || s ELSE s END AS ident
    FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def f3(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.identifier(F.col("url")).alias("ident"))


@query("f4_vector_id", r"""
    SELECT doc_id, page, 'doc-' || doc_id || '-text-page' || page || '-' || (row_number() OVER (ORDER BY doc_id, page) - 1) AS vector_id
    FROM (SELECT doc_id, unnest(generate_series(1, greatest(1, CAST(ceil(n / 512.0) AS BIGINT)))) AS page FROM
          (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents))""")
def f4(spark, sf):
    """Ordinals through the whole input: counted by range partition, not in one task."""
    from ..operators.relational import ordinal

    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    d = d.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / 512).cast("int")))).alias("page"))
    d = ordinal(d, ["doc_id", "page"], "i")
    ident = X.identifier(F.concat_ws("-", F.concat(F.lit("doc-"), F.col("doc_id")), F.lit("text"), F.concat(F.lit("page"), F.col("page")), F.col("i")))
    return d.select("doc_id", F.col("page").cast("long").alias("page"), ident.alias("vector_id"))


@query("f5_url_slug", f"""
    SELECT page_id, coalesce(nullif(s, ''), 'web-site') AS site_slug, coalesce(nullif(s, ''), 'web-page') AS page_slug, s || '-c1' AS chunk_id, coalesce(nullif(s, ''), 'page') AS dump_slug
    FROM (SELECT page_id, {sql_slug(sql_host('url') + ' || ' + sql_path('url'))} AS s FROM pages)""")
def f5(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.url_slug(u, "web-site").alias("site_slug"), U.url_slug(u).alias("page_slug"), F.concat(U.url_slug(u, ""), F.lit("-c1")).alias("chunk_id"), U.url_slug(u, "page").alias("dump_slug"))


@query("f6_f7_f8_urls", r"""
    SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS norm_url,
        regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS base, regexp_matches(url, '^https?://[^/?#]+') AS is_valid
    FROM pages""")
def f678(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.normalised(u).alias("norm_url"), U.base(u).alias("base"), U.valid(u).alias("is_valid"))


@query("f9_prefixes", "SELECT doc_id, " + ", ".join(f"md5(substring(text, 1, {n})) AS p{n}" for n in (60, 100, 200, 300, 400, 600, 800, 1000)) + " FROM documents")
def f9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(F.md5(X.prefix(F.col("text"), n)).alias(f"p{n}") for n in (60, 100, 200, 300, 400, 600, 800, 1000)))


@query("f10_rounding", "SELECT event_id, round(value, 1) AS r1, round(value, 2) AS r2, round(value, 3) AS r3 FROM events")
def f10(spark, sf):
    return table(spark, sf, "events").select("event_id", *(F.round("value", n).alias(f"r{n}") for n in (1, 2, 3)))


@query("f11_json_in_text", r"""
    SELECT event_id, regexp_extract(reply, '(?s)\{[^{}]*\}', 0) AS flat, CAST(regexp_extract(regexp_extract(reply, '(?s)\{[^{}]*\}', 0), '"k": (\d+)', 1) AS INTEGER) AS k,
        regexp_extract(reply, '(?s)\[.*?\]', 0) AS lazy, regexp_extract(reply, '(?s)\[.*\]', 0) AS greedy
    FROM (SELECT event_id, 'Sure: ' || props || ' and ["' || event_type || '"] or ["x"] ' || user_id AS reply FROM events)""")
def f11(spark, sf):
    reply = F.concat(F.lit("Sure: "), "props", F.lit(' and ["'), "event_type", F.lit('"] or ["x"] '), F.col("user_id").cast("string"))
    d = table(spark, sf, "events").select("event_id", reply.alias("reply"))
    flat = X.flat_json(F.col("reply"))
    return d.select("event_id", flat.alias("flat"), F.from_json(flat, "k int")["k"].alias("k"), X.first_array(F.col("reply")).alias("lazy"), X.widest_array(F.col("reply")).alias("greedy"))


@query("f12_strip_tags", "SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)")
def f12(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


def _declines(phrases):
    return " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in phrases)


@query("f13_phrases", f"SELECT doc_id, ({_declines(X.ANSWER_DECLINES + ['the the'])}) AS declines, ({_declines(X.SCORED_DECLINES + ['license'])}) AS scored FROM documents")
def f13(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.says_any(t, X.ANSWER_DECLINES + ["the the"]).alias("declines"), X.says_any(t, X.SCORED_DECLINES + ["license"]).alias("scored"))


@query("f14_progress", "SELECT event_id, round(least(0.05 + user_id::DOUBLE / greatest(137, 1) * 0.35, 0.40), 2) AS progress FROM events")
def f14(spark, sf):
    return table(spark, sf, "events").select("event_id", X.crawl_progress(F.col("user_id"), F.lit(137)).alias("progress"))


@query("f15_sizes", "SELECT doc_id, printf('%.1f MB', n_chars * 64 / 1048576.0) AS mb, round(n_chars / 1024.0, 2) AS kb FROM documents")
def f15(spark, sf):
    """format_string rounds halves up, printf to even: so do bround and the format of what it gives."""
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.when(n.isNotNull(), F.format_string("%.1f MB", F.bround(n * 64 / F.lit(1048576.0), 1))).alias("mb"), F.round(n / F.lit(1024.0), 2).alias("kb"))


@query("f16_question", rf"""
    SELECT conv_id, turn, md5(CASE WHEN ends_with(b, '?') THEN b ELSE b || '?' END) AS question_md5
    FROM (SELECT conv_id, turn, trim(regexp_replace('"' || text || '" ', '^{WS}|{WS}$', '', 'g'), '"') AS b FROM conversations)""")
def f16(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.question(F.concat(F.lit('"'), "text", F.lit('" ')))).alias("question_md5"))


@query("f17_filename", rf"""
    SELECT page_id, s AS filename, regexp_replace(s, '\.[^.]*$', '') AS stem FROM (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[/\\]', ' ', 'g'), '^{WS}|{WS}$', '', 'g'), '{WS}', '_', 'g'), '[^A-Za-z0-9_.\-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM pages)""")
def f17(spark, sf):
    d = table(spark, sf, "pages").select("page_id", X.secure_filename(F.col("url")).alias("filename"))
    return d.withColumn("stem", X.stem(F.col("filename")))


@query("f18_durations", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id")
def f18(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(X.seconds_between(F.min("ts"), F.max("ts")).alias("seconds"))


@query("f19_base64", "SELECT item_id, md5(to_base64(encode(text))) AS b64_md5 FROM benchmark")
def f19(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(X.base64(F.encode("text", "UTF-8"))).alias("b64_md5"))


@query("f20_content_groups", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY substring(text, 1, 300)")
def f20(spark, sf):
    """Groups on the string itself, never on a hash of it."""
    return table(spark, sf, "documents").groupBy(X.prefix(F.col("text"), 300).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).drop("key")


@query("f21_p3_admissible", rf"""
    WITH s AS (SELECT url AS start_url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS base FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) ORDER BY length(url), url) = 1)
    SELECT p.page_id, starts_with({sql_path('p.url')}, regexp_replace({sql_path('s.start_url')}, '/+$', ''))
        AND NOT regexp_matches({sql_path('p.url')}, '(?i)({"|".join(x.replace(".", chr(92) + ".") for x in U.STATIC)})$') AS admissible, starts_with(p.url, s.base) AS in_domain
    FROM pages p JOIN s ON s.base = regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)""")
def f21(spark, sf):
    """Each page against the shortest URL of its site as start."""
    p = table(spark, sf, "pages").select("page_id", "url", U.base(F.col("url")).alias("base"))
    start = p.groupBy("base").agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("start"))
    p = p.join(start, "base")
    return p.select("page_id", U.admissible(F.col("url"), F.col("start")).alias("admissible"), F.startswith("url", "base").alias("in_domain"))
