"""Queries of the chunkers, of HTML extraction and of the crawl frontier, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import chunking as C
from ..operators import html as H
from ..registry import query, table
from ..sources import dumps as D
from ..sources.storage import shared_folder
from .text_queries import WS, sql_path, sql_slug, sql_host, sql_words

SQL_CHUNKS = f"""
    words_of AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
    chunks AS (
        SELECT doc_id, s // 462 + 1 AS page_number, array_to_string(w[s + 1:s + 512], ' ') AS content
        FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 462)) AS s FROM words_of WHERE len(w) > 0))"""


@query("c1_fixed_chunks", f"WITH {SQL_CHUNKS} SELECT doc_id, page_number, md5(content) AS content_md5, length(content) AS n FROM chunks")
def c1(spark, sf):
    c = C.chunk_documents(table(spark, sf, "documents"))
    return c.select("doc_id", "page_number", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n"))


def sql_wc(x: str) -> str:
    return f"len({sql_words(x)})"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def sql_paragraphs(x: str, at: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{at}'), lambda p: {sql_strip('p')}), lambda p: p <> '')"


@query("c4_c5_short_paragraphs", f"""
    WITH p AS (SELECT doc_id, {sql_paragraphs('text', chr(92) + 'n+')} AS p FROM documents),
    r AS (SELECT doc_id, len(p) AS n_paragraphs, list_reduce(list_transform(p, lambda x: {{'o': []::VARCHAR[], 'b': x}}),
        lambda a, x: CASE WHEN {sql_wc('a.b')} < 20 THEN {{'o': a.o, 'b': a.b || chr(10) || chr(10) || x.b}} ELSE {{'o': list_append(a.o, a.b), 'b': x.b}} END) AS s FROM p WHERE len(p) > 0)
    SELECT doc_id, n_paragraphs, len(s.o) + 1 AS n_merged, md5(array_to_string(list_append(s.o, s.b), '|')) AS merged_md5 FROM r""")
def c5(spark, sf):
    """Lines as paragraphs: the documents have no blank lines."""
    d = table(spark, sf, "documents").select("doc_id", C.paragraphs(F.col("text"), r"\n+").alias("p")).filter(F.size("p") > 0)
    d = d.withColumn("m", C.merge_short(F.col("p")))
    return d.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.size("m").cast("long").alias("n_merged"), F.md5(F.array_join("m", "|")).alias("merged_md5"))


SQL_HARD = f"list_transform(generate_series(0, {sql_wc('x')} - 1, 300), lambda i: array_to_string(({sql_words('x')})[i + 1:i + 300], ' '))"


@query("c7_sentence_packing", f"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    r AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: CASE WHEN {sql_wc('x')} > 300
            THEN {{'o': {SQL_HARD}, 'c': '', 'w': 0::BIGINT, 'n': 0::BIGINT, 'big': true}}
            ELSE {{'o': []::VARCHAR[], 'c': x, 'w': {sql_wc('x')}::BIGINT, 'n': 1::BIGINT, 'big': false}} END),
        lambda a, x: CASE
            WHEN x.big THEN {{'o': list_concat(CASE WHEN a.n > 0 THEN list_append(a.o, a.c) ELSE a.o END, x.o), 'c': '', 'w': 0::BIGINT, 'n': 0::BIGINT, 'big': false}}
            WHEN a.w + x.w > 300 AND a.n > 0 THEN {{'o': list_append(a.o, a.c), 'c': x.c, 'w': x.w, 'n': 1::BIGINT, 'big': false}}
            ELSE {{'o': a.o, 'c': CASE WHEN a.n > 0 THEN a.c || ' ' || x.c ELSE x.c END, 'w': a.w + x.w, 'n': a.n + 1, 'big': false}} END) AS s FROM s),
    f AS (SELECT doc_id, list_filter(CASE WHEN s.n > 0 THEN list_append(s.o, s.c) ELSE s.o END, lambda c: {sql_strip('c')} <> '') AS c FROM r)
    SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM f""")
def c7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.pack_sentences(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


def document_pages(spark, sf):
    """Documents as pages of a site: a title, a URL, and lines as paragraphs."""
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("https://Docs.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("markdown"))


def sql_join(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda q: q.t), chr(10) || chr(10))"


SQL_TAIL = "a.c[len(a.c) - len(list_filter(range(1, len(a.c) + 1), lambda j: list_sum(list_transform(a.c[len(a.c) - j + 1:], lambda q: q.n)) <= 50)) + 1:]"
SQL_FLUSHED = f"CASE WHEN len(a.c) > 0 THEN list_append(a.o, {sql_join('a.c')}) ELSE a.o END"
# The pages of document_pages() with lines as paragraphs: short ones whole, others through both folds; paragraphs of more
# than 300 words are packed by sentences on the way, as in c7_sentence_packing.
SQL_PAGES = f"""
    md AS (SELECT doc_id, 'https://Docs.example.org/' || source || '/' || doc_id AS u, {sql_strip('text')} AS t FROM documents WHERE text IS NOT NULL),
    open AS (SELECT * FROM (SELECT *, string_split(t, chr(10)) AS lines FROM md)
        WHERE t <> '' AND len(list_filter(lines, lambda s: regexp_matches(s, '^[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]*\\*?[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]*\\[.+\\]\\(.+\\)'))) / len(lines) <= 0.6),
    paras AS (SELECT doc_id, {sql_paragraphs('t', chr(92) + 'n+')} AS p FROM open WHERE {sql_wc('t')} > 250),
    short AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: {{'o': []::VARCHAR[], 'b': x}}),
        lambda a, x: CASE WHEN {sql_wc('a.b')} < 20 THEN {{'o': a.o, 'b': a.b || chr(10) || chr(10) || x.b}} ELSE {{'o': list_append(a.o, a.b), 'b': x.b}} END) AS s FROM paras WHERE len(p) > 0),
    merged AS (SELECT doc_id, unnest(generate_series(1, len(s.o) + 1)) AS i, unnest(list_append(s.o, s.b)) AS t FROM short),
    counted AS (SELECT doc_id, i, t, {sql_wc('t')}::BIGINT AS n FROM merged),
    sent AS (SELECT doc_id, i, string_split(regexp_replace(t, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM counted WHERE n > 300),
    pack AS (SELECT doc_id, i, list_reduce(list_transform(s, lambda x: CASE WHEN {sql_wc('x')} > 300
            THEN {{'o': {SQL_HARD}, 'c': '', 'w': 0::BIGINT, 'n': 0::BIGINT, 'big': true}}
            ELSE {{'o': []::VARCHAR[], 'c': x, 'w': {sql_wc('x')}::BIGINT, 'n': 1::BIGINT, 'big': false}} END),
        lambda a, x: CASE
            WHEN x.big THEN {{'o': list_concat(CASE WHEN a.n > 0 THEN list_append(a.o, a.c) ELSE a.o END, x.o), 'c': '', 'w': 0::BIGINT, 'n': 0::BIGINT, 'big': false}}
            WHEN a.w + x.w > 300 AND a.n > 0 THEN {{'o': list_append(a.o, a.c), 'c': x.c, 'w': x.w, 'n': 1::BIGINT, 'big': false}}
            ELSE {{'o': a.o, 'c': CASE WHEN a.n > 0 THEN a.c || ' ' || x.c ELSE x.c END, 'w': a.w + x.w, 'n': a.n + 1, 'big': false}} END) AS s FROM sent),
    packed AS (SELECT doc_id, i, list_filter(CASE WHEN s.n > 0 THEN list_append(s.o, s.c) ELSE s.o END, lambda c: {sql_strip('c')} <> '') AS big FROM pack),
    items AS (SELECT doc_id, list(CASE WHEN n > 300 THEN {{'o': big, 'c': []::STRUCT(t VARCHAR, n BIGINT)[], 'w': 0::BIGINT, 'big': true}}
        ELSE {{'o': []::VARCHAR[], 'c': [{{'t': t, 'n': n}}], 'w': n, 'big': false}} END ORDER BY i) AS l FROM counted LEFT JOIN packed USING (doc_id, i) GROUP BY doc_id),
    slid AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE
        WHEN x.big THEN {{'o': list_concat({SQL_FLUSHED}, x.o), 'c': []::STRUCT(t VARCHAR, n BIGINT)[], 'w': 0::BIGINT, 'big': false}}
        WHEN a.w + x.w > 300 AND len(a.c) > 0 THEN {{'o': {SQL_FLUSHED}, 'c': list_concat({SQL_TAIL}, x.c), 'w': (coalesce(list_sum(list_transform({SQL_TAIL}, lambda q: q.n)), 0) + x.w)::BIGINT, 'big': false}}
        ELSE {{'o': a.o, 'c': list_concat(a.c, x.c), 'w': a.w + x.w, 'big': false}} END) AS a FROM items),
    windows AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS k, unnest(w) AS body FROM (SELECT doc_id, {SQL_FLUSHED} AS w FROM slid)
        UNION ALL SELECT doc_id, 1, t FROM open WHERE {sql_wc('t')} <= 250)"""


@query("c2_c3_c6_c8_page_chunks", f"""
    WITH {SQL_PAGES} SELECT '[Document ' || doc_id || ']' || chr(10) || 'Source: ' || u || chr(10) || chr(10) || body AS content, k::BIGINT AS page_number, {sql_wc('body')} AS word_count,
        {sql_slug(sql_host('u') + ' || ' + sql_path('u'))} || '-c' || k AS chunk_id, u AS source_url, 'Document ' || doc_id AS page_title
    FROM windows JOIN open USING (doc_id) WHERE {sql_wc('body')} >= 60""")
def c6(spark, sf):
    """Sliding paragraph windows, a fold in a fold."""
    return C.chunk_pages(document_pages(spark, sf), r"\n+")


@query("p5_c2_single_chunks", f"""
    SELECT '[Document ' || doc_id || ']' || chr(10) || 'Source: ' || u || chr(10) || chr(10) || t AS content, 1::BIGINT AS page_number, {sql_wc('t')} AS word_count,
        {sql_slug(sql_host('u') + ' || ' + sql_path('u'))} || '-c1' AS chunk_id
    FROM (SELECT doc_id, {sql_strip('text')} AS t, 'https://Docs.example.org/' || source || '/' || doc_id AS u, string_split({sql_strip('text')}, chr(10)) AS lines FROM documents)
    WHERE {sql_wc('t')} BETWEEN 60 AND 250 AND len(list_filter(lines, lambda s: regexp_matches(s, '^[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]*\\*?[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]*\\[.+\\]\\(.+\\)'))) / len(lines) <= 0.6""")
def p5(spark, sf):
    """Short pages: one chunk, if it has 60 words."""
    pages = document_pages(spark, sf).filter(X.word_count(X.strip(F.col("markdown"))) <= C.SMALL_PAGE)
    return C.chunk_pages(pages, r"\n+").select("content", "page_number", "word_count", "chunk_id")


@query("p4_link_heavy", r"""
    SELECT page_id, len(list_filter(l, lambda s: regexp_matches(s, '^\s*\*?\s*\[.+\]\(.+\)'))) / len(l) > 0.6 AS link_heavy
    FROM (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', chr(10) || '[\2](\1)' || chr(10), 'g'), '<[^>]+>', '', 'g'), chr(10) || ' ' || chr(9)), chr(10)) AS l FROM pages)""")
def p4(spark, sf):
    md = F.regexp_replace(F.regexp_replace("html", r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "\n[$2]($1)\n"), "<[^>]+>", "")
    return table(spark, sf, "pages").select("page_id", (C.link_share(F.btrim(md, F.lit("\n \t"))) > 0.6).alias("link_heavy"))


def extracted(spark, sf, fallback: bool = True):
    return H.extracted(table(spark, sf, "pages").select("page_id", "url", "html"), fallback)


@query("s4_c9_html_to_markdown")
def c9(spark, sf):
    return extracted(spark, sf)


SQL_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)"


@query("c9_letters", f"""
    SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQL_ARTICLE}, '(?s)<(script|style|button|svg|noscript)[^>]*>.*?</(script|style|button|svg|noscript)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'),
        '&(amp|lt|gt|quot|nbsp);?|&[a-zA-Z0-9#]+;', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS letters_md5, len(regexp_extract_all({SQL_ARTICLE}, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all({SQL_ARTICLE}, '<li[^>]*>')) AS items
    FROM pages""")
def c9_letters(spark, sf):
    """Every letter and digit of the article and no other, and as many headings and items, stand in the markdown."""
    letters = F.regexp_replace(F.regexp_replace("markdown", r"\]\([^)]*\)", "]"), r"[^\p{L}\p{N}]+", "")
    lines = F.split("markdown", "\n")
    count = lambda pattern: F.size(F.filter(lines, lambda s: s.rlike(pattern))).cast("long")
    return extracted(spark, sf, fallback=False).select("page_id", F.md5(letters).alias("letters_md5"), count("^#{1,6} ").alias("headings"), count("^ *- ").alias("items"))


@query("c9_crawl_chunks")
def crawl_chunks(spark, sf):
    return C.chunk_pages(extracted(spark, sf))


@query("s4_word_totals", f"SELECT page_id, {sql_wc('t')} AS words, length(t) AS chars, {sql_wc('t')} < 30 AS fallback FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages)")
def s4(spark, sf):
    """K10, too: words and characters of a page's text, and whether the fallback extraction is due."""
    t = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]+>", " ").alias("t"))
    return t.select("page_id", X.word_count(F.col("t")).cast("long").alias("words"), F.length("t").cast("long").alias("chars"), (X.word_count(F.col("t")) < 30).alias("fallback"))


def sql_raw_markdown(x: str) -> str:
    put = lambda pattern, new: f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    for tag in H.SILENT:
        x = put(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "' '")
    x = put("(?s)<!--.*?-->", "' '")
    x = put(r"[\x09-\x0d\x20]+", "' '")
    x = put(r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', r"'[\2](\1)'")
    for n in range(1, 7):
        x = put(rf"(?i)<h{n}\b[^>]*>", f"chr(10) || chr(10) || '{'#' * n} '")
    x = put(r"(?i)<li\b[^>]*>", "chr(10) || '- '")
    x = put(rf"(?i)</?({'|'.join(H.LINE_TAGS)})\b[^>]*>", "chr(10)")
    x = put("<[^>]*>", "''")
    for name, char in H.ENTITIES.items():
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    x = put(" *\\n *", "chr(10)")
    x = put("\\n{3,}", "chr(10) || chr(10)")
    return f"trim({x}, ' ' || chr(10))"


SQL_CLEANED = r"""
    raw AS MATERIALIZED (SELECT page_id, url, html, RAW AS md FROM pages),
    kept AS (SELECT page_id, list_filter(string_split(md, chr(10)), lambda s: NOT regexp_matches(trim(s), '^\[.{1,40}\]\(.*\)$')) AS l FROM raw),
    folded AS (SELECT page_id, list_reduce(list_prepend({'o': []::VARCHAR[], 's': '', 'k': false}, list_transform(l, lambda s: {'o': []::VARCHAR[], 's': s, 'k': false})), lambda a, x:
        CASE WHEN (CASE WHEN regexp_matches(x.s, '(?i)^#+\s*(on this page|table of contents|contents)') THEN true WHEN regexp_matches(x.s, '^#+\s') THEN false ELSE a.k END)
        THEN {'o': a.o, 's': '', 'k': true} ELSE {'o': list_append(a.o, x.s), 's': '', 'k': false} END) AS s FROM kept),
    fit AS (SELECT page_id, regexp_replace(trim(array_to_string(s.o, chr(10)), ' ' || chr(10) || chr(9)), '\n{3,}', chr(10) || chr(10), 'g') AS fit FROM folded)""".replace("RAW", sql_raw_markdown("html"))


@query("s4_fallback_markdown", f"""
    WITH {SQL_CLEANED} SELECT page_id, md5(md) AS raw_md5, md5(CASE WHEN page_id % 2 = 0 AND md <> '' THEN fit ELSE repeat('word ', 30) END) AS markdown_md5 FROM raw JOIN fit USING (page_id)""")
def s4_fallback(spark, sf):
    """All text of every page, and what a page gets whose content has 29 words (even ids) or 30."""
    p = table(spark, sf, "pages")
    content = F.repeat(F.lit("word "), F.when(F.col("page_id") % 2 == 0, 29).otherwise(30).cast("int"))
    return p.select("page_id", F.md5(H.raw_markdown(F.col("html"))).alias("raw_md5"), F.md5(H.page_markdown(content, F.col("html"))).alias("markdown_md5"))


@query("k10_page_dumps", f"""
    WITH {SQL_CLEANED},
    named AS (SELECT page_id, url, html, md, fit, coalesce(nullif({sql_slug(sql_host('url') + ' || ' + sql_path('url'))}, ''), 'page') AS slug,
        coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif({sql_path('url')}, ''), url) AS title FROM raw JOIN fit USING (page_id)),
    kinds AS (SELECT *, unnest(['fit', 'raw', 'html']) AS kind, unnest([fit, md, html]) AS text FROM named)
    SELECT url, slug || '__' || kind || CASE WHEN kind = 'html' THEN '.html' ELSE '.md' END AS name, kind, {sql_wc('text')} AS words, length(text) AS chars,
        md5(CASE WHEN kind = 'html' THEN text ELSE '# ' || title || chr(10) || 'Source: ' || url || chr(10) || 'Method: ' || kind || chr(10) || 'Words: ' || {sql_wc('text')} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text END) AS body_md5
    FROM kinds""")
def k10(spark, sf):
    """Every page written out as HTML, as all its text and as that text cleaned, and read back."""
    title = H.page_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1), U.path(F.col("url")), F.col("url"))
    pages = table(spark, sf, "pages").select("url", "html", title.alias("title"), H.raw_markdown(F.col("html")).alias("raw"))
    path = shared_folder(spark, "dumps")
    D.write_dumps(pages, {"fit": H.clean_fallback(F.col("raw")), "raw": F.col("raw"), "html": F.col("html")}, path)
    return D.read_dumps(spark, path).select("url", "name", "kind", "words", "chars", F.md5("body").alias("body_md5"))


@query("c10_clean_fallback", r"""
    WITH l AS (SELECT doc_id, list_filter(string_split('# Contents' || chr(10) || '[a](b)' || chr(10) || '## ' || text || chr(10) || '[x](y)', chr(10)), lambda s: NOT regexp_matches(trim(s), '^\[.{1,40}\]\(.*\)$')) AS l FROM documents),
    r AS (SELECT doc_id, list_reduce(list_prepend({'o': []::VARCHAR[], 's': '', 'k': false}, list_transform(l, lambda s: {'o': []::VARCHAR[], 's': s, 'k': false})), lambda a, x:
        CASE WHEN (CASE WHEN regexp_matches(x.s, '(?i)^#+\s*(on this page|table of contents|contents)') THEN true WHEN regexp_matches(x.s, '^#+\s') THEN false ELSE a.k END)
        THEN {'o': a.o, 's': '', 'k': true} ELSE {'o': list_append(a.o, x.s), 's': '', 'k': false} END) AS s FROM l)
    SELECT doc_id, md5(regexp_replace(trim(array_to_string(s.o, chr(10)), ' ' || chr(10) || chr(9)), '\n{3,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM r""")
def c10(spark, sf):
    md = F.concat(F.lit("# Contents\n[a](b)\n## "), "text", F.lit("\n[x](y)"))
    return table(spark, sf, "documents").select("doc_id", F.md5(H.clean_fallback(md)).alias("clean_md5"))


@query("c11_table_markdown", """
    SELECT n_regionkey AS region, chr(10) || '### Region ' || n_regionkey || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
        || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""")
def c11(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name")))).alias("r"))
    rows = rows.withColumn("r", F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    caption = F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))
    return rows.select(F.col("n_regionkey").alias("region"), H.table_markdown(caption, F.array(F.lit("key"), F.lit("name")), F.col("r")).alias("md"))


@query("c12_title", f"""
    SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END, ''), nullif({sql_path('url')}, ''), url) AS title FROM pages""")
def c12(spark, sf):
    """Every third page as if it had no title."""
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf, "pages").select("page_id", H.page_title(title, U.path(F.col("url")), F.col("url")).alias("title"))


SQL_BASE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"


@query("c13_links", f"""
    SELECT page_id, url, {SQL_BASE} || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/')""")
def c13(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.explode(H.hrefs(F.col("html"))).alias("href")).filter(F.startswith("href", F.lit("/")))
    return p.select("page_id", "url", U.resolved(F.col("url"), F.col("href")).alias("link"))
