"""Queries of the crawl with a page budget, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..registry import query, table
from ..sources import frontier as R
from ..sources import sitemaps as M
from ..sources import storage as S
from .catalog_queries import SQL_NORM, sites
from .chunk_queries import SQL_BASE, sql_wc
from .text_queries import sql_path

#: Few pages a site, as the given tables have few.
PAGES, DEPTH, CONCURRENCY = 3, 2, 2
SQL_STATIC = "|".join(x.replace(".", "\\.") for x in U.STATIC)


def sql_allowed(u: str, start: str) -> str:
    return f"starts_with({u}, {SQL_BASE.replace('url,', start + ',')}) AND starts_with({sql_path(u)}, regexp_replace({sql_path(start)}, '/+$', '')) AND NOT regexp_matches({sql_path(u)}, '(?i)({SQL_STATIC})$')"


#: A queue for each site, one visit a step: seq is what has ever been queued, once each; a batch's end is set where it starts.
SQL_QUEUE = f"""
    n AS (SELECT url, arg_min(html, raw) AS html FROM (SELECT {SQL_NORM.format('url')} AS url, url AS raw, html FROM pages) GROUP BY url),
    e AS (SELECT url AS src, pos, {SQL_NORM.format("CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href END")} AS dst
        FROM (SELECT url, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (SELECT url, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM n)) WHERE starts_with(href, '/') OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')),
    s AS (SELECT base, arg_min(url, (length(url), url)) AS start FROM (SELECT {SQL_BASE} AS base, url FROM pages) GROUP BY base),
    m AS (SELECT base, start, {SQL_NORM.format('url')} AS url, page_id AS pos, 1 AS depth FROM (SELECT {SQL_BASE} AS base, url, page_id FROM pages WHERE page_id % 3 <> 0) JOIN s USING (base)
        UNION ALL SELECT base, start, {SQL_NORM.format('start')}, 1000000000000, 0 FROM s),
    q AS (SELECT base, start, list({{'url': url, 'depth': depth}} ORDER BY pos) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY base, url ORDER BY pos) AS r FROM m WHERE {sql_allowed('url', 'start')}) WHERE r = 1 GROUP BY ALL),
    l AS (SELECT base, url, list(dst ORDER BY pos) AS links FROM (SELECT s.base, s.start, e.src AS url, e.dst, min(pos) AS pos FROM s JOIN e ON starts_with(e.src, s.base) GROUP BY ALL) WHERE {sql_allowed('dst', 'start')} GROUP BY ALL),
    w AS (
        SELECT base, start, seq, 0 AS pos, 0 AS batch_end, 0 AS results, -1 AS batch FROM q
        UNION ALL
        SELECT t.base, start, CASE WHEN n.url IS NOT NULL AND cur.depth < {DEPTH} THEN list_concat(seq, list_transform(list_filter(coalesce(links, []), lambda x: NOT list_contains(list_transform(seq, lambda y: y.url), x)), lambda x: {{'url': x, 'depth': cur.depth + 1}})) ELSE seq END,
            pos + 1, ending, results + (n.url IS NOT NULL)::INTEGER, batch + (pos = batch_end)::INTEGER
        FROM (SELECT *, seq[pos + 1] AS cur, CASE WHEN pos = batch_end THEN least(pos + {CONCURRENCY}, len(seq)) ELSE batch_end END AS ending FROM w WHERE pos < len(seq) AND NOT (pos = batch_end AND results >= {PAGES})) t
        LEFT JOIN n ON n.url = cur.url LEFT JOIN l ON l.base = t.base AND l.url = cur.url),
    visited AS (SELECT w.base, seq[pos].url AS url, seq[pos].depth AS depth, pos - 1 AS place, batch, n.url IS NOT NULL AS crawled FROM w LEFT JOIN n ON n.url = seq[pos].url WHERE pos > 0)"""


def visited(spark, sf):
    """A site's sitemap names two pages in three, in order of page_id."""
    p = table(spark, sf, "pages")
    sitemap = p.filter("page_id % 3 <> 0").select(U.base(F.col("url")).alias("base"), "url", F.col("page_id").alias("pos"))
    return R.crawl_within_budget(p, sites(spark, sf), sitemap, PAGES, DEPTH, CONCURRENCY)


@query("s3_budgeted_crawl", f"WITH RECURSIVE {SQL_QUEUE} SELECT base, url, depth, place, batch, crawled FROM visited")
def s3(spark, sf):
    """J8, too."""
    return visited(spark, sf)


@query("a7_crawl_depths", f"""WITH RECURSIVE {SQL_QUEUE}, x AS (SELECT url, {sql_wc("regexp_replace(html, '<[^>]+>', '', 'g')")} AS w, len(regexp_extract_all(html, '<img')) AS i FROM n)
    SELECT base, depth, count(*) AS visited, count(*) FILTER (crawled) AS crawled, count(*) FILTER (NOT crawled) AS failed, coalesce(sum(w), 0)::BIGINT AS words, coalesce(sum(i), 0)::BIGINT AS images FROM visited LEFT JOIN x USING (url) GROUP BY ALL""")
def a7(spark, sf):
    return R.crawl_summary(visited(spark, sf), table(spark, sf, "pages"))


def sitemap_files(pages):
    """host, sitemap, xml: for each site an index of indexes of sitemaps of up to 1000 pages, with a foreign address in each."""
    p = pages.filter("url IS NOT NULL").select("page_id", "url", U.base(F.col("url")).alias("base"), U.host(F.col("url")).alias("host"))
    name = lambda prefix, size: F.concat("base", F.lit(f"/{prefix}-"), F.floor(F.col("page_id") / size).cast("string"), F.lit(".xml"))
    p = p.withColumn("leaf", name("map", 1000)).withColumn("middle", name("index", 1000000))
    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"))
    url = F.concat(F.lit("<url><loc> "), escaped, F.lit(" </loc><lastmod>"), day, F.lit("</lastmod></url>"))

    def tagged(rows, by, kind, entry):
        open_, close = f'<?xml version="1.0"?><{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', f"</{kind}>"
        return rows.groupBy("host", "base", *by).agg(F.concat(F.lit(open_), F.array_join(F.collect_list(entry), ""), F.lit(close)).alias("xml"))

    below = lambda c: F.concat(F.lit("<sitemap><loc>"), F.col(c), F.lit("</loc></sitemap>"))
    leaves = tagged(p, ["leaf", "middle"], "urlset", url)
    leaves = leaves.withColumn("xml", F.replace("xml", F.lit("</urlset>"), F.lit("<url><loc>http://elsewhere.example/x</loc></url></urlset>")))
    middles = tagged(leaves.select("host", "base", "leaf", "middle"), ["middle"], "sitemapindex", below("leaf"))
    tops = tagged(middles.select("host", "base", "middle"), [], "sitemapindex", below("middle")).withColumn("sitemap", F.concat("base", F.lit("/sitemap.xml")))
    files = tops.select("host", "sitemap", "xml").unionByName(middles.select("host", F.col("middle").alias("sitemap"), "xml"))
    return files.unionByName(leaves.select("host", F.col("leaf").alias("sitemap"), "xml"))


@query("s6_sitemap_source", f"SELECT {SQL_BASE} AS base, url, max('2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0')) AS lastmod FROM pages WHERE url IS NOT NULL GROUP BY ALL")
def s6_source(spark, sf):
    """Sitemaps of all pages (S5's /sitemap.xml at the top), stored by host and read as a data source."""
    p = table(spark, sf, "pages")
    path = S.shared_folder(spark, "sitemap-files")
    M.store_sitemaps(sitemap_files(p), path, 2 * spark.sparkContext.defaultParallelism)
    roots = p.filter("url IS NOT NULL").select(U.base(F.col("url")).alias("base")).distinct().withColumn("sitemap", F.concat("base", F.lit("/sitemap.xml")))
    return M.pages_of_sitemaps(M.sitemap_entries(spark, path), roots)
