"""A crawl with a page budget over stored pages: first in, first out, in batches, for all sites at once.

A queue that skips what it has seen visits each address in the order in which it was first queued,
and that is: the sitemap's addresses, the root, then the links of every page in turn. So generations
(the links of the pages of the generation before) follow each other, and an address has its number
in the queue by its parent's number and its place on the parent's page. Only where a site stops
depends on batches, as the budget is tested between them; their starts within a generation are an
arithmetic progression, and the first start in the next one depends on how many addresses were
queued when the last batch began. So a generation is a few joins and aggregates, however many sites
it has and however large one of them is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.relational import ordinal
from .storage import remove, shared_folder, stored

MAX_PAGES, MAX_DEPTH, CONCURRENCY = 100, 5, 5


def page_links(pages: DataFrame) -> DataFrame:
    """url, pos, to: the addresses that a page links to with their first place on it. pages: url (normalised), html."""
    links = F.regexp_extract_all("html", F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))
    each = pages.select("url", F.posexplode(links).alias("pos", "href"))
    return each.select("url", "pos", U.normalised(U.resolved(F.col("url"), F.col("href"))).alias("to")).groupBy("url", "to").agg(F.min("pos").alias("pos"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows of each site numbered from 0 in an order, without a task that sees a whole site."""
    rows = ordinal(rows, ["base", *order], "__at")
    first = rows.groupBy("base").agg(F.min("__at").alias("__first"))
    return rows.join(first, "base").withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first")


def crawl_within_budget(
    pages: DataFrame, starts: DataFrame, sitemap: DataFrame | None = None, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, concurrency: int = CONCURRENCY
) -> DataFrame:
    """base, url, depth, place, batch, crawled: every address that is visited, in order of place (from 0) within its site.

    pages: url, html. starts: base, start, one row a site. sitemap: base, url, pos, queued in order
    of pos at depth 1 before the root at depth 0. Addresses that are not stored are visited and
    fail: crawled is false and they have no links. A site's crawl ends when nothing is queued or, between
    two batches of at most `concurrency` addresses, when max_pages pages are crawled; the last batch
    may go beyond. Links of pages at max_depth are not followed. Of pages whose normalised addresses
    are equal, the first address's is read.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "frontier")
    save = lambda df, name: stored(df, f"{path}/{name}")
    one = pages.groupBy(U.normalised(F.col("url")).alias("url")).agg(F.min_by("html", "url").alias("html"))
    edges = save(page_links(one), "links")
    there = save(one.select("url"), "there")

    roots = starts.select("base", "start", U.normalised(F.col("start")).alias("url"), F.lit(1).cast("long").alias("parent"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"))
    seeds = roots
    if sitemap is not None:
        named = sitemap.join(starts.select("base", "start"), "base")
        seeds = seeds.unionByName(named.select("base", "start", U.normalised(F.col("url")).alias("url"), F.lit(0).cast("long").alias("parent"), F.col("pos").cast("long").alias("pos"), F.lit(1).alias("depth")))
    queued = seeds.filter(U.admissible(F.col("url"), F.col("start")))

    # A site's state before a generation: its first place a, where the next batch starts s, batches and pages before, and where it stops.
    nothing = F.lit(0).cast("long")
    state = starts.select("base", nothing.alias("a"), nothing.alias("s"), nothing.alias("batches"), nothing.alias("results"), F.lit(None).cast("long").alias("stop"), F.lit(False).alias("waits"))
    levels, done = [], []
    for g in range(max_depth + 2):
        first = queued.groupBy("base", "start", "url").agg(F.min(F.struct("parent", "pos", "depth")).alias("x")).select("base", "start", "url", "x.*")
        if levels:
            first = first.join(reduce(DataFrame.unionByName, (v.select("base", "url") for v in levels)), ["base", "url"], "left_anti")
        level = numbered(first, ["parent", "pos"], "i").join(there.withColumn("crawled", F.lit(True)), "url", "left").withColumn("crawled", F.coalesce("crawled", F.lit(False)))
        level = save(level, f"level-{g}")
        # Where a batch that began in the generation before ended; a site that was waiting for that stops there.
        if g:
            early = level.join(state.select("base", "last"), "base").groupBy("base").agg(F.count_if(F.col("parent") < F.col("last")).alias("early"))
            state = state.join(early, "base", "left").withColumn("s", F.when(F.col("last").isNull(), F.col("s")).otherwise(F.least(F.col("last") + concurrency, F.col("a") + F.coalesce("early", F.lit(0)))))
            state = state.withColumn("stop", F.when(F.col("waits"), F.col("s")).otherwise(F.col("stop")))
        size = level.groupBy("base").agg(F.count("*").alias("n"), F.count_if("crawled").alias("ok"))
        state = save(state.join(size, "base", "left").fillna(0, ["n", "ok"]), f"state-{g}")
        placed = level.join(state.select("base", "a", "s", "batches", "results", "stop"), "base").withColumn("place", F.col("a") + F.col("i"))
        placed = placed.withColumn("batch", F.when(F.col("place") >= F.col("s"), F.col("batches") + F.floor((F.col("place") - F.col("s")) / concurrency)).otherwise(F.col("batches") - 1))
        levels.append(placed.select("base", "start", "url", "depth", "place", "batch", "crawled"))
        # The page that fills the budget, if it is in this generation.
        reached = state.filter(F.col("stop").isNull() & (F.col("results") < max_pages) & (F.col("results") + F.col("ok") >= max_pages)).select("base", (max_pages - F.col("results") - 1).alias("nth"))
        full = numbered(placed.filter("crawled").join(reached, "base").select("base", "nth", "place"), ["place"], "k").filter("k = nth").select("base", (F.col("place") + 1).alias("p"))
        end = F.col("a") + F.col("n")
        starts_here = F.greatest(F.ceil((end - F.col("s")) / concurrency), F.lit(0))
        state = state.join(full, "base", "left")
        # The first start at p or later; one that is not in this generation is known with the next.
        after = F.when(F.col("p") <= F.col("s"), F.col("s")).otherwise(F.col("s") + F.ceil((F.col("p") - F.col("s")) / concurrency) * concurrency)
        waits = F.col("p").isNotNull() & (after >= end) & (F.col("p") > F.col("s"))
        last = F.when(starts_here > 0, F.col("s") + (starts_here - 1) * concurrency)
        state = state.select(
            "base", end.alias("a"), F.greatest(end, F.col("s")).alias("s"), (F.col("batches") + starts_here).alias("batches"), (F.col("results") + F.col("ok")).alias("results"),
            F.when(F.col("p").isNotNull() & ~waits, after).otherwise(F.col("stop")).alias("stop"), waits.alias("waits"), last.alias("last"), (F.col("n") > 0).alias("goes_on"),
        )
        state = save(state, f"after-{g}")
        done.append(g)
        more = state.filter(F.col("goes_on") & F.col("stop").isNull()).select("base")
        follow = placed.filter(F.col("crawled") & (F.col("depth") < max_depth)).join(more, "base", "left_semi")
        queued = follow.join(edges.withColumnRenamed("pos", "at"), "url").select("base", "start", F.col("to").alias("url"), F.col("place").alias("parent"), F.col("at").cast("long").alias("pos"), (F.col("depth") + 1).alias("depth"))
        queued = save(queued.filter(U.admissible(F.col("url"), F.col("start"))), f"queued-{g}")
        if queued.isEmpty() and state.filter("waits").isEmpty():
            break
    visited = reduce(DataFrame.unionByName, levels).join(state.select("base", "stop"), "base")
    out = save(visited.filter(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).select("base", "url", "depth", "place", "batch", "crawled"), "visited")
    for name in ("links", "there", *(f"{kind}-{g}" for g in done for kind in ("level", "state", "after", "queued"))):
        remove(spark, f"{path}/{name}")
    return out


def crawl_summary(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """base, depth, visited, crawled, failed, words, images: a crawl by site and depth. Words are those of the pages' text without tags."""
    from ..functions.text import strip_tags, word_count

    one = pages.groupBy(U.normalised(F.col("url")).alias("url")).agg(F.min_by("html", "url").alias("html"))
    sizes = one.select("url", word_count(strip_tags(F.col("html"))).cast("long").alias("w"), F.regexp_count("html", F.lit("<img")).cast("long").alias("i"))
    rows = visited.join(sizes, "url", "left").groupBy("base", "depth")
    return rows.agg(F.count("*").alias("visited"), F.count_if("crawled").alias("crawled"), F.count_if(~F.col("crawled")).alias("failed"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.coalesce(F.sum("i"), F.lit(0)).alias("images"))
