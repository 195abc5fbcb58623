"""The crawl with a budget against a plain queue."""

import random
from collections import deque

import pytest

from corvex.sources.frontier import crawl_summary, crawl_within_budget


def norm(u):
    return u.split("#")[0].rstrip("/")


def queue_model(links, root, sitemap, max_pages, max_depth, concurrency):
    """links: those of each stored page, by normalised address."""
    queue, seen, out, results, batch_no = deque([(norm(u), 1) for u in sitemap] + [(norm(root), 0)]), set(), [], 0, 0
    fine = lambda u: u.startswith(norm(root)) and not u.endswith(".pdf")
    while queue and results < max_pages:
        batch = []
        while queue and len(batch) < concurrency:
            u, depth = queue.popleft()
            if u not in seen and fine(u):
                seen.add(u)
                batch.append((u, depth))
        if not batch:
            break
        for u, depth in batch:
            out.append((u, depth, len(out), batch_no, u in links))
            if u in links:
                results += 1
                if depth < max_depth:
                    queue.extend((norm(x), depth + 1) for x in links[u] if norm(x) not in seen and fine(norm(x)))
        batch_no += 1
    return out


def pages_of(spark, links):
    html = lambda xs: "".join(f'<p>two words<a class="k" href="{x}"></a></p>' for x in xs) + "<img>"
    return spark.createDataFrame([(u, html(xs)) for u, xs in links.items()], "url string, html string")


def sites(seed):
    rng = random.Random(seed)
    out = {}
    for host in range(5):
        root, n = f"http://h{host}", [1, 3, 12, 40, 25][host]
        names = [root] + [f"{root}/p{i}" for i in range(n)]
        links = {}
        for u in names:
            xs = [rng.choice(names) + rng.choice(["", "#x", "/"]) for _ in range(rng.randrange(5))] + rng.choice([[], [f"{root}/gone{rng.randrange(9)}"], ["http://else/x"], [f"{root}/a.pdf"]])
            links[u] = xs
        for u in rng.sample(names[1:], n // 4):
            links.pop(u)  # linked, but not stored
        out[root] = (links, [rng.choice(names) for _ in range(rng.choice([0, 0, 4, 9]))])
    return out


@pytest.mark.parametrize("seed,max_pages,max_depth,concurrency", [(1, 100, 5, 5), (2, 7, 3, 3), (3, 5, 5, 4), (4, 1, 2, 2), (5, 12, 4, 1), (6, 9, 3, 7)])
def test_against_a_queue(spark, seed, max_pages, max_depth, concurrency):
    given = sites(seed)
    pages = pages_of(spark, {u: xs for links, _ in given.values() for u, xs in links.items()})
    starts = spark.createDataFrame([(r, r + "/") for r in given], "base string, start string")
    maps = spark.createDataFrame([(r, u, i) for r, (_, m) in given.items() for i, u in enumerate(m)], "base string, url string, pos int")
    got = crawl_within_budget(pages, starts, maps, max_pages, max_depth, concurrency).collect()
    for root, (links, sitemap) in given.items():
        mine = sorted((tuple(r)[1:] for r in got if r.base == root), key=lambda r: r[2])
        assert mine == queue_model(links, root, sitemap, max_pages, max_depth, concurrency)


def test_last_batch_goes_beyond_the_budget_and_missing_pages_count_for_nothing(spark):
    links = {"http://h": [f"http://h/{i}" for i in range(10)]} | {f"http://h/{i}": [] for i in range(10) if i % 2}
    starts = spark.createDataFrame([("http://h", "http://h")], "base string, start string")
    got = crawl_within_budget(pages_of(spark, links), starts, None, 2, 5, 4)
    assert sorted((r.url, r.batch) for r in got.collect()) == [("http://h", 0), ("http://h/0", 1), ("http://h/1", 1), ("http://h/2", 1), ("http://h/3", 1)]
    rows = {r.depth: (r.visited, r.crawled, r.failed, r.words, r.images) for r in crawl_summary(got, pages_of(spark, links)).collect()}
    assert rows == {0: (1, 1, 0, 11, 1), 1: (4, 2, 2, 0, 2)}


def test_no_sites_and_no_pages(spark):
    pages, starts = pages_of(spark, {"http://h": []}), spark.createDataFrame([("http://h", "http://h")], "base string, start string")
    assert crawl_within_budget(pages, starts.limit(0)).isEmpty()
    assert [tuple(r) for r in crawl_within_budget(pages.limit(0), starts).collect()] == [("http://h", "http://h", 0, 0, 0, False)]
