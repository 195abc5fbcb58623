"""Sitemaps as a data source: addresses, the parts that a filter on host reads, and indexes followed."""

from corvex.sources.sitemaps import locations, pages_of_sitemaps, sitemap_entries, store_sitemaps

SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*urls):
    return f"<urlset {SPACE}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*maps):
    return "<x:sitemapindex xmlns:x='urn:x'>" + "".join(f"<x:sitemap><x:loc>{m}</x:loc></x:sitemap>" for m in maps) + "</x:sitemapindex>"


def test_locations():
    xml = f"<?xml version='1.0'?><urlset {SPACE} xmlns:i='urn:i'><url><loc>\n http://a/?x=1&amp;y </loc><lastmod>2024-01-02</lastmod><i:image><i:loc>http://a/i.png</i:loc></i:image></url><url/></urlset>"
    assert list(locations(xml)) == [("page", "http://a/?x=1&y", "2024-01-02")]
    assert list(locations(index("http://a/1", "http://a/2"))) == [("sitemap", "http://a/1", None), ("sitemap", "http://a/2", None)]
    assert list(locations(None)) == list(locations("")) == list(locations("no xml")) == list(locations("<html><url><loc>x</loc></url></html>")) == []
    many = [f"http://a/{i}" for i in range(20_000)]
    assert [u for _, u, _ in locations(urlset(*many))] == many
    assert [u for _, u, _ in locations(urlset(*many)[:-9])] == many  # broken off


def stored_hosts(spark, tmp_path):
    rows = [(f"h{i:02d}", f"http://h{i:02d}/map.xml", urlset(f"http://h{i:02d}/a", f"http://h{i:02d}/b")) for i in range(40)]
    rows += [("h07", f"http://h07/map-{j}.xml", urlset(f"http://h07/{j}")) for j in range(20)] + [(None, "odd", urlset("http://odd/"))]
    path = f"file://{tmp_path}/maps"
    store_sitemaps(spark.createDataFrame(rows, "host string, sitemap string, xml string"), path, 10)
    return sitemap_entries(spark, path)


def test_filter_on_host_reads_its_parts(spark, tmp_path):
    e = stored_hosts(spark, tmp_path)
    assert e.count() == 101
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(e) >= 8
    one = e.filter("host = 'h31'")
    assert {r.loc for r in one.collect()} == {"http://h31/a", "http://h31/b"} and parts(one) <= 2
    assert e.filter("host = 'h07'").count() == 22
    assert e.filter("host IN ('h00', 'h39') AND kind = 'page'").count() == 4
    assert e.filter("host = 'h00' AND host = 'h01'").count() == 0 and e.filter("host = 'nobody'").count() == 0
    assert e.filter("host IS NULL").count() == 1 and e.filter("loc LIKE '%/a'").count() == 40


def test_indexes_are_followed(spark, tmp_path):
    b = "http://s"
    files = [
        ("s", f"{b}/top", index(f"{b}/top", f"{b}/one", f"{b}/gone")),
        ("s", f"{b}/one", index(f"{b}/two")),
        ("s", f"{b}/two", urlset(f"{b}/p", "http://elsewhere/p").replace(f"{b}/p</loc>", f"{b}/p</loc><lastmod>2024-02-01</lastmod>")),
        ("s", f"{b}/deep", urlset(f"{b}/never")),
        ("s", f"{b}/broken", None),
    ]
    path = f"file://{tmp_path}/maps"
    store_sitemaps(spark.createDataFrame(files, "host string, sitemap string, xml string"), path, 2)
    roots = spark.createDataFrame([(b, f"{b}/top"), (b, f"{b}/broken")], "base string, sitemap string")
    e = sitemap_entries(spark, path)
    assert [tuple(r) for r in pages_of_sitemaps(e, roots).collect()] == [(b, f"{b}/p", "2024-02-01")]
    assert pages_of_sitemaps(e, roots, 1).isEmpty()


def test_no_sitemaps(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    store_sitemaps(spark.createDataFrame([], "host string, sitemap string, xml string"), path, 2)
    assert sitemap_entries(spark, path).isEmpty()
