from pyspark.sql import functions as F

from gleanery.operators import discovery as D
from gleanery.operators import ordering as O
from gleanery.plans.crawl import crawl_sites
from gleanery.sources import responses as R
from gleanery.sources import sitemaps as S

URLSET = """<?xml version="1.0" encoding="UTF-8"?>
<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"
        xmlns:video="http://www.google.com/schemas/sitemap-video/1.1">
  <url><loc> https://harbor.test/tide-low </loc><lastmod>2019-11-07</lastmod><changefreq>Hourly</changefreq><priority>0.65</priority>
    <image:image><image:loc>https://harbor.test/i.png</image:loc><image:caption>c</image:caption></image:image>
    <image:image><image:caption>no loc</image:caption></image:image>
    <video:video><video:title>v</video:title><video:duration>x1</video:duration></video:video><video:video/></url>
  <url><loc>https://harbor.test/tide-high</loc><lastmod>2020-02-29</lastmod><changefreq>yearly</changefreq><priority>bad</priority></url>
  <url><lastmod>2021-06-30</lastmod></url>
</urlset>"""
INDEX = """<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<sitemap><loc>https://harbor.test/north.xml</loc></sitemap><sitemap><loc>https://harbor.test/south.xml/</loc></sitemap>
<sitemap><loc>https://harbor.test/west.xml</loc><lastmod>2018-03-04</lastmod></sitemap></sitemapindex>"""
ROBOTS = "User-agent: *\r\nSitemap: https://harbor.test/sitemap.xml\n  SITEMAP:https://harbor.test/sitemap_boats.xml \n#sitemap: no\nDisallow: /"


def sm(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "sitemap_url string, body string")


def test_scan_sitemap(spark):
    rows = S.scan_sitemap(sm(spark, URLSET, INDEX, "<urlset><url><loc>cut", "junk", None)).orderBy("pos").collect()
    assert [(r.loc, r.lastmod, r.changefreq, r.priority) for r in rows] == [
        ("https://harbor.test/tide-low", "2019-11-07", "hourly", 0.65), ("https://harbor.test/tide-high", "2020-02-29", "yearly", None),
    ]
    assert [i.asDict() for i in rows[0].images] == [
        {"loc": "https://harbor.test/i.png", "caption": "c", "geo_location": None, "title": None, "license": None}
    ]
    assert [(v.title, v.duration) for v in rows[0].videos] == [("v", None)] and rows[1].images == []


def test_prefixes_count_by_their_namespace(spark):
    other = URLSET.replace("image:", "pic:").replace(":image=", ":pic=").replace("video:", "v.1:").replace(":video=", ":v.1=")
    for tag in ("urlset", "url", "loc", "lastmod", "changefreq", "priority"):
        other = other.replace(f"<{tag}", f"<sm:{tag}").replace(f"</{tag}", f"</sm:{tag}")
    other = other.replace("xmlns=", "xmlns:sm=")
    index = INDEX.replace("<s", "<m:s").replace("</s", "</m:s").replace("<l", "<m:l").replace("</l", "</m:l").replace("xmlns=", "xmlns:m=")
    plain = S.scan_sitemap(sm(spark, URLSET, index)).drop("sitemap_url").orderBy("pos").collect()
    assert len(plain) == 2 and plain[0].images and S.scan_sitemap(sm(spark, other)).drop("sitemap_url").orderBy("pos").collect() == plain
    assert len(S.scan_sitemap_index(sm(spark, index)).collect()) == 3


def test_normalized_locations_keep_the_frequency_as_written(spark):
    row = S.scan_sitemap(sm(spark, "<urlset><url><loc>HTTPS://e.org/a/?x</loc><changefreq>Hourly</changefreq></url></urlset>"), normalize_loc=True).first()
    assert (row.loc, row.changefreq) == ("https://e.org/a", "Hourly")


def test_scan_index_and_robots(spark):
    children = S.scan_sitemap_index(sm(spark, INDEX, URLSET)).orderBy("pos").collect()
    assert [c.child_url for c in children] == ["https://harbor.test/north.xml", "https://harbor.test/south.xml", "https://harbor.test/west.xml"]
    robots = spark.createDataFrame([("u", ROBOTS)], "url string, body string")
    assert [r.sitemap_url for r in S.scan_robots(robots).collect()] == [
        "https://harbor.test/sitemap.xml", "https://harbor.test/sitemap_boats.xml",
    ]


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, status int, content_type string, body string")


def test_discovery_is_a_set(spark):
    found = D.discover_sitemaps(
        spark.createDataFrame([("https://harbor.test",)], "base_url string"),
        responses(
            spark, ("https://harbor.test/sitemap.xml", 200, "text/xml; charset=utf-8", ""),
            ("https://harbor.test/sitemap_index.xml", 404, "text/xml", ""),
            ("https://harbor.test/sitemap-index.xml", 200, "text/html", ""),
            ("https://harbor.test/robots.txt", 200, "text/plain", ROBOTS),
        ),
    )
    assert sorted(r.sitemap_url for r in found.collect()) == ["https://harbor.test/sitemap.xml", "https://harbor.test/sitemap_boats.xml"]


def test_index_expansion_ends_on_cycles(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "leaf"), ("x", "y")], "sitemap_url string, child_url string"
    )
    roots = spark.createDataFrame([("a",)], "sitemap_url string")
    rows = {r.sitemap_url: (r.depth, r.is_leaf) for r in D.expand_sitemap_index(roots, edges).collect()}
    assert rows == {"a": (0, False), "b": (1, False), "c": (2, False), "leaf": (3, True)}


def test_documents_from_entries(spark):
    entries = S.scan_sitemap(sm(spark, URLSET))
    with_images = S.sitemap_documents(entries).where("doc_id like '%tide-low'").first()
    assert (with_images.source, with_images.content, with_images.content_type) == ("https://harbor.test/tide-low", "", "web_page")
    assert (with_images.last_modified, with_images.change_frequency, with_images.priority) == ("2019-11-07", "hourly", 0.65)
    assert len(with_images.images) == 1 and len(with_images.videos) == 1
    without = S.sitemap_documents(entries, include_images=False).where("doc_id like '%tide-low'").first()
    assert without.images is None


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "sitemap_url string, pos int, loc string, lastmod string, priority double")


def test_first_entry_wins_and_priority_order(spark):
    e = entries(
        spark, ("s2", 0, "http://a/1", "2024-01-01", 0.1), ("s1", 5, "http://a/1", "2019-11-07", 0.9),
        ("s1", 1, "http://a/2", None, None), ("s1", 2, "http://b/3", "2024-05-05", 0.9), ("s1", 3, "http://b/4", "not a date", 0.9),
    )
    first = D.dedup_first(e)
    ranked = D.sort_by_priority(first).orderBy("rank").collect()
    assert [(r.loc, r["rank"]) for r in ranked] == [("http://b/3", 1), ("http://a/1", 2), ("http://b/4", 3), ("http://a/2", 4)]
    assert [r.loc for r in D.cap_pages(first, 2).collect()] == ["http://b/3", "http://a/1"]
    assert D.cap_pages(first, 0).count() == 4
    capped = D.cap_per_domain(first, 1).orderBy("domain").collect()
    assert [(r.domain, r.loc) for r in capped] == [("a", "http://a/1"), ("b", "http://b/3")]


def test_large_caps_cut_per_salt_first(spark, monkeypatch):
    monkeypatch.setattr(O, "_GROUP_LIMIT", 3)
    df = spark.range(1000).select((F.col("id") % 2 * 0 + F.when(F.col("id") < 900, 0).otherwise(1)).alias("k"), F.col("id").alias("v"))
    top = O.top_n_per_group(df, ["k"], [F.desc("v")], 50)
    got = sorted((r.k, r["rank"], r.v) for r in top.collect())
    assert got == [(0, i + 1, 899 - i) for i in range(50)] + [(1, i + 1, 999 - i) for i in range(50)]


def test_global_rank_equals_sorting(spark):
    df = spark.range(5000).select((F.hash("id") % 50).alias("a"), F.col("id").alias("b")).repartition(7)
    ranked = O.global_rank(df, [F.desc("a"), F.asc("b")]).collect()
    expected = sorted(((r.a, r.b) for r in ranked), key=lambda t: (-t[0], t[1]))
    assert [(r.a, r.b) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in ranked) == list(range(1, 5001))


def test_running_total_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "_BLOCK", 4)
    df = spark.range(30).select((F.col("id") % 2).alias("k"), F.col("id").alias("p"), (F.col("id") + 1).alias("v"))
    rows = O.running_total(df, ["k"], "p", "v", "before", "total").collect()
    for r in rows:
        own = [i + 1 for i in range(30) if i % 2 == r.k]
        assert r.total == sum(own) and r.before == sum(v for v in own if v < r.v)


def test_bounded_crawl_depth_and_cap(spark):
    links = spark.createDataFrame(
        [("http://a/0", f"http://a/{i}") for i in range(1, 6)] + [("http://a/1", "http://b/1"), ("http://b/1", "http://b/2"), ("http://a/0", "http://gone/")],
        "url string, target string",
    )
    pages = spark.createDataFrame([(f"http://a/{i}",) for i in range(6)] + [("http://b/1",), ("http://b/2",)], "url string")
    seeds = spark.createDataFrame([("http://a/0",), ("http://a/0",)], "url string")
    rows = {r.url: r.depth for r in D.bounded_crawl(seeds, links, pages, 2, 3).collect()}
    assert rows == {"http://a/0": 0, "http://a/1": 1, "http://a/2": 1, "http://b/1": 2}
    assert D.bounded_crawl(seeds, links, pages, 3, 0).count() == 8


def test_summary_of_a_long_sitemap(spark):
    e = entries(spark, *[("s", i * 2, f"http://a/{i}", "2024-01-01" if i % 2 else None, 0.5 if i else None) for i in range(130)])
    row = D.sitemap_summary(e).first()
    lines = row.content.split("\n")
    assert lines[:5] == ["Sitemap: s", "Total URLs: 130", "", "1. http://a/0", "2. http://a/1 (lastmod: 2024-01-01) [priority: 0.5]"]
    assert row.url_count == 130 and row.content.endswith("100. http://a/99 (lastmod: 2024-01-01) [priority: 0.5]\n\n... and 30 more URLs")
    assert [r.url for r in D.sitemap_url_lists(e).orderBy("position").collect()] == [f"http://a/{i}" for i in range(130)]
    both = e.select("sitemap_url").distinct().unionByName(spark.createDataFrame([("none",)], "sitemap_url string"))
    empty = D.sitemap_summary(e, both).where("sitemap_url = 'none'").first()
    assert (empty.url_count, empty.content) == (0, "Sitemap: none\nTotal URLs: 0\n\n")


def test_results_of_repeated_and_unknown_urls(spark):
    urls = spark.createDataFrame([("u",), ("u",), ("v",)], "url string")
    rows = {r.url: (r.status, r.error) for r in R.crawl_results(urls, responses(spark, ("u", 200, "text/html", "b"))).collect()}
    assert rows == {"u": (200, None), "v": (0, "no response")}
    assert R.crawl_success(R.crawl_results(urls, responses(spark, ("u", 200, "text/html", "b")))).count() == 1


def test_equal_file_names_keep_the_last(spark, tmp_path):
    r = spark.createDataFrame([("http://a/b?c", 1, "text/html", "old"), ("http://a/b/c", 2, "text/html", "x"), ("http://a/b?c/", 3, "text/html", "new")],
                              "url string, position int, content_type string, body string")
    R.save_pages(r, str(tmp_path / "out"))
    rows = sorted((x.filename, x.ext, x.content) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("http_a_b_c", ".html", "new")]


def test_sites_without_sitemap_give_their_homepage(spark):
    sites = spark.createDataFrame([("http://a",), ("http://b",)], "base_url string")
    found = spark.createDataFrame([("http://a", "http://a/1"), ("http://c", "http://c/1")], "base_url string, loc string")
    rows = sorted((r.url, r.source_type) for r in D.crawl_website(sites, found).collect())
    assert rows == [("http://a/1", "sitemap"), ("http://b", "direct")]


def test_crawl_from_robots_to_pages(spark):
    index = '<?xml version="1.0"?><sitemapindex><sitemap><loc>https://harbor.test/s1.xml</loc></sitemap></sitemapindex>'
    r = responses(
        spark, ("https://harbor.test/robots.txt", 200, "text/plain", "Sitemap: https://harbor.test/index.xml"),
        ("https://harbor.test/index.xml", 200, "text/xml", index), ("https://harbor.test/s1.xml", 200, "text/xml", URLSET),
        ("https://harbor.test/tide-low", 200, "text/html", "<p>one</p>"),
    )
    rows = {x.url: x for x in crawl_sites(spark.createDataFrame([("https://harbor.test",)], "base_url string"), r).collect()}
    assert rows["https://harbor.test/tide-low"].status == 200 and rows["https://harbor.test/tide-low"].sitemap_priority == 0.65
    assert rows["https://harbor.test/tide-high"].status == 0 and rows["https://harbor.test/tide-high"].source_type == "sitemap"
