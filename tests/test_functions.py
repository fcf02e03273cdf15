import random
import time
import uuid
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gleanery.functions import content_types as ct
from gleanery.functions import html as H
from gleanery.functions import metadata as M
from gleanery.functions import tags
from gleanery.functions import urls as U


def apply(spark, fn, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.coalesce(1).select(fn(F.col("v"))).collect()]


URLS = [
    "HTTP://Example.com/a/b/", "https://e.org", "https://e.org///", "https://e.org/a;p=1?q=2#f", "http://e.org/a;b/c/",
    "https://u:p@e.org:80/x//", "https://e.org?q", "https://e.org/é/ü/", "//e.org/p/",
]


def test_normalize_url(spark):
    assert apply(spark, U.normalize_url, *URLS) == [
        "http://Example.com/a/b", "https://e.org/", "https://e.org/", "https://e.org/a", "http://e.org/a;b/c",
        "https://u:p@e.org:80/x", "https://e.org/", "https://e.org/é/ü", "https://e.org/p",
    ]
    assert apply(spark, U.normalize_url, "no scheme", "") == [None, None]


def test_document_id_is_a_name_based_uuid(spark):
    assert apply(spark, U.document_id, *URLS) == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in URLS]


def test_resolve_url(spark):
    df = spark.createDataFrame(
        [("http://a.b/c/d", "/x"), ("http://a.b/c", "https://z/y"), ("http://a.b", "//q/r"), ("http://a.b", "s"), ("http://a.b", "")],
        "base string, ref string",
    )
    got = [r[0] for r in df.coalesce(1).select(U.resolve_url(F.col("base"), F.col("ref"))).collect()]
    assert got == ["http://a.b/x", "https://z/y", "http://q/r", "http://a.b/s", "http://a.b"]


@pytest.mark.parametrize("ref", ["c.html", "../x", "../../../x", "./", "..", ".", "a/./b/../c/..", "?q=1", "#f", "/a/../b", "d/?x=../y#z", "mailto:a@b"])
def test_references_resolve_as_in_the_standard_library(spark, ref):
    bases = ["http://h/a/b.html", "http://h/a/b/", "http://h/a?x=/y/z#w", "https://h:8080/"]
    df = spark.createDataFrame([(b, ref) for b in bases], "base string, ref string").coalesce(1)
    assert [r[0] for r in df.select(U.resolve_url(F.col("base"), F.col("ref"))).collect()] == [urljoin(b, ref) for b in bases]


def test_safe_filename(spark):
    assert apply(spark, lambda c: U.safe_filename(c, F.lit(7)), "https://é.org/a b?c=1/", "///", "") == [
        "https_é.org_a_b_c_1", "page_7", "page_7",
    ]
    assert apply(spark, U.file_extension, "text/html", "text/markdown", "text/x-python", "text/x-csharp", "a/b", None) == [
        ".html", ".md", ".py", ".cs", ".txt", ".txt",
    ]


def test_link_patterns(spark):
    urls = ("http://a/docs/1", "http://a/blog/1", "http://a/docs/private")
    assert apply(spark, lambda c: U.link_allowed(c), *urls) == [True, True, True]
    assert apply(spark, lambda c: U.link_allowed(c, ["docs"], ["private"]), *urls) == [True, False, False]


def test_sitemap_predicates(spark):
    assert apply(spark, U.is_sitemap_url, "http://a/sitemap.xml?x", "http://a/Sitemap-1.XML", "http://a/feed.xml", "http://a/sitemap") == [
        True, True, False, False,
    ]
    assert apply(spark, U.is_sitemap_body, "<?xml?><sitemapindex>", "<urlset>", "<sitemap>", "text") == [True, True, False, False]


def test_document_type_rules_in_order(spark):
    cases = [
        ("text/html", "http://a/x.pdf", "web_page"), (None, "https://a/x.py", "web_page"), ("", "ftp://a/x.py", "python"),
        ("application/pdf", "http://a", "pdf"), ("x", "http://a/b.PDF", "pdf"), ("x", "http://a/b.cs", "csharp"),
        ("text/markdown", "http://a/b", "markdown"), ("x", "http://a/b.md", "markdown"), ("application/json", "u", "json"),
        ("application/xml", "u", "xml"), ("image/png", "u", "text"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "ct string, url string").coalesce(1)
    assert [r[0] for r in df.select(ct.infer_document_type(F.col("ct"), F.col("url"))).collect()] == [c[2] for c in cases]


def test_extractor_routing(spark):
    cases = {
        None: "text/plain", "": "text/plain", "text/html; charset=x": "text/html", " TEXT/Markdown ": "text/markdown",
        "application/x-python": "text/plain", "text": "text/markdown", ";": "text/markdown", "a.cs": "text/x-csharp",
        "a.unknown": "text/plain", "my-text/plain-x": "text/plain",
    }
    assert apply(spark, ct.route_extractor, *cases) == list(cases.values())


def test_registered_extractor_replaces_and_checks_its_type(spark):
    registry = ct.ExtractorRegistry()
    with pytest.raises(TypeError):
        registry.register("text/html", "not a function")
    registry.register("text/html", F.upper)
    registry.register("text/html", F.reverse)
    assert apply(spark, lambda c: registry.extract(F.lit("text/html"), c), "abc") == ["cba"]
    assert apply(spark, lambda c: registry.extract(F.lit("text/plain"), c), "abc", None) == ["abc", ""]


def test_types_of_mime_and_names(spark):
    assert apply(spark, ct.type_of_mime, "text/x-python", "CSharp", "web_page", "nope", None) == [
        "python", "csharp", "web_page", "text", "text",
    ]
    assert apply(spark, ct.coerce_content_type, "PDF", "docx", None) == ["pdf", "text", "text"]
    assert apply(spark, ct.extension_to_mime, "a.MD", "b.c/d", "x.htm", "noext") == ["text/markdown", None, "text/html", None]


PAGE = (
    '<html lang="EN-us"><head><title>A &amp; B</title><meta name="description" content="What it is">'
    '<meta charset="ISO-8859-1"><script type="application/ld+json">{"@type":"x"}</script><script>var a="</p>";</script></head>'
    '<body><!-- c --><h2>Head &lt;1&gt;</h2><p>Some <b>bold</b> and <a class="k" href="/x?a=1&amp;b=2">link</a><a name="n">anchor</a></p>'
    '<ul><li>one<li>two</ul><img src="i.png"><table><tr><td>cell</td></tr></table><form><input name="q"><button>go</button></form></body></html>'
)


def test_page_metadata_and_links(spark):
    assert apply(spark, H.page_title, PAGE) == ["A & B"]
    assert apply(spark, H.page_description, PAGE, "<meta content='x' name='description'>", "") == ["What it is", "x", ""]
    assert apply(spark, H.page_language, PAGE) == ["en-us"]
    assert apply(spark, H.page_encoding, PAGE, "<html>") == ["iso-8859-1", "utf-8"]
    assert apply(spark, H.page_links, PAGE) == [["/x?a=1&b=2", ""]]


def test_stripping_flags(spark):
    default = apply(spark, H.strip_html_elements, PAGE)[0]
    assert "ld+json" in default and "var a" not in default and "<img" not in default and "<table" in default
    assert "<form" not in default and "<button" not in default and "<!--" not in default and "<a class" in default
    kept = apply(spark, lambda c: H.strip_html_elements(c, {"images", "forms", "inputs"}), PAGE)[0]
    assert "<img" in kept and "<input" in kept and "ld+json" not in kept and "<table" not in kept and "link" in kept
    with pytest.raises(ValueError):
        H.strip_html_elements(F.lit(""), {"nonsense"})


def test_html_to_markdown_and_text(spark):
    md = apply(spark, H.html_to_text, PAGE)[0]
    assert md.startswith("## Head <1>") and "**bold**" in md and "[link](/x?a=1&b=2)" in md and "- one\n- two" in md
    plain = apply(spark, H.html_to_plain_text, PAGE)[0]
    assert "Some bold and link" in plain and "**" not in plain
    assert apply(spark, H.html_to_text, "", None) == ["", ""]


def test_metadata_projection_and_merge(spark):
    df = spark.createDataFrame([({"source": "s", "junk": "1", "priority": "0.5", "content_type": "pdf"},), ({},)], "m map<string,string>")
    rows = df.coalesce(1).select(M.project_metadata(F.col("m"), F.lit(None).cast("string")).alias("p")).select("p.*").collect()
    assert (rows[0].source, rows[0].content_type, rows[0].priority, rows[0].language) == ("s", "pdf", 0.5, "en")
    assert (rows[1].source, rows[1].content_type) == (None, "text") and rows[1].created_at is not None
    explicit = df.coalesce(1).select(M.project_metadata(F.col("m"), F.lit("Python")).content_type).first()[0]
    assert explicit == "python"
    merged = df.select(M.attach_metadata(F.col("m"), F.create_map(F.lit("source"), F.lit("mine")))).first()[0]
    assert merged["source"] == "mine" and merged["junk"] == "1"


@pytest.mark.parametrize("page, left", [
    ("a<table><tr><td><table><tr><td>x</td></tr></table>tail</td></tr></table>b", "ab"),
    ("a<TABLE><table></table>in</Table\n>b</table>", "ab</table>"),
    ("a<table>x<script>'</table>'</script>y</table>b", "ab"),
    ("a<table>open <!-- gone --> and <svg><svg></svg>s</svg>kept", "a<table>open  and kept"),
    ("a<video><audio></video></audio>b", "a</audio>b"),
    ("<script>if (a < b) '<img src=x>'</script><img src=y>z", "z"),
    ("<script>never closed <img src=x>", "<script>never closed "),
    ("x < y <img> > z <", "x < y  > z <"),
    ("<!-- a --><!-- open <img>", "<!-- open "),
    ("<div <img>>", "<div >"),
    ("<image><tabled></tabled>", "<image><tabled></tabled>"),
    ("", ""),
])
def test_elements_go_whole(spark, page, left):
    assert apply(spark, lambda c: H.strip_html_elements(c, {"links"}), page) == [left]


def test_kept_scripts_are_not_markup(spark):
    page = '<script type="application/ld+json">{"t": "<table></table>"}</script><table>x</table>'
    assert apply(spark, lambda c: H.strip_html_elements(c, {"structured_data"}), page, None) == [page[:-16], None]


HOSTILE = ["<!--", "<link ", "<script ", "<script>", "<table>", "<a href='x'>", "<a ", "<", "</table", "<style><script>", "<head>", "<!-- --", "\r", "<table></script>"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_what_is_left_open_costs_linear_time(unit):
    """A megabyte of anything unclosed is scanned in a moment."""
    page, kinds = unit * (1_000_000 // len(unit)), frozenset(tags.ELEMENTS)
    started = time.perf_counter()
    tags.without_elements(page, kinds)
    assert time.perf_counter() - started < 3


@pytest.mark.parametrize("unit", HOSTILE)
def test_text_of_hostile_pages_takes_linear_time(spark, unit):
    def seconds(size):
        page = spark.createDataFrame([(unit * (size // len(unit)) + "end",)], "html string")
        started = time.perf_counter()
        assert page.select(H.html_to_text(F.col("html")).alias("t")).first().t.endswith("end")
        return time.perf_counter() - started

    seconds(1_000)
    assert seconds(400_000) < 3 * seconds(200_000) + 1


def test_scanner_against_nested_pages():
    """Random nesting: what is left is what lies outside every removed element."""
    rng = random.Random(9)

    def page(depth, shown):
        out, left = "", ""
        for _ in range(rng.randrange(4)):
            name = rng.choice(["table", "video", "div", "svg", "p"])
            word = f"w{rng.randrange(99)} "
            inner, kept = page(depth - 1, shown) if depth else ("", "")
            gone = name in ("table", "video", "svg")
            out += f"{word}<{name} x='1'>{inner}</{name}>"
            left += word + ("" if gone else f"<{name} x='1'>{kept}</{name}>")
        return out, left

    for _ in range(200):
        html, left = page(4, True)
        assert tags.without_elements(html, frozenset({"tables", "media", "images"})) == left
