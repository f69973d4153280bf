import pytest
from pyspark.sql import functions as F

from textquarry.functions import normalize, text, urls, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [("https://x.gov/a/?utm_source=q#f", "https://x.gov/a"), ("https://x.gov/", "https://x.gov/"), ("https://x.gov/a/?y=1", "https://x.gov/a/?y=1"), ("not a url", "not a url"), ("https://x.gov/a?utm_source=q&b=1&gclid=2", "https://x.gov/a?b=1")])
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.gov/x/y/z.pdf", "a-gov-y-z-pdf"), ("https://a.gov/", "a-gov-home"), ("https://a.gov/x", "a-gov-x")])
def test_url_id(spark, url, want):
    assert one(spark, urls.url_id(F.lit(url))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("www.a.gov", "a.gov", True), ("x.a.gov", "a.gov", True), ("ba.gov", "a.gov", False)])
def test_same_site(spark, a, b, want):
    assert one(spark, urls.same_site(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/a/b/c/d/e/../../../../../x", "https://a.gov/x"), ("/a/b/c/d/e/f/g/../../../../../../x?y=/../z#/./", "https://a.gov/a/x?y=/../z#/./"), ("/../../x", "https://a.gov/x"), ("/a/./b/.", "https://a.gov/a/b/"), ("/a/b/..", "https://a.gov/a/"),
        ("..", "https://a.gov/"), ("/a/...b/..c/.d", "https://a.gov/a/...b/..c/.d"), ("https://h.org:80/a/../b", "https://h.org:80/b"), ("/a//../b", "https://a.gov/a/b"), ("?q=/../x", "https://a.gov/x/y?q=/../x"),
    ],
)
def test_resolve_dots(spark, href, want):
    assert one(spark, urls.resolve(F.lit(href), F.lit("https://a.gov/x/y"))) == want


@pytest.mark.parametrize(("href", "want"), [("/b", "https://a.gov/b"), ("c", "https://a.gov/x/c"), ("../c", "https://a.gov/c"), ("//z.gov/q", "https://z.gov/q"), ("?q=1", "https://a.gov/x/y?q=1"), ("https://o.org", "https://o.org")])
def test_resolve(spark, href, want):
    assert one(spark, urls.resolve(F.lit(href), F.lit("https://a.gov/x/y"))) == want


def test_text(spark):
    assert one(spark, text.decode_entities(F.lit("&amp;lt;"))) == "&lt;"
    assert one(spark, text.strip_html(F.lit("<p>a&nbsp;b</p>\n c"))) == "a b c"
    assert one(spark, text.html_to_markdown(F.lit("<h1>T</h1><p>x <b>y</b></p>"))) == "# T x **y**"
    assert one(spark, text.split_sentences(F.lit("Hi there. You go! yes? No"))) == ["Hi there.", "You go! yes?", "No"]
    assert one(spark, text.js_trim(F.lit(" \n a \t"))) == "a"
    assert one(spark, text.truncate(F.lit("x" * 11), 10, "!")) == "x" * 10 + "!"
    assert one(spark, text.long_enough(F.lit("  " + "a" * 49 + "  "), 50)) is False
    assert one(spark, text.long_enough(F.lit("  " + "a" * 50), 50)) is True


@pytest.mark.parametrize(("given", "want"), [("Budget", "budget"), ("RFP_OPEN", "rfp_open"), ("RFP Open", "strategy"), ("in-progress", "strategy"), (None, "strategy")])
def test_phase(spark, given, want):
    assert one(spark, normalize.phase(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [(0.0, 0.5), (None, 0.5), (1.7, 1.0), (-2.0, 0.0), (0.85, 0.85), (float("nan"), 0.5)])
def test_confidence(spark, given, want):
    assert one(spark, normalize.confidence(F.lit(given).cast("double"))) == want


def test_entity(spark):
    record = lambda n, t: F.struct(F.lit(n).cast("string").alias("name"), F.lit(t).alias("type"), F.lit("texas").alias("state"), F.lit(0.9).alias("confidence"))
    assert one(spark, normalize.entity(record("X", "town"))).asDict() == {"name": "X", "type": "other", "state": "TE", "confidence": 0.9}
    assert one(spark, normalize.entity(record(None, "city"))) is None


def test_cosine(spark):
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.cosine(array(1, 0), array(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(array(0, 0), array(1, 1))) is None
    assert one(spark, vectors.cosine(array(1), array(1, 1))) is None
