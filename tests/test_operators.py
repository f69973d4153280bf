import pytest
from pyspark.sql import functions as F

from textquarry.functions.vectors import literal
from textquarry.operators import links, rollups, search, writes
from textquarry.operators.dom import element_links, main_markdown
from textquarry.operators.robots import allowed, robots_info, robots_rules

LINK = "page_url string, pos int, url string, anchor_text string, context string"


def test_extract_links(spark):
    html = '<script>var a="<a href=\'/no\'>n</a>";</script><p>see <a class="x" href="/a" title="T">first  <b>one</b></a> and <a href="mailto:x">m</a> <A HREF=\'b.pdf\'></A></p>'
    rows = links.extract_links(spark.createDataFrame([("https://s.gov/d/p", html), ("https://e.gov/", None)], "url string, html string")).orderBy("pos").collect()
    assert [(r.href, r.url, r.anchor_text, r.title) for r in rows] == [("/a", "https://s.gov/a", "first one", "T"), ("b.pdf", "https://s.gov/d/b.pdf", "b.pdf", None)]
    assert rows[0].context == "see first one and m"


def test_references_without_semicolon_are_text():
    """A reference cut short stays as it is written, in a heading, a paragraph and a link; whole ones are decoded."""
    html = "<article><h1>Q&amp;A&amp;&amp</h1><p>one &copy two &#169; three &ampx; &lt;b&gt; AT&T</p><p><a href='/a?x=1&copy=2&amp;y=3'>long enough &amp</a></p></article>"
    assert main_markdown(html).split("\n\n\n") == ["## Q&A&&amp", "one &copy two © three &ampx; <b> AT&T", "long enough &amp"]
    assert [(href, anchor) for href, anchor, *_ in element_links(html)] == [("/a?x=1&copy=2&y=3", "long enough &amp")]


def test_dedupe_keeps_longest_context(spark):
    rows = [("p", 0, "u1", "", "ab"), ("p", 1, "u2", "", "x"), ("p", 2, "u1", "", "abc"), ("p", 3, "u2", "", "y")]
    got = links.dedupe_links(spark.createDataFrame(rows, LINK)).orderBy("pos").collect()
    assert [(r.url, r.context) for r in got] == [("u1", "abc"), ("u2", "x")]


def test_links_of_pages_with_one_url(spark):
    """Two pages of one URL: equal contexts and places are told apart by their words, equal ranks by the link's URL, however rows are dealt."""
    rows = [("p", 0, f"u{i % 40:02}", "", f"{i:03}") for i in range(80)]
    kept, orders = set(), set()
    for seed in range(3):
        df = spark.createDataFrame(rows[seed * 29 :] + rows[: seed * 29], LINK).repartition(3)
        one = links.dedupe_links(df)
        kept.add(tuple(sorted((r.url, r.context) for r in one.collect())))
        ranked = one.withColumn("relevance_score", F.lit(0.5))
        orders.add(tuple(r.url for r in links.by_relevance(ranked).collect()))
    assert kept == {tuple((f"u{i:02}", f"{i:03}") for i in range(40))}
    assert orders == {tuple(f"u{i:02}" for i in range(40))}


def test_prefilter(spark):
    urls = ["https://facebook.com/x", "https://other.org/about", "https://other.org/budget", "https://sub.base.gov/p", "https://base.gov/login"]
    df = spark.createDataFrame([("https://base.gov", i, u, "", "") for i, u in enumerate(urls)], LINK)
    assert {r.url for r in links.prefilter(df, F.col("page_url")).collect()} == {urls[2], urls[3]}


def test_heuristic(spark):
    df = spark.createDataFrame([("p", i, "u", t, "") for i, t in enumerate(["Annual Financial Report", "vendor contract", "forbid", "hello"])], LINK)
    assert [r.score for r in links.heuristic_rank(df).orderBy("pos").collect()] == [0.95, 0.75, 0.85]


def test_rank_links(spark):
    df = spark.createDataFrame([("p", i, f"u{i}", "", "") for i in range(3)], LINK)
    batched = links.rank_batches(df, [F.col("pos")])
    some = links.rank_links(batched, lambda own: [{"index": 0, "relevance_score": 0.9, "category": "budget", "rationale": "r"}, {"index": 7, "relevance_score": 0.9, "category": "budget", "rationale": "r"}])
    assert [(r.url, r.relevance_score) for r in some.collect()] == [("u0", 0.9)]

    def fails(own):
        raise RuntimeError

    assert {(r.relevance_score, r.category, r.rationale) for r in links.rank_links(batched, fails).collect()} == {(0.1, "other", "Error during ranking")}


def test_group_by_category(spark):
    df = spark.createDataFrame([("p", 0, "u", "", "", "budget"), ("p", 0, "v", "", "", "zzz")], LINK + ", category string")
    got = {r.category: r.n_links for r in links.group_by_category(df).collect()}
    assert len(got) == 10 and got["budget"] == got["other"] == 1 and got["policy"] == 0


def test_robots(spark):
    text = "User-agent: *\nCrawl-delay: 2\nDisallow: /Private\nDisallow:\nUser-agent: bot\nDisallow: /x"
    rules = robots_rules(spark.createDataFrame([("s", text)], "site string, text string"))
    info = robots_info(rules).first()
    assert (info.crawl_delay, info.disallowed) == (2000, ["/private"])
    urls = spark.createDataFrame([("https://s/ab",), ("https://s/b",), ("nonsense",)], "url string")
    only = spark.createDataFrame([("s", 0, "disallow", "/a")], rules.schema)
    assert [r.url for r in allowed(urls, only).collect()] == ["https://s/b"]
    everything = spark.createDataFrame([("s", 0, "disallow", "/")], rules.schema)
    assert allowed(urls, everything).count() == 0


def test_search(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 2, [0.5, 0.5]), (4, 3, None), (5, 3, [0.0, 0.0]), (6, 4, [1.0, 0.0])]
    found = search.top_k(spark.createDataFrame(rows, "id long, document_id long, embedding array<double>"), literal([1, 0]), 4)
    assert [r.id for r in found.orderBy(F.col("similarity").desc(), "id").collect()] == [1, 6, 2, 3]
    assert {r.id for r in search.best_per_document(found).collect()} == {1, 6, 3}
    assert [(r.place, r.document_id, r.content) for r in search.context_groups(found, content="id").orderBy("place").collect()] == [(1, 1, "1\n\n2"), (2, 4, "6"), (3, 2, "3")]
    with pytest.raises(ValueError):
        search.top_k(found, literal([1, 0]), 0)


def test_pipeline(spark):
    df = spark.createDataFrame([("zzz", 5.0)], "phase string, estimated_value double")
    assert {r.n for r in rollups.count_by_phase(df).collect()} == {0}
    total = rollups.totals(df).first()
    assert (total.total, float(total.total_estimated_value)) == (1, 5.0)
    assert rollups.with_phase(df).first().phase_label == "Strategy"


def test_counts(spark):
    entities = spark.createDataFrame([(1,), (2,)], "id long")
    facts = {"d": (spark.createDataFrame([(1,), (1,)], "k long"), "k"), "p": (spark.createDataFrame([(1,), (1,), (1,)], "k long"), "k")}
    assert {(r.id, r.d, r.p) for r in rollups.counts_per(entities, "id", facts).collect()} == {(1, 2, 3), (2, 0, 0)}


def test_writes(spark):
    rows = spark.createDataFrame([("u", "f2"), ("u", "f1"), ("v", "f3")], "url string, file string")
    first = writes.first_per_key(rows, "url", "file")
    assert {tuple(r) for r in first.collect()} == {("u", "f1"), ("v", "f3")}
    assert [r.url for r in writes.unseen(first, rows.where("url = 'u'"), "url").collect()] == ["v"]
    entities = spark.createDataFrame([("a", "A", None), ("b", "B", None)], "id string, name string, type string")
    found = spark.createDataFrame([("a", "New", "city", 0.5), ("b", "Bad", "city", 0.4)], "id string, name string, type string, confidence double")
    assert {tuple(r) for r in writes.overlay(entities, found).collect()} == {("a", "New", "city"), ("b", "B", None)}
    owner = spark.createDataFrame([(["a", "zz"],), (None,)], "ids array<string>")
    assert [r.id for r in writes.in_array(entities, owner, "ids").collect()] == ["a"]
    assert writes.without_orphans(found, entities.where("id = 'a'"), "id").count() == 1


def test_dom():
    html = "<title>x</title><nav><p>menu menu menu</p></nav><main><h1>Head</h1><p>Long enough paragraph.</p><p>short</p><ul><li>first item<li>second item<li>no</ul><table><tr><th>a</th><td>b</td></tr></table><pre>code</pre><div style='display:none'><p>hidden hidden hidden</p></div><blockquote>said</blockquote></main>"
    assert main_markdown(html, "T") == "# T\n\n\n## Head\n\n\nLong enough paragraph.\n\n\n- first item\n- second item\n\n\n**Table:**\n| a | b |\n\n\n```\ncode\n```\n\n\n> said"
    assert main_markdown(None) == ""


def test_allowed_of_many_rules(spark):
    """A site of 20,000 paths is asked by prefixes: the same answers as by looking at each, and no row holds the paths."""
    from textquarry.operators.robots import allowed

    paths = [f"/a{i}" for i in range(0, 40000, 2)] + ["/Deep/er/path", "/b/"]
    rules = spark.createDataFrame([("m.gov", "disallow", p) for p in paths] + [("f.gov", "disallow", "/a1"), ("n.gov", "disallow", "/"), ("m.gov", "crawl-delay", "7")], "site string, rule string, value string")
    urls = [f"https://{s}.gov{p}" for s in ("m", "f", "n", "o") for p in ("/a1", "/a10", "/a3/x", "/A2x", "/b", "/b/c", "/deep/er/pathology", "/", "")] * 2 + ["no url", None]
    got = sorted(r.url for r in allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect())

    def free(url):
        host, _, path = url.removeprefix("https://").partition("/")
        own = {"m.gov": paths, "f.gov": ["/a1"], "n.gov": ["/"]}.get(host, [])
        return not any(("/" + path).lower().startswith(p.lower()) for p in own)

    assert got == sorted(u for u in urls if u and u != "no url" and free(u))
    assert got == sorted(r.url for r in allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules, few=10**6).collect())
