import json

import pytest
from pyspark.sql import functions as F

from textquarry import providers
from textquarry.operators.writes import first_page
from textquarry.plans import api, crawl, frontier
from textquarry.plans.ingest import Warehouse, ingest
from textquarry.sources.corpus import fetch_pages, read_corpus, split_rejects
from textquarry.streaming.ingest import document_stream, event_counts, start

TEXT = "# City of Example budget FY2024\n\n## Network Upgrade Project\nThe council approved a budget of $2.1 million for the network upgrade. Work begins in spring.\n\n## Other\n" + "Plain words follow here. " * 20


@pytest.fixture
def corpus(tmp_path):
    for entity, name, record in [("e1", "a", {"url": "https://e.gov/a", "org_id": "e1", "url_id": "a", "text": TEXT}), ("e1", "b", {"url": "https://e.gov/a", "org_id": "e1", "url_id": "a", "text": TEXT}), ("e1", "c", {"url": "https://e.gov/c", "org_id": "e1", "url_id": "c", "text": "short"}), ("e2", "d", {"url": "https://f.gov/d", "org_id": "nobody", "url_id": "d", "text": TEXT})]:
        (tmp_path / "data" / entity).mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / entity / f"{name}.json").write_text(json.dumps(record))
    (tmp_path / "data" / "e1" / "broken.json").write_text("{oops")
    return tmp_path


def test_ingest(spark, corpus):
    embeddings, model = providers.HashedEmbedding(8), providers.RuleModel()
    raw = read_corpus(spark, f"{corpus}/data")
    assert {r.reason for r in split_rejects(raw)[1].collect()} == {"malformed", "short"}
    house = Warehouse(spark, f"{corpus}/house")
    done = ingest(raw, house, embeddings, model, f"{corpus}/staging")
    assert done == {"documents": 1, "chunks": house.read("chunks").count(), "projects": 1, "project_evidence": 2, "rejected": 3}
    assert ingest(raw, house, embeddings, model, f"{corpus}/staging")["documents"] == 0
    assert {r.id: r.name for r in house.read("entities").collect()} == {"e1": "City of Example", "e2": None}
    project = house.read("projects").first()
    assert (project.phase, float(project.estimated_value), project.title) == ("budget", 2100000.0, "Network Upgrade Project")

    tables = [house.read(t) for t in ("chunks", "documents", "projects", "entities")]
    found = api.search(*tables, "network upgrade", embeddings, limit=3)
    assert found["documents"].count() == 1 and found["projects"].first().phase_label == "Budget"
    assert api.search(*tables, "x", embeddings, kind="none") == {}
    with pytest.raises(ValueError):
        api.search(*tables, "", embeddings)
    said = api.chat(*tables, "network upgrade budget", embeddings, model)
    assert said["answer"] and said["sources"][0]["url"] == "https://e.gov/a"
    house.append("chat_sessions", said["session"])
    assert house.read("chat_sessions").first().matched_projects[0].phase == "budget"
    assert [r.document_count for r in api.entities_stats(tables[3], tables[1], tables[2]).collect()] == [1, 0]
    detail = api.project_detail(tables[2], tables[3], house.read("project_evidence"), tables[1], project.id)
    assert [detail[k].count() for k in ("project", "evidence", "documents")] == [1, 2, 1]
    assert api.entity_detail(tables[3], tables[1], tables[2], "nobody")["entity"].count() == 0
    assert api.pipeline(tables[2], tables[3])["summary"].first().total == 1
    assert api.projects_list(tables[2], tables[3], phase="strategy").count() == 0


def test_stream(spark, corpus):
    seen = []
    stream = start(document_stream(spark, f"{corpus}/data"), lambda df, n: seen.extend(r.url for r in df.collect()), f"{corpus}/checkpoint")
    stream.awaitTermination(60)
    assert sorted(seen) == ["https://e.gov/a", "https://f.gov/d"]


def test_event_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r.n, r.total) for r in event_counts(df).collect()] == [(2, 3.0)]


def test_levels(spark):
    pages = {"https://s.gov/": '<a href="/a/">budget a</a><a href="https://o.org/x">out</a>', "https://s.gov/a": '<a href="/b">budget b</a><a href="/">home budget</a>', "https://s.gov/b": '<a href="/c">budget c</a>'}
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    got = crawl.by_levels(spark.createDataFrame([("https://s.gov/#x",)], "url string"), df, depth=2)
    assert {(r.depth, r.url) for r in got.collect()} == {(0, "https://s.gov/"), (1, "https://s.gov/a"), (2, "https://s.gov/b")}


def test_fetch(spark):
    def fetch(url):
        if url == "bad":
            raise OSError
        return f"<p>{url}</p>"

    got = fetch_pages(spark.createDataFrame([("ok",), ("bad",)], "url string"), fetch)
    assert {tuple(r) for r in got.collect()} == {("ok", "<p>ok</p>"), ("bad", None)}


def test_retry_and_batches():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise providers.RateLimited()
        return "done"

    assert providers.with_retry(call, waits.append) == "done" and waits == [1.5, 2.5]
    with pytest.raises(providers.RateLimited):
        providers.with_retry(lambda: (_ for _ in ()).throw(providers.RateLimited(99)), waits.append)
    assert waits[-1] == 60.0

    class Counting(providers.HashedEmbedding):
        sizes: list[int] = []

        def embed(self, texts):
            self.sizes.append(len(texts))
            return super().embed(texts)

    assert len(list(providers.embed_all(Counting(4), map(str, range(120)), lambda _: None))) == 120 and Counting.sizes == [50, 50, 20]


def test_storable(spark):
    df = spark.createDataFrame([("x" * 199,), ("x" * 200,)], "markdown string")
    assert crawl.storable(df).count() == 1
    assert crawl.titled(df.select(F.lit("<title>a &amp; b</title>").alias("html"))).first().title == "a & b"


def test_stored_markdown_of_a_cut_reference(spark):
    """A page whose title and heading end in a reference without semicolon is stored with the same words in both."""
    html = "<title>Q&amp;&amp</title><article><h1>Q&amp;&amp</h1><p>" + "plain words " * 20 + "</p></article>"
    pages = crawl.titled(spark.createDataFrame([(html,)], "html string"))
    assert [r.markdown for r in crawl.storable(crawl.page_markdown(pages)).collect()] == ["# Q&&amp\n\n\n## Q&&amp\n\n\n" + ("plain words " * 20).strip()]


def test_pages_of_one_url(spark):
    """Of several pages of one URL the same one is read for links and for storing, in whatever order they lie; one without html is the last choice."""
    rows = [("https://s.gov/a", f'<a href="/{x}">budget {x}</a>') for x in "bdc"] + [("https://s.gov/a", None), ("https://s.gov/a#z", '<a href="/a0">budget a0</a>')]
    seeds = spark.createDataFrame([("https://s.gov/a",)], "url string")
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        pages = spark.createDataFrame(some, "url string, html string").coalesce(1)
        assert [r.url for r in crawl.by_levels(seeds, pages, depth=1).where("depth = 1").collect()] == ["https://s.gov/b"]
        assert [(r.url, r.html) for r in frontier.Frontier("unused", seeds, pages).read(seeds).collect()] == [rows[0]]
        assert first_page(pages.withColumn("key", F.lit("k")), "key").first().html == rows[0][1]
