"""Failures half-way, rules of several sites, deep pages, repeated finds; chunks against a second, plain implementation."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textquarry import providers, runtime
from textquarry.operators import chunking, dom, writes
from textquarry.operators.robots import allowed, robots_rules
from textquarry.plans import api, crawl
from textquarry.plans import ingest as plan
from textquarry.sources.corpus import fetch_pages, fetch_robots, http_fetcher, read_corpus

RULE = "site string, line int, rule string, value string"


def test_robots_of_several_sites(spark):
    rules = spark.createDataFrame([("a.gov", 0, "disallow", "/b"), ("z.gov", 0, "disallow", "/private"), ("all.gov", 0, "disallow", "/"), ("a.gov", 1, "crawl-delay", "1000")], RULE)
    urls = ["https://a.gov/b/x", "https://z.gov/b", "https://z.gov/Private/x", "https://all.gov/", "https://free.gov/private", "no url", None]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int")
    assert {tuple(r) for r in allowed(df, rules).collect()} == {("https://z.gov/b", 1), ("https://free.gov/private", 4)}
    assert allowed(df, rules.limit(0)).count() == 5
    text = robots_rules(spark.createDataFrame([("z.gov", "User-agent: *\nDisallow: /Private")], "site string, text string"))
    assert allowed(df.where("n = 2"), text).count() == 0


def test_robots_of_hosts(spark):
    urls = spark.createDataFrame([("https://a.gov/x",), ("https://a.gov/y",), ("https://b.gov/",), ("no",)], "url string")
    found = fetch_robots(urls, {"https://a.gov/robots.txt": "User-agent: *\nDisallow: /x"}.get)
    assert [tuple(r) for r in found.collect()] == [("a.gov", "User-agent: *\nDisallow: /x")]
    assert {r.url for r in allowed(urls, robots_rules(found)).collect()} == {"https://a.gov/y", "https://b.gov/"}


def test_seeds_are_tested(spark):
    rules = spark.createDataFrame([("s.gov", 0, "disallow", "/x")], RULE)
    pages = spark.createDataFrame([("https://s.gov/x", "<a href='/y'>budget</a>"), ("https://s.gov/y", "")], "url string, html string")
    assert [r.url for r in crawl.by_levels(pages.select("url"), pages, depth=1, rules=rules).collect()] == ["https://s.gov/y"]


def test_overlay_keeps_one_row_for_each_key(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    found = spark.createDataFrame([("a", "Sure", 0.9), ("a", "Less", 0.6), ("a", "Also", 0.9), ("b", "No", 0.1)], "id string, name string, confidence double")
    assert sorted(map(tuple, writes.overlay(entities, found).collect())) == [("a", "Also"), ("b", "B")]


def test_deep_page():
    html = "<div>" * 20_000 + "<p>Long enough paragraph.</p>" + "</span>" * 20_000
    assert dom.main_markdown(html) == "Long enough paragraph."
    assert dom.element_links("<p>see <a href='/a' title='t'>first <b>one</b></a> and <a href='#x'>no</a><a href='b'></a></p>") == [("/a", "first one", "see first one and no", "t", None), ("b", "b", "see first one and no", None, None)]


TEXT = "# City of Example budget FY2024\n\n## Network Upgrade Project\nThe council approved a budget of $2.1 million for the network upgrade. Work begins in spring.\n\n## Other\n" + "Plain words follow here. " * 20


@pytest.fixture
def corpus(spark, tmp_path):
    for i in range(5):
        (tmp_path / "data" / "e1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / "e1" / f"{i}.json").write_text(json.dumps({"url": f"https://e.gov/{i}", "org_id": "e1", "url_id": str(i), "text": TEXT + str(i)}))
    return read_corpus(spark, f"{tmp_path}/data"), tmp_path


def rows(house):
    return {name: sorted((tuple(x for n, x in r.asDict().items() if not n.endswith("_at")) for r in house.read(name).collect()), key=str) for name in ("entities", "documents", "chunks", "projects", "project_evidence")}


@pytest.mark.parametrize("table", ["chunks", "projects", "project_evidence", "documents"])
def test_ingest_after_a_failure(spark, corpus, monkeypatch, table):
    raw, tmp = corpus
    embeddings, model = providers.HashedEmbedding(8), providers.RuleModel()
    whole, broken = plan.Warehouse(spark, f"{tmp}/whole"), plan.Warehouse(spark, f"{tmp}/broken")
    plan.ingest(raw, whole, embeddings, model, f"{tmp}/s1")
    append = plan.Warehouse.append

    def fails(self, name, df):
        append(self, name, df if name != table else df.limit(1))
        if name == table:
            raise OSError("lost")

    monkeypatch.setattr(plan.Warehouse, "append", fails)
    with pytest.raises(OSError):
        plan.ingest(raw, broken, embeddings, model, f"{tmp}/s2")
    monkeypatch.setattr(plan.Warehouse, "append", append)
    plan.ingest(raw, broken, embeddings, model, f"{tmp}/s2")
    assert rows(broken) == rows(whole)
    assert plan.ingest(raw, broken, embeddings, model, f"{tmp}/s2")["documents"] == 0 and rows(broken) == rows(whole)


def test_embedding_failure_costs_one_document(spark, corpus):
    raw, tmp = corpus

    class Failing(providers.HashedEmbedding):
        def embed(self, texts):
            if any(t.endswith("3") for t in texts):
                raise OSError
            return super().embed(texts)

    house = plan.Warehouse(spark, f"{tmp}/house")
    plan.ingest(raw, house, Failing(8), providers.RuleModel(), f"{tmp}/staging")
    assert house.read("documents").count() == 5
    assert 0 < house.read("chunks").where("embedding is null").count() < house.read("chunks").count()


def test_entity_sees_three_documents(spark):
    class Model(providers.RuleModel):
        def entity(self, pages, website):
            return {"name": f"{website} {[p['url'][-1] for p in pages]}", "type": "city", "state": None, "confidence": 1.0}

    df = spark.createDataFrame([("e", f"f{i}", f"https://e.gov/{i}", "t") for i in range(9)], "org_id string, file string, url string, text string")
    assert plan.entity_info(df, Model()).first().name == "https://e.gov ['0', '1', '2']"


def test_scratch(spark):
    scratch = runtime.Scratch(spark)
    saved = scratch.save(spark.range(3))
    assert saved.count() == 3
    runtime.clean(spark)
    with pytest.raises(Exception):  # noqa: B017
        saved.count()


def test_fetch_waits_and_statuses(spark):
    """A real server on this machine: statuses, robots.txt, and the wait between pages of a host."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/robots.txt": "User-agent: *\nDisallow: /private", "/a": "<p>é</p>", "/b": "<p>b</p>"}.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write((body or "gone").encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    fetch = http_fetcher(5)
    urls = spark.createDataFrame([(f"{base}/a",), (f"{base}/b",), (f"{base}/none",), ("nonsense",)], "url string")
    began = time.monotonic()
    got = {r.url: r.html for r in fetch_pages(urls, fetch, wait=0.5).collect()}
    assert time.monotonic() - began >= 1.0
    assert got == {f"{base}/a": "<p>é</p>", f"{base}/b": "<p>b</p>", f"{base}/none": None, "nonsense": None}
    server.shutdown()


def test_chat_stream(spark):
    docs = spark.createDataFrame([("d", "Title", "https://e.gov/", "e")], "id string, title string, url string, org_id string")
    chunks = spark.createDataFrame([("c", "d", "S", "the budget", [1.0, 0.0])], "id string, document_id string, section_title string, content string, embedding array<double>")
    projects = spark.createDataFrame([], "id string, org_id string, title string, description string, phase string, category string, estimated_value double, fiscal_year int, embedding array<double>")
    entities = spark.createDataFrame([("e", "E")], "id string, name string")

    class Two(providers.HashedEmbedding):
        def embed(self, texts):
            return [[1.0, 0.0] for _ in texts]

    stored = []
    pieces = list(api.chat_stream(chunks, docs, projects, entities, "budget", Two(2), providers.RuleModel(), stored.append))
    assert pieces and stored[0].first().response == "".join(pieces) and stored[0].first().matched_docs[0].id == "d"


# ------------------------------------------------------------------ chunks, written a second time


def plain_chunks(text, size=lambda t: (len(t) + 3) // 4, most=1000, least=100, overlap=25):
    """Chunks by a line-by-line reading: sections at level 2 and 3 headers, small ones joined, large ones packed."""
    blank = chunking._BLANK
    if not text.strip(blank):
        return []
    sections, title, lines, headed = [], None, [], False
    for line in text.split("\n"):
        m = re.fullmatch(rf"#{{2,3}}[{blank}]+(.+)", line)
        if m:
            sections.append((title, "\n".join(lines)))
            title, lines, headed = m[1].strip(blank), [], True
        else:
            lines.append(line)
    sections.append((title, "\n".join(lines)))
    if headed:
        sections = [(t or "Introduction", c.strip(blank)) for t, c in sections if c.strip(blank)]
    else:
        sections = [("Document", text.strip(blank))]
    joined = []
    for t, c in sections:
        if joined and size(c) < least:
            joined[-1] = (joined[-1][0], joined[-1][1] + "\n\n" + c)
        else:
            joined.append((t, c))

    def packed(pieces, weigh, glue):
        out, held, n = [], [], 0
        for p in pieces:
            w = weigh(p)
            if held and n + w > most:
                out.append(glue.join(held))
                held, n = [], 0
            held.append(p)
            n += w
        return out + ([glue.join(held)] if held else [])

    def words(t):
        return packed(re.split(rf"[{blank}]+", t), lambda w: size(w + " "), " ")

    chunks = []
    for t, c in joined:
        if size(c) <= most:
            chunks.append((t, c, size(c)))
            continue
        pieces = []
        for paragraph in re.split(r"\n\n+", c):
            paragraph = paragraph.strip(blank)
            if not paragraph:
                continue
            if size(paragraph) <= most:
                pieces.append(paragraph)
                continue
            said = [s for s in re.split(rf"(?<=[.!?])[{blank}]+(?=[A-Z])", paragraph) if s.strip(blank)]
            if len(said) < 2:
                pieces += words(paragraph)
                continue
            run = []
            for s in [*said, None]:
                if s is not None and size(s) <= most:
                    run.append(s)
                    continue
                pieces += [x.strip(blank) for x in packed(run, size, " ") if x.strip(blank)]
                run = []
                if s is not None:
                    pieces += words(s)
        body, n, name = "", 0, t
        for p in pieces:
            if body and n + size(p) > most:
                chunks.append((name, body.strip(blank), n))
                body = " ".join(re.split(rf"[{blank}]+", body)[-overlap:]) + "\n\n" + p
                name, n = t + " (continued)", size(body)
            else:
                body, n = (body + "\n\n" + p if body else p), n + size(p)
        if body.strip(blank):
            chunks.append((name, body.strip(blank), size(body)))
    return [(*c, i) for i, c in enumerate(chunks)]


def test_chunks_twice(spark):
    """All documents of the smallest tables, plain and with headers and blank lines put in."""
    pytest.importorskip("duckdb")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    headed = docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", "\n", "\n\n"), "(?m)^([A-Z]\\S*) ", "## $1\n").alias("text"))
    for table in (docs, headed):
        want = {(r.doc_id, *c) for r in table.collect() for c in plain_chunks(r.text)}
        assert {tuple(r) for r in chunking.chunk_documents(table, "doc_id", "text").collect()} == want
    assert any(w[1].endswith("(continued)") for w in want)
