"""Registered queries of pages, links, crawling and storing, on inputs in which every rule decides something.

The driver's pages hold few kinds of links, so further links and pages are made from documents
and customers, by the same rule in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import dom, links
from .operators.robots import allowed, robots_info, robots_rules
from .plans import crawl, frontier
from .providers import HashedEmbedding, RuleModel
from .queries import _OUTSIDE_SQL, _SKIP_SQL, _bare_sql, _t, _weights_sql, query
from .runtime import Scratch

# ------------------------------------------------------------------ links of many kinds

_PLACES = ["https://{s}.gov/{i}", "https://www.facebook.com/{i}", "https://other.org/about", "https://other.org/budget/{i}", "https://sub.{s}.gov/p/{i}", "https://{s}.gov/login", "https://{s}.gov/a.PNG", "https://x.edu/{i}", "nowhere"]
_ANCHORS = ["Annual Financial Report", "vendor contract", "RFP 12", "Agenda", "hello", "Contact us", "Board special meeting", "chief of financial services", "capital works project", "report.pdf", "no words"]


def _case(value: str, options: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


def _url_sql(source: str) -> str:
    made = _case("doc_id % 9", _PLACES)
    return f"replace(replace({made}, '{{s}}', {source}), '{{i}}', CAST(doc_id AS VARCHAR))"


_MADE = f"""ul AS (SELECT 'https://www.' || source || '.gov/' AS page_url, CAST(doc_id AS INTEGER) AS pos, {_url_sql("source")} AS url, {_case("doc_id % 11", _ANCHORS)} AS anchor_text, left(text, 40) AS context
FROM documents WHERE source IS NOT NULL)"""
_HOST_SQL = "lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
_INSIDE_SQL = "(h = b OR ends_with(h, '.' || b) OR ends_with(b, '.' || h))"
_PREFILTERED = f"SELECT * FROM (SELECT *, {_HOST_SQL.format('url')} AS h, {_HOST_SQL.format('page_url')} AS b FROM ul) WHERE h <> '' AND NOT ({_SKIP_SQL}) AND ({_INSIDE_SQL} OR {_OUTSIDE_SQL})"
_SCORED_MADE = f"sc AS (SELECT *, CAST({_weights_sql('t')} AS DOUBLE) AS score FROM (SELECT *, lower(url || ' ' || anchor_text || ' ' || context) AS t FROM ul))"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda value, options: F.element_at(F.array(*[F.lit(o) for o in options]), (value + 1).cast("int"))
    docs = _t(spark, sf, "documents").where("source is not null")
    url = F.replace(F.replace(pick(F.pmod("doc_id", F.lit(9)), _PLACES), F.lit("{s}"), F.col("source")), F.lit("{i}"), F.col("doc_id").cast("string"))
    return docs.select(F.concat(F.lit("https://www."), "source", F.lit(".gov/")).alias("page_url"), F.col("doc_id").cast("int").alias("pos"), url.alias("url"), pick(F.pmod("doc_id", F.lit(11)), _ANCHORS).alias("anchor_text"), F.substring("text", 1, 40).alias("context"))


@query(f"WITH {_MADE} SELECT page_url, pos, url FROM ({_PREFILTERED})")
def prefilter_rules(spark, sf):
    """Skipped kinds, the same site and outside links worth following."""
    return links.prefilter(_links(spark, sf), F.col("page_url")).select("page_url", "pos", "url")


@query(f"WITH {_MADE}, {_SCORED_MADE} SELECT page_url, pos, score FROM sc WHERE score > 0")
def heuristic_weights(spark, sf):
    return links.heuristic_rank(_links(spark, sf)).select("page_url", "pos", "score")


@query(
    f"""WITH {_MADE}, {_SCORED_MADE}, k AS (SELECT page_url, url, pos, score, CASE WHEN score >= 0.9 THEN 'budget' WHEN score >= 0.7 THEN 'meeting' WHEN score > 0 THEN 'unheard' ELSE 'other' END AS category FROM sc),
r AS (SELECT page_url, url, pos, score, category, CAST(row_number() OVER (ORDER BY score DESC, page_url, pos) AS INTEGER) AS rank FROM k WHERE score >= 0.3)
SELECT rank, url, CASE WHEN category = 'unheard' THEN 'other' ELSE category END AS category, score >= 0.7 AS high FROM r WHERE rank <= 500"""
)
def ranked_order(spark, sf):
    """The 500 most relevant links of those that pass the score filter, in rank order, with their category."""
    score = F.col("score")
    kind = F.when(score >= 0.9, "budget").when(score >= 0.7, "meeting").otherwise("unheard")
    ranked = links.heuristic_rank(_links(spark, sf)).withColumn("category", kind).withColumn("relevance_score", score)
    top = links.by_relevance(links.in_known_category(links.by_score(ranked))).limit(500)
    placed = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("relevance_score").desc(), "page_url", "pos")))  # of the 500
    return placed.select("rank", "url", "category", (F.col("relevance_score") >= links.HIGH_SCORE).alias("high"))


# ------------------------------------------------------------------ elements of pages

_ARTICLE = "regexp_extract(html, '<article[^>]*>([\\s\\S]*?)</article>', 1)"


def _plain_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for name, sign in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_TITLE_SQL = "regexp_replace(regexp_extract(html, '<title[^>]*>([\\s\\S]*?)</title>', 1), '^\\s+|\\s+$', '', 'g')"
_DECODED_TITLE = f"replace(replace({_TITLE_SQL}, '&quot;', '\"'), '&amp;', '&')"
_MARKED = f"""mk AS (SELECT page_id, url, CASE WHEN title = '' THEN '' ELSE '# ' || title || chr(10) || chr(10) || chr(10) END || '## ' || head
|| coalesce((SELECT string_agg(chr(10) || chr(10) || chr(10) || p, '' ORDER BY i) FROM (SELECT i, {_plain_sql("ps[i]")} AS p FROM unnest(range(2, len(ps) + 1)) AS u(i)) WHERE length(p) > 10), '') AS markdown
FROM (SELECT page_id, url, {_DECODED_TITLE} AS title, {_plain_sql(f"regexp_extract({_ARTICLE}, '<h1>([{chr(92)}s{chr(92)}S]*?)</h1>', 1)")} AS head, string_split({_ARTICLE}, '<p>') AS ps FROM pages))"""


@query(f"WITH {_MARKED} SELECT page_id, markdown FROM mk")
def page_markdown(spark, sf):
    """Markdown of the main content of every page, from the tree of its elements."""
    return dom.page_markdown(crawl.titled(_t(spark, sf, "pages"))).select("page_id", "markdown")


@query(
    f"""WITH a AS (SELECT url, regexp_extract_all(html, '<a href="([^"]*)">([\\s\\S]*?)</a>', 0) AS ls FROM pages)
SELECT url AS page_url, CAST(i - 1 AS INTEGER) AS pos, {_plain_sql('ls[i]')} AS anchor_text, {_plain_sql('ls[i]')} AS context FROM a, unnest(range(1, len(ls) + 1)) AS u(i)"""
)
def page_element_links(spark, sf):
    """Links of elements; every link of the driver's pages is alone in its list item, which is its context."""
    return dom.page_links(_t(spark, sf, "pages")).select("page_url", "pos", "anchor_text", "context")


# ------------------------------------------------------------------ robots, crawling, storing

_SITES = 5


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """robots.txt of a site for each nation: a delay and two paths for all agents, others for one. Odd sites forbid a page that is not theirs."""
    number = F.col("n_nationkey") + 5 + F.pmod("n_nationkey", F.lit(2))
    lines = ["User-agent: *\nCrawl-delay: ", F.col("n_nationkey") + 1, "\nDisallow: /P", number, "x\nDisallow:\nUser-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /", F.col("n_name")]
    whole = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in lines])
    return robots_rules(_t(spark, sf, "nation").select(F.concat(F.lit("s"), "n_nationkey", F.lit(".gov")).alias("site"), whole.alias("text")))


@query("SELECT 's' || n_nationkey || '.gov' AS site, CAST((n_nationkey + 1) * 1000 AS BIGINT) AS crawl_delay, '/p' || (n_nationkey + 5 + n_nationkey % 2) || 'x,/' || lower(n_name) AS disallowed FROM nation")
def robots_of_sites(spark, sf):
    return robots_info(_rules(spark, sf)).select("site", "crawl_delay", F.array_join("disallowed", ",").alias("disallowed"))


_PAGE = "'https://s' || (c_custkey % 5) || '.gov/p' || c_custkey || 'x'"


@query(f"SELECT {_PAGE} AS url FROM customer WHERE NOT starts_with('p' || c_custkey || 'x', 'p' || (c_custkey % 5 + 5 + c_custkey % 5 % 2) || 'x')")
def robots_allowed(spark, sf):
    """URLs of five sites without those that their own site forbids; a rule of one site leaves the others alone."""
    url = F.concat(F.lit("https://s"), F.pmod("c_custkey", F.lit(_SITES)), F.lit(".gov/p"), "c_custkey", F.lit("x"))
    return allowed(_t(spark, sf, "customer").select(url.alias("url")), _rules(spark, sf))


_ORDERED = "'/p' || o_custkey"


@query(
    f"""WITH r AS (SELECT DISTINCT 's' || (o_orderkey % 5) || '.gov' AS site, {_ORDERED} AS value FROM orders WHERE o_orderkey % 3 = 0), u AS (SELECT {_PAGE} AS url, c_custkey AS k FROM customer)
SELECT url FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE site = 's' || (k % 5) || '.gov' AND starts_with('/p' || k || 'x', value))"""
)
def robots_many_rules(spark, sf):
    """The pages of five sites that forbid a path for each customer of their orders: thousands of rules a site, found by joins on prefixes."""
    orders = _t(spark, sf, "orders").where("o_orderkey % 3 = 0")
    rules = orders.select(F.concat(F.lit("s"), F.pmod("o_orderkey", F.lit(_SITES)), F.lit(".gov")).alias("site"), F.lit("disallow").alias("rule"), F.concat(F.lit("/p"), "o_custkey").alias("value"))
    url = F.concat(F.lit("https://s"), F.pmod("c_custkey", F.lit(_SITES)), F.lit(".gov/p"), "c_custkey", F.lit("x"))
    return allowed(_t(spark, sf, "customer").select(url.alias("url")), rules)


def _web(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each customer k on one of five sites: it links to k + 5 with a good word, to k + 10 with none, and to another site."""
    at = lambda k: F.concat(F.lit("https://s"), F.pmod(k, F.lit(_SITES)), F.lit(".gov/p"), k, F.lit("x"))
    key, far = F.col("c_custkey"), F.lit(" plain words between the links " * 5)
    html = F.concat(F.lit("<p><a href='"), at(key + 5), F.lit("'>budget</a>"), far, F.lit("<a href='/p"), (key + 10).cast("string"), F.lit("x'>hello</a>"), far, F.lit("<a href='"), at(key + 1), F.lit("'>budget elsewhere</a></p>"))
    return _t(spark, sf, "customer").select(key.alias("k"), at(key).alias("url"), html.alias("html"))


@query(
    """WITH RECURSIVE r(depth, k) AS (SELECT 0, c_custkey FROM customer WHERE c_custkey < 5 UNION ALL SELECT depth + 1, k + 5 FROM r WHERE depth < 3 AND k IN (SELECT c_custkey FROM customer) AND k + 5 <> k % 5 + 5 + k % 5 % 2)
SELECT depth, 'https://s' || (k % 5) || '.gov/p' || k || 'x' AS url FROM r"""
)
def crawl_with_rules(spark, sf):
    """Three levels from the first pages, by heuristic scores, within sites and under the rules of each."""
    web = _web(spark, sf)
    return crawl.by_levels(web.where("k < 5").select("url"), web.select("url", "html"), depth=3, rules=_rules(spark, sf))


# A page for each customer k on one of five sites, which links to k + 5, k + 10 and k + 15 by words that differ in weight, so
# that URLs are found several times, with scores that rise.
_WORDS = {"budget": 0.9, "bidding": 0.85, "finance": 0.8, "agenda": 0.7, "contact": 0.6, "staff": 0.55, "hello": 0.0}
_ROUNDS, _PER_ROUND, _PER_HOST, _PAGES, _DEPTH = 8, 20, 5, 120, 12


def _weighted_web(spark: SparkSession, sf: str) -> DataFrame:
    key, far = F.col("c_custkey"), F.lit(" plain words between the links " * 5)
    at = lambda k: F.concat(F.lit("https://s"), F.pmod(k, F.lit(_SITES)), F.lit(".gov/p"), k, F.lit("x"))
    word = lambda n: F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.pmod(key * n + F.floor(key / 5), F.lit(len(_WORDS))) + 1).cast("int"))
    link = lambda n: F.concat(F.lit("<a href='"), at(key + 5 * n), F.lit("'>"), word(n), F.lit("</a>"), far)
    return _t(spark, sf, "customer").where("c_custkey % 11 <> 7 or c_custkey < 5").select(key.alias("k"), at(key).alias("url"), F.concat(F.lit("<p>"), *[link(n) for n in (1, 2, 3)], F.lit("</p>")).alias("html"))


def _frontier_sql() -> str:
    """The rounds one after the other: what each takes (t), what its links add (f), and what waits then (w)."""
    weights = "[" + ", ".join(str(w) for w in _WORDS.values()) + "]"
    step = f"""t{{r}} AS MATERIALIZED (
  SELECT *, k IN (SELECT k FROM page) AS read FROM (SELECT * FROM w{{r}} QUALIFY row_number() OVER (PARTITION BY k % 5 ORDER BY score DESC, first, url) <= {_PER_HOST})
  QUALIFY row_number() OVER (ORDER BY score DESC, first, url) <= least({_PER_ROUND}, {_PAGES} - coalesce((SELECT sum(CASE WHEN read THEN 1 ELSE 0 END) FROM ({{before}})), 0))),
f{{r}} AS (SELECT k + 5 * n AS k, {weights}[(k * n + k // 5) % {len(_WORDS)} + 1] AS score, depth + 1 AS depth, {{r}} + 1 AS first FROM t{{r}}, unnest([1, 2, 3]) AS u(n) WHERE read AND depth < {_DEPTH}),
w{{n}} AS MATERIALIZED (
  SELECT k, 'https://s' || (k % 5) || '.gov/p' || k || 'x' AS url, max(score) AS score, -max((score, -depth))[2] AS depth, min(first) AS first
  FROM (SELECT k, score, depth, first FROM w{{r}} UNION ALL SELECT k, score, depth, first FROM f{{r}} WHERE score >= 0.5)
  WHERE k NOT IN (SELECT k FROM ({{all}})) GROUP BY k),
"""
    taken = lambda r: " UNION ALL ".join(f"SELECT k, read FROM t{i}" for i in range(r)) or "SELECT 0 AS k, false AS read WHERE false"
    rounds = "".join(step.format(r=r, n=r + 1, before=taken(r), all=taken(r + 1)) for r in range(_ROUNDS))
    every = " UNION ALL ".join(f"SELECT {r} AS round, url, score, depth, read FROM t{r}" for r in range(_ROUNDS))
    return f"""WITH page AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 <> 7 OR c_custkey < 5),
w0 AS (SELECT k, 'https://s' || (k % 5) || '.gov/p' || k || 'x' AS url, 0.0 AS score, 0 AS depth, 0 AS first FROM page WHERE k < 5),
{rounds}e AS ({every})
SELECT CAST(round AS INTEGER) AS round, url, CAST(score AS DOUBLE) AS score, CAST(depth AS INTEGER) AS depth, read FROM e"""


@query(_frontier_sql())
def crawl_best_first(spark, sf):
    """The best 120 pages within twelve links of the first ones, twenty to a round and five of them of a site; it stops once and goes on."""
    web = _weighted_web(spark, sf)
    crawling = frontier.Frontier(f"{Scratch(spark).base}/crawl", web.where("k < 5").select("url"), web.select("url", "html"))
    for rounds in (3, _ROUNDS - 3):
        crawling.run(_PAGES, _DEPTH, _PER_ROUND, _PER_HOST, rounds=rounds)
    return crawling.taken().select("round", "url", "score", "depth", "read")


@query(
    f"""WITH {_MARKED}, one AS (SELECT *, {_bare_sql('url')} AS bare FROM mk QUALIFY row_number() OVER (PARTITION BY bare ORDER BY url) = 1)
SELECT bare AS url, md5(markdown) AS content, CAST(ceil(length(markdown) / 4.0) AS BIGINT) AS least_tokens FROM one WHERE length(markdown) >= 200 AND length(regexp_replace(markdown, '^\\s+|\\s+$', '', 'g')) >= 50"""
)
def scrape_store(spark, sf):
    """All pages crawled from themselves and stored as documents of their sites, with their chunks."""
    pages = _t(spark, sf, "pages").select("url", "html")
    return crawl.scraped(pages.select("url"), pages, Scratch(spark).base, HashedEmbedding(8), RuleModel(), depth=0, rules=_rules(spark, sf)).read("documents").select(
        "url", F.md5("content").alias("content"), F.ceil(F.length("content") / 4).alias("least_tokens")
    )


# ------------------------------------------------------------------ whole lists of text

_SENTENCES_SQL = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\\S'))"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, xs[i] AS sentence FROM (SELECT doc_id, {_SENTENCES_SQL} AS xs FROM documents), unnest(range(1, len(xs) + 1)) AS u(i)")
def sentences(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("place", "sentence"))


_SPACED = "regexp_replace(text, '\\n', chr(10) || chr(10), 'g')"


@query(
    f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, xs[i] AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({_SPACED}, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS xs FROM documents),
unnest(range(1, len(xs) + 1)) AS u(i)"""
)
def paragraphs(spark, sf):
    """Paragraphs of the documents with a blank line after every line."""
    spaced = F.regexp_replace("text", "\n", "\n\n")
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(text.split_paragraphs(spaced)).alias("place", "paragraph"))
