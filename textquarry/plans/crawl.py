"""Crawling a table of pages from seeds level by level, and storing what is found.

Every page of a depth is read before any of the next, as joins. ``frontier`` reads the pages of the
best scores first, under limits. Forbidden paths are not read in either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_title
from ..functions.urls import host, normalize_url, org_id, same_site, url_id
from ..operators.chunking import Count, estimate
from ..operators.dom import page_markdown
from ..operators.links import FOLLOW_SCORE, dedupe_links, extract_links, heuristic_only, heuristic_rank, prefilter
from ..operators.robots import allowed
from ..operators.writes import first_page
from ..providers import EmbeddingProvider, LanguageProvider
from ..runtime import Scratch
from .ingest import Warehouse, ingest


def ranked_links(pages: DataFrame, heuristic: bool = True) -> DataFrame:
    """The links of pages that are worth following, with relevance_score, category and rationale."""
    found = prefilter(dedupe_links(extract_links(pages)), F.col("page_url"))
    return heuristic_only(heuristic_rank(found) if heuristic else found)


def by_levels(
    seeds: DataFrame, pages: DataFrame, depth: int = 2, least: float = FOLLOW_SCORE, rules: DataFrame | None = None, rank: Callable[[DataFrame], DataFrame] = ranked_links, pick: Callable[[DataFrame, str], DataFrame] = first_page
) -> DataFrame:
    """(depth, url) of all URLs reached, each at its least depth. seeds: (url); pages: (url, html).

    A page's links lead on within its own site; URLs already reached are left out by an anti
    join. Every level is written to the shared folder, so that the next one reads its rows and
    does not extract the links again. Rules, with the site they are of, hold for seeds too. pick
    says which of the pages of a URL are read: one (``first_page``) or all (``pages_of_first_url``).
    """
    scratch = Scratch(pages.sparkSession)
    level = seeds.select(normalize_url(F.col("url")).alias("url")).distinct()
    if rules is not None:
        level = scratch.save(allowed(level, rules))
    web = pages.withColumn("key", normalize_url(F.col("url")))
    reached = level.withColumn("depth", F.lit(0))
    for at in range(1, depth + 1):
        read = pick(web.join(level.select(F.col("url").alias("key")), "key", "left_semi"), "key")
        links = rank(read).where((F.col("relevance_score") >= least) & same_site(host(F.col("page_url")), host(F.col("url"))))
        found = links.select(normalize_url(F.col("url")).alias("url")).distinct()
        if rules is not None:
            found = allowed(found, rules)
        level = scratch.save(found.join(reached.select("url"), "url", "left_anti"))
        reached = reached.unionByName(level.withColumn("depth", F.lit(at)))
    return reached.select("depth", "url")


def scraped(
    seeds: DataFrame, pages: DataFrame, root: str, embeddings: EmbeddingProvider, model: LanguageProvider, depth: int = 2, rules: DataFrame | None = None, rank: Callable[[DataFrame], DataFrame] = ranked_links, count: Count = estimate
) -> Warehouse:
    """Crawl from seeds under the rules, and store what is found as documents of their sites in the tables below root.

    The entity of a site is made if it is not there and is told more from its pages; pages whose
    markdown is short, and those already stored, are left out; the others are enriched as
    ingested documents are. The page that is read for a URL is the first of those
    that normalise to it (``first_page``), the same for its links and for what is stored, in whatever order the pages lie.
    """
    reached = by_levels(seeds, pages, depth, rules=rules, rank=rank)
    web = first_page(pages.withColumn("key", normalize_url(F.col("url"))).join(reached.select(F.col("url").alias("key")), "key", "left_semi"), "key")
    found = storable(page_markdown(titled(web)))
    site = org_id(F.col("key"))
    corpus = found.select(site.alias("entity"), F.col("key").alias("file"), F.col("key").alias("url"), site.alias("org_id"), url_id(F.col("key")).alias("url_id"), F.col("markdown").alias("text"), F.lit(None).cast("string").alias("corrupt"))
    warehouse = Warehouse(pages.sparkSession, root)
    ingest(Scratch(pages.sparkSession).save(corpus), warehouse, embeddings, model, f"{root}/_staging", count)
    return warehouse


def storable(pages: DataFrame, least: int = 200) -> DataFrame:
    """Pages whose markdown is long enough to be stored as documents."""
    return pages.where(F.length("markdown") >= least)


def titled(pages: DataFrame) -> DataFrame:
    return pages.withColumn("title", page_title(F.col("html")))
