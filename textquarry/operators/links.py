"""Links of pages: extraction, deduplication, filters, heuristic scores, batches and groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_html, without_machine_parts
from ..functions.urls import below, host, is_url, let, resolve
from ..schemas import CATEGORIES, category_dimension

ANCHOR = "(?i)<a\\s+(?:[^>]*?\\s+)?href=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</a>"
#: References that lead to no page.
NO_PAGE = "^(?:javascript:|mailto:|tel:|#)"
#: Characters of context on each side of a link; of the shortest link, <a href="x"></a>.
AROUND, SHORTEST = 100, 16

# Links never followed, outside links worth following, weights of words in a link.
SKIPPED = [
    "(?i)\\.(jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|eot)$", "(?i)^https?://(www\\.)?(facebook|twitter|instagram|linkedin|youtube|tiktok)\\.", "(?i)/share\\?", "(?i)/login", "(?i)/signin", "(?i)/signup", "(?i)/cart", "(?i)/search\\?", "(?i)\\?utm_",
]
OUTSIDE = ["(?i)\\.gov/", "(?i)\\.edu/", "(?i)budget", "(?i)finance", "(?i)procurement", "(?i)rfp", "(?i)bid"]
WEIGHTS = {
    "budget": 0.9, "acfr": 0.95, "annual.*financial.*report": 0.95, "financial.*report": 0.85, "finance": 0.8, "treasurer": 0.8, "cfo|chief.*financial": 0.85, "procurement": 0.9, "rfp|rfq|rfi": 0.95, "bid|bidding": 0.85,
    "solicitation": 0.9, "vendor": 0.7, "contract": 0.75, "contact": 0.6, "directory": 0.65, "staff": 0.55, "agenda": 0.7, "minutes": 0.7, "board.*meeting": 0.75, "council.*meeting": 0.75, "\\.pdf$": 0.5, "document": 0.5,
    "capital.*project": 0.85, "capital.*improvement": 0.85,
}
MIN_SCORE, FOLLOW_SCORE, HIGH_SCORE, BATCH = 0.3, 0.5, 0.7, 50


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per link of a page, in order: page_url, pos, href, url, anchor_text, context, title, rel, type.

    A page is split at its links, and a link's context is cut from the pieces around it, so a row
    carries its own link and context only, and a page costs time in proportion to its length. The
    URL is generated, so that filters on it do not repeat the expression that resolves it.
    """
    found = pages.select(F.col(url).alias("page_url"), without_machine_parts(F.col(html)).alias("clean"))
    found = found.select("page_url", F.regexp_extract_all("clean", F.lit(ANCHOR), F.lit(0)).alias("links"), F.split("clean", ANCHOR).alias("between"))
    # What stands around link i: the nearest AROUND characters of the page on each side. Links are no shorter than their
    # own tags, so a few neighbours hold them.
    near = -(-AROUND // SHORTEST) + 1
    sides = F.struct(F.col("links").alias("l"), F.col("between").alias("b"))

    def around(s: Column, i: Column) -> Column:
        piece = lambda name, at: F.coalesce(F.get(s[name], at), F.lit(""))
        most = F.lit(AROUND)
        before = F.concat(*[F.right(piece(name, i - (k + 1 if name == "l" else k)), most) for k in range(near, -1, -1) for name in ("l", "b")])
        after = F.concat(*[F.left(piece(name, i + 1 + k), most) for k in range(near + 1) for name in ("b", "l")])
        link = F.get(s["l"], i)
        return F.struct(i.alias("nth"), link.alias("link"), F.concat(F.right(before, most), link, F.left(after, most)).alias("cut"))

    rows = let(sides, lambda s: F.transform(F.sequence(F.lit(0), F.size(s["l"]) - 1), lambda i: around(s, i)))
    found = found.where(F.size("links") > 0).select("page_url", F.inline(rows))
    found = found.withColumn("href", F.regexp_extract("link", ANCHOR, 1)).where(~F.col("href").rlike(NO_PAGE))
    context = strip_html(F.col("cut"))
    text = strip_html(F.regexp_extract("link", ANCHOR, 2))
    attribute = lambda name: F.nullif(F.regexp_extract("link", f"(?i){name}=[\"']([^\"']+)[\"']", 1), F.lit(""))
    out = found.select(
        "page_url", F.col("nth").alias("pos"), "href", F.explode(F.array(resolve(F.col("href"), F.col("page_url")))).alias("url"), F.when(text == "", F.col("href")).otherwise(text).alias("anchor_text"), context.alias("context"),
        *[attribute(a).alias(a) for a in ("title", "rel", "type")],
    )
    return out.where("url is not null")


def dedupe_links(links: DataFrame, page: str = "page_url", pos: str = "pos") -> DataFrame:
    """The link of longest context for each URL of a page, the first of equals; ``pos`` is where the URL came first.

    Where two pages have one URL, links of one context length and place go by their context and anchor text.
    """
    own = Window.partitionBy(page, "url")
    best = links.withColumn("rank", F.row_number().over(own.orderBy(F.length("context").desc(), pos, "context", "anchor_text"))).withColumn("first", F.min(pos).over(own))
    return best.where("rank = 1").drop("rank", pos).withColumnRenamed("first", pos)


def prefilter(links: DataFrame, base: Column) -> DataFrame:
    """Links that are not skipped and lead to the same site, or look worth following elsewhere."""
    any_of = lambda patterns: F.col("url").rlike("|".join(f"(?:{p})" for p in patterns))
    inside = below(host(F.col("url")), host(base))
    return links.where(is_url(F.col("url")) & ~any_of(SKIPPED) & (inside | any_of(OUTSIDE)))


def heuristic_score(url: Column, anchor: Column, context: Column) -> Column:
    """The largest weight of the words that occur; 0 if none does."""
    text = F.lower(F.concat_ws(" ", url, anchor, context))
    return F.greatest(F.lit(0.0), *[F.when(text.rlike(p.replace("$", "\\z")), w).otherwise(0.0) for p, w in WEIGHTS.items()])


def heuristic_rank(links: DataFrame) -> DataFrame:
    """Links of a positive score, with the column score."""
    return links.withColumn("score", heuristic_score(F.col("url"), F.col("anchor_text"), F.col("context"))).where("score > 0")


def heuristic_only(links: DataFrame) -> DataFrame:
    """Ranks without a model: every survivor scores one half."""
    return links.withColumns({"relevance_score": F.lit(0.5), "category": F.lit("other"), "rationale": F.lit("Heuristic match")})


def rank_batches(links: DataFrame, order: list[Column], group: str = "page_url", size: int = BATCH) -> DataFrame:
    """batch and index (in the batch) of links in rank order, for each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return links.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size).cast("int")).withColumn("index", F.pmod("place", F.lit(size)).cast("int")).drop("place")


def rank_links(links: DataFrame, rank: Callable[[list[dict]], list[dict]], group: str = "page_url") -> DataFrame:
    """Links ranked by a model, a call for each batch.

    rank takes the links of a batch and returns records of schemas.RANKING. Links it leaves out
    vanish, indices out of range are ignored, and a batch that fails scores 0.1 as a whole.
    """
    import pandas as pd

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema)

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("index", kind="stable").reset_index(drop=True)
        try:
            found = [r for r in rank(batch.to_dict("records")) if 0 <= r["index"] < len(batch)]
        except Exception:  # a provider's failure costs one batch its ranks
            found = [{"index": i, "relevance_score": 0.1, "category": "other", "rationale": "Error during ranking"} for i in range(len(batch))]
        out = batch.iloc[[r["index"] for r in found]].reset_index(drop=True)
        for name in ("relevance_score", "category", "rationale"):
            out[name] = [r.get(name) for r in found]
        return out

    return links.groupBy(group, "batch").applyInPandas(one, f"{fields}, relevance_score double, category string, rationale string")


def by_score(links: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return links.where(F.col("relevance_score") >= least)


def in_known_category(links: DataFrame) -> DataFrame:
    """links, an unknown category counting as other."""
    return links.withColumn("category", F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("other"))


def group_by_category(links: DataFrame) -> DataFrame:
    """All ten categories in order with their numbers of links and of distinct URLs. The links of one: in_known_category, filtered."""
    per_url = in_known_category(links).groupBy("category", "url").agg(F.count("*").alias("n"))  # URLs first, so that a category is no group of rows
    counts = per_url.groupBy("category").agg(F.sum("n").alias("n_links"), F.count("url").alias("n_urls"))
    known = category_dimension(links.sparkSession)
    return known.join(F.broadcast(counts), "category", "left").select("place", "category", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


def by_relevance(links: DataFrame) -> DataFrame:
    """Ranked links, the most relevant first; equal ones as they stand on their pages, and by URL where two pages have one."""
    return links.orderBy(F.col("relevance_score").desc(), "page_url", "pos", "url")


def high_value(links: DataFrame, least: float = HIGH_SCORE) -> DataFrame:
    """The number of links of at least this score, and of all."""
    return links.agg(F.count_if(F.col("relevance_score") >= least).alias("n_high"), F.count("*").alias("n_links"))
