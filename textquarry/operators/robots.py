"""Rules of robots.txt: who they are for, what they forbid, how long to wait."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..functions.urls import host, is_url, path


def robots_rules(robots: DataFrame, site: str = "site", text: str = "text") -> DataFrame:
    """The lines of the group for all agents, in order: site, line, rule (crawl-delay or disallow), value.

    The group of a line is the last user-agent line above it; everything is lower case. A delay is
    in milliseconds; one that is no number, and an empty path, are no rules.
    """
    lines = robots.select(site, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).withColumn("raw", F.lower(js_trim(F.col("raw"))))
    agent = F.when(F.col("raw").startswith("user-agent:"), js_trim(F.regexp_replace("raw", "^user-agent:", "")))
    so_far = F.last_value(agent, F.lit(True)).over(Window.partitionBy(site).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rule = F.regexp_extract("raw", "^(crawl-delay|disallow):", 1)
    value = js_trim(F.regexp_replace("raw", "^(?:crawl-delay|disallow):", ""))
    delay = F.concat(F.regexp_extract(value, "^[+-]?[0-9]+", 0), F.lit("000"))
    found = lines.withColumn("agent", so_far).where("agent = '*'").withColumn("rule", rule).withColumn("value", F.when(rule == "disallow", value).when(delay != "000", delay).otherwise(""))
    return found.where("rule <> '' and value <> ''").select(site, "line", "rule", "value")


def robots_info(rules: DataFrame, site: str = "site") -> DataFrame:
    """site, crawl_delay (the last one's milliseconds), disallowed (paths in order)."""
    own = F.sort_array(F.collect_list(F.when(F.col("rule") == "disallow", F.struct("line", "value"))))
    return rules.groupBy(site).agg(F.max_by(F.when(F.col("rule") == "crawl-delay", F.col("value").cast("long")), F.when(F.col("rule") == "crawl-delay", F.col("line"))).alias("crawl_delay"), F.transform(own, lambda x: x["value"]).alias("disallowed"))


#: A site with more paths than this is asked by joins on prefixes; the paths of others are an array beside their URLs.
FEW = 64


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url", site: str = "site", few: int = FEW) -> DataFrame:
    """The URLs whose path begins with no path that their own site forbids; what is no URL is not allowed.

    A site is a host. Rules are lower case, so paths are compared in lower case: a rule may
    forbid more than it says, never less. Of a site with very many paths no URL looks at more
    than one for each length that they have: "begins with one of them" is a join of the URL's own
    beginnings, of those lengths, with the paths.
    """
    paths = rules.where("rule = 'disallow'").select(F.lower(site).alias("_site"), F.lower("value").alias("_path")).distinct()
    sizes = paths.groupBy("_site").agg(F.count("*").alias("_n"))
    good = urls.where(is_url(F.col(url))).withColumn("_site", host(F.col(url)))
    forbidden = paths.join(sizes.where(F.col("_n") <= few), "_site", "left_semi").groupBy("_site").agg(F.collect_list("_path").alias("_forbidden"))
    hit = F.exists("_forbidden", lambda rule: F.lower(path(F.col(url))).startswith(rule))
    out = good.join(forbidden, "_site", "left").where(~F.coalesce(hit, F.lit(False)))
    many = sizes.where(F.col("_n") > few).select("_site")
    if not many.isEmpty():
        out = out.join(_under(good, paths.join(many, "_site", "left_semi"), url), url, "left_anti")
    return out.select(*urls.columns)


def _under(urls: DataFrame, paths: DataFrame, url: str) -> DataFrame:
    """The distinct URLs (with _site) whose path begins with one of the paths (_site, _path) of their site."""
    lengths = paths.groupBy("_site").agg(F.collect_set(F.length("_path")).alias("_lengths"))  # at most as many as the longest path is long
    asked = urls.select(url, "_site").distinct().withColumn("_whole", F.lower(path(F.col(url)))).join(lengths, "_site")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_whole"))
    begun = asked.select(url, "_site", "_whole", F.explode(fitting).alias("_length")).withColumn("_path", F.expr("left(_whole, _length)"))
    return begun.join(paths, ["_site", "_path"], "left_semi").select(url).distinct()
