"""A best-first crawl whose frontier is a table.

In rounds: the best waiting URLs are taken, as many as a round, a host and the limit on pages
allow; their pages are read and their links join the frontier, where a URL that is found again
keeps its best score. With one URL to a round that is the strict order of scores; larger rounds
read more pages at once and look at their links together afterwards.

The state lies below ``root``, a table for each round, so a crawl that stops goes on from its last whole round:

* ``waiting/round=n``: url, host, score, depth, first (the round that found it), before round n takes from it
* ``taken/round=n``:   the rows that round n took, with ``read``: whether there was a page

A URL waits once, with its best score (of equal ones the smallest depth), and is taken once. Nothing but
counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, normalize_url, same_site
from ..operators.links import FOLLOW_SCORE, dedupe_links, extract_links, heuristic_rank, prefilter
from ..operators.robots import allowed
from ..operators.writes import first_page
from ..runtime import Scratch

#: URLs of a round and, of those, of one host; pages in all.
PER_ROUND, PER_HOST, PAGES = 1000, 100, 50
#: Up to so many URLs of a round are sent to the table of pages.
BROADCAST_URLS = 50_000
_WAITING = "url string, host string, score double, depth int, first int"


def scored_links(pages: DataFrame) -> DataFrame:
    """The links of pages that are worth following, with their heuristic score as relevance_score."""
    found = prefilter(dedupe_links(extract_links(pages)), F.col("page_url"))
    return heuristic_rank(found).withColumn("relevance_score", F.col("score"))


def next_urls(waiting: DataFrame, most: int, per_host: int) -> DataFrame:
    """The best ``most`` rows, at most ``per_host`` of a host: by score, then the round that found them, then URL.

    Each task keeps its own best of a host before hosts are gathered, so a host with a third of the frontier costs no more.
    """
    best = [F.col("score").desc(), "first", "url"]
    own = waiting.withColumn("_place", F.row_number().over(Window.partitionBy("host").orderBy(*best))).where(F.col("_place") <= per_host)
    return own.drop("_place").orderBy(*best).limit(most)


def merged(waiting: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each URL: its best score, the smallest depth that has it, and the first round that found it."""
    best = F.max(F.struct("score", (-F.col("depth")).alias("d"))).alias("best")
    both = waiting.unionByName(found).groupBy("url").agg(best, F.min("first").alias("first"))
    return both.select("url", host(F.col("url")).alias("host"), "best.score", (-F.col("best.d")).cast("int").alias("depth"), "first")


class Frontier:
    """The crawl below ``root``, from the pages of a table (or of whatever ``read`` makes of a table of URLs)."""

    def __init__(self, root: str, seeds: DataFrame, read: DataFrame | Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame] = scored_links, rules: DataFrame | None = None):
        """seeds: (url). read: pages (url, html), or a function from (url) to them. rank: links of pages with page_url, url and relevance_score."""
        self.spark, self.root = seeds.sparkSession, root.rstrip("/")
        self.seeds, self.rank, self.rules = seeds, rank, rules
        self.read = read if callable(read) else self._of_table(read)

    @staticmethod
    def _of_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
        web = pages.select(normalize_url(F.col("url")).alias("key"), "url", "html")

        def read(urls: DataFrame) -> DataFrame:
            asked = urls.select(F.col("url").alias("key"))
            asked = F.broadcast(asked) if asked.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS else asked  # else the pages are shuffled, html and all
            return first_page(web.join(asked, "key", "left_semi"), "key").select(F.col("key").alias("url"), "html")

        return read

    # ------------------------------------------------------------------ state

    def _path(self, name: str, at: int) -> str:
        return f"{self.root}/{name}/round={at}"

    def _whole(self, name: str, at: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name, at)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _saved(self, df: DataFrame, name: str, at: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, at))
        return self._table(name, at)

    def _table(self, name: str, at: int) -> DataFrame:
        return self.spark.read.schema(_WAITING + (", read boolean" if name == "taken" else "")).parquet(self._path(name, at))

    def rounds(self) -> int:
        """Rounds whose outcome is whole."""
        at = 0
        while self._whole("waiting", at + 1):
            at += 1
        return at

    def taken(self) -> DataFrame:
        """round, url, host, score, depth, read of all URLs taken in whole rounds."""
        at = self.rounds()
        none = self.spark.createDataFrame([], f"round int, {_WAITING}, read boolean").drop("first")
        if not at:
            return none
        every = self.spark.read.schema(f"{_WAITING}, read boolean, round int").parquet(*[self._path("taken", i) for i in range(at)]) if at == 1 else None
        every = every if every is not None else self.spark.read.option("basePath", f"{self.root}/taken").schema(f"{_WAITING}, read boolean, round int").parquet(*[self._path("taken", i) for i in range(at)])
        return every.withColumn("round", F.coalesce("round", F.lit(0))).select("round", "url", "host", "score", "depth", "read")

    def failed(self) -> bool:
        """Fewer than two pages for every URL that could not be read."""
        row = self.taken().agg(F.count_if("read").alias("pages"), F.count_if(~F.col("read")).alias("errors")).first()
        return row["errors"] > row["pages"] / 2

    # ------------------------------------------------------------------ rounds

    def run(self, pages: int = PAGES, depth: int = 2, per_round: int = PER_ROUND, per_host: int = PER_HOST, least: float = FOLLOW_SCORE, rounds: int | None = None) -> DataFrame:
        """Go on until ``pages`` are read or nothing waits (or for so many rounds); returns ``taken()``.

        Links count that stay on their page's site and score ``least``; those of pages at the greatest depth are not looked at.
        URLs without a page are taken and count as errors, not as pages. Forbidden URLs never wait, seeds included.
        """
        if pages < 1 or per_round < 1 or per_host < 1:
            raise ValueError("pages, per_round and per_host must be positive")
        if not self._whole("waiting", 0):
            start = self.seeds.select(normalize_url(F.col("url")).alias("url")).where("url is not null").distinct()
            start = start if self.rules is None else allowed(start, self.rules)
            self._saved(start.select("url", host(F.col("url")).alias("host"), F.lit(0.0).alias("score"), F.lit(0).alias("depth"), F.lit(0).alias("first")), "waiting", 0)
        at = self.rounds()
        had = self.taken().where("read").count()
        last = None if rounds is None else at + rounds
        while had < pages and (last is None or at < last):
            read = self._round(at, min(per_round, pages - had), depth, per_host, least)
            if read is None:
                break
            had += read
            at += 1
        return self.taken()

    def _round(self, at: int, most: int, depth: int, per_host: int, least: float) -> int | None:
        """Pages read, or None if nothing waits."""
        waiting, scratch, got = self._table("waiting", at), Scratch(self.spark), None
        if not self._whole("taken", at):  # else a run stopped between the two tables of this round
            chosen = scratch.save(next_urls(waiting, most, per_host))
            got = scratch.save(self.read(chosen.select("url")))  # the pages are looked through once for a round
            has = got.select("url").distinct().withColumn("read", F.lit(True))
            self._saved(chosen.join(has, "url", "left").select(*chosen.columns, F.coalesce("read", F.lit(False)).alias("read")), "taken", at)
        now = self._table("taken", at)
        urls, pages = now.agg(F.count("*"), F.count_if("read")).first()
        if not urls:
            return None
        got = got if got is not None else self.read(now.where("read").select("url"))
        from_pages = now.where(F.col("read") & (F.col("depth") < depth)).select(F.col("url").alias("page_url"), F.col("depth").alias("page_depth"))
        links = self.rank(got.join(from_pages.select(F.col("page_url").alias("url")), "url", "left_semi"))
        links = links.where((F.col("relevance_score") >= least) & same_site(host(F.col("page_url")), host(F.col("url"))))
        links = links.select("page_url", normalize_url(F.col("url")).alias("url"), "relevance_score").where("url is not null")
        found = links.join(from_pages, "page_url").groupBy("url").agg(F.max(F.struct(F.col("relevance_score").alias("s"), (-F.col("page_depth")).alias("d"))).alias("m"))
        found = found.select("url", F.lit(None).cast("string").alias("host"), F.col("m.s").cast("double").alias("score"), (1 - F.col("m.d")).cast("int").alias("depth"), F.lit(at + 1).alias("first"))
        if self.rules is not None:
            found = allowed(found, self.rules)
        done = self.spark.read.schema(_WAITING).parquet(*[self._path("taken", i) for i in range(at + 1)]).select("url")
        self._saved(merged(waiting, found).join(done, "url", "left_anti"), "waiting", at + 1)
        return pages
