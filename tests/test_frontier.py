"""The table frontier against a heap, its limits, and a crawl that fails and goes on."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from textquarry.plans import frontier
from textquarry.plans.frontier import Frontier


def site(url):
    return url.split("/")[2]


def heap_crawl(web, seeds, pages, depth, least):
    """One page after the other, by score, then the round it was found in, then URL."""
    best = {u: (0.0, 0, 0) for u in seeds}
    out, seen, at = [], set(), 0
    while best and sum(r for _, r in out) < pages:
        heap = [(-s, first, u, d) for u, (s, d, first) in best.items()]
        heapq.heapify(heap)
        _, _, url, d = heap[0]
        del best[url]
        seen.add(url)
        at += 1
        out.append((url, url in web))
        for link, score in web.get(url, []) if d < depth else []:
            if score >= least and link not in seen and site(link) == site(url):
                s, e, first = best.get(link, (-1.0, 0, at))
                best[link] = max((s, -e), (score, -d - 1))[0], -max((s, -e), (score, -d - 1))[1], first
    return out


def random_web(seed):
    rnd = random.Random(seed)
    urls = [f"https://s{i % 3}.gov/p{i}" for i in range(60)]
    return {u: [(rnd.choice(urls), rnd.choice([0.2, 0.5, 0.6, 0.9])) for _ in range(8)] for u in urls if rnd.random() < 0.85}, urls


def tables(spark, web):
    pages = spark.createDataFrame([(u, ";".join(f"{v} {s}" for v, s in links)) for u, links in web.items()], "url string, html string")

    def rank(read):
        each = read.select(F.col("url").alias("page_url"), F.explode(F.split("html", ";")).alias("l")).where("l <> ''")
        return each.select("page_url", F.split("l", " ")[0].alias("url"), F.split("l", " ")[1].cast("double").alias("relevance_score"))

    return pages, rank


def in_order(taken):
    rows = sorted(taken.collect(), key=lambda r: (r["round"], -r.score, r.url))
    return [(r.url, r["read"]) for r in rows]


@pytest.mark.parametrize("seed, pages, depth", [(1, 12, 3), (2, 9, 1)])
def test_one_a_round_is_the_order_of_a_heap(spark, tmp_path, seed, pages, depth):
    """Rising scores, unread pages, a limit on pages that binds."""
    web, urls = random_web(seed)
    df, rank = tables(spark, web)
    seeds = spark.createDataFrame([(u,) for u in urls[:3]], "url string")
    got = Frontier(str(tmp_path), seeds, df, rank).run(pages, depth, per_round=1)
    assert in_order(got) == heap_crawl(web, urls[:3], pages, depth, 0.5)


def test_limits(spark, tmp_path):
    """No more than a round, a host and the crawl allow; a URL is taken once."""
    web, urls = random_web(3)
    df, rank = tables(spark, web)
    got = Frontier(str(tmp_path), spark.createDataFrame([(u,) for u in urls[:9]], "url string"), df, rank).run(20, 9, per_round=5, per_host=2).collect()
    assert sum(r["read"] for r in got) == 20 and len({r.url for r in got}) == len(got)
    for at in {r["round"] for r in got}:
        hosts = [r.host for r in got if r["round"] == at]
        assert len(hosts) <= 5 and max(map(hosts.count, hosts)) <= 2


@pytest.mark.parametrize("table", ["taken", "waiting"])
def test_goes_on_after_a_failure(spark, tmp_path, monkeypatch, table):
    """A run that fails while either table of a round is written goes on as if it had not."""
    web, urls = random_web(4)
    df, rank = tables(spark, web)
    seeds = spark.createDataFrame([(u,) for u in urls[:3]], "url string")
    want = in_order(Frontier(str(tmp_path / "a"), seeds, df, rank).run(15, 5, per_round=4))
    saved = Frontier._saved

    def failing(self, rows, name, at):
        if name == table and at == 2:
            saved(self, rows.where("false"), name, at)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name, at)}/_SUCCESS")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
            raise OSError("lost")
        return saved(self, rows, name, at)

    monkeypatch.setattr(Frontier, "_saved", failing)
    with pytest.raises(OSError):
        Frontier(str(tmp_path / "b"), seeds, df, rank).run(15, 5, per_round=4)
    monkeypatch.setattr(Frontier, "_saved", saved)
    assert in_order(Frontier(str(tmp_path / "b"), seeds, df, rank).run(15, 5, per_round=4)) == want


def test_odd_inputs(spark, tmp_path):
    df, rank = tables(spark, {})
    none = Frontier(str(tmp_path / "none"), spark.createDataFrame([], "url string"), df, rank)
    assert none.run().count() == 0 and not none.failed()
    lost = Frontier(str(tmp_path / "lost"), spark.createDataFrame([("https://a.gov/x",), ("https://a.gov/x#y",), (None,)], "url string"), df, rank)
    assert [(r.url, r["read"]) for r in lost.run().collect()] == [("https://a.gov/x", False)] and lost.failed()
    with pytest.raises(ValueError):
        none.run(pages=0)


def test_hot_host_is_cut_before_the_shuffle(spark):
    waiting = spark.range(1000).select(F.concat(F.lit("https://h.gov/"), "id").alias("url"), F.when(F.col("id") < 900, "h.gov").otherwise("o.gov").alias("host"), (F.col("id") % 7).cast("double").alias("score"), F.lit(0).alias("depth"), F.lit(0).alias("first"))
    plan = frontier.next_urls(waiting, 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")


def test_pages_are_read_once_for_a_round(spark, tmp_path):
    asked = []

    def read(urls):
        asked.append(1)
        return urls.select("url", F.lit("<p>no links</p>").alias("html"))

    seeds = spark.createDataFrame([("https://a.gov/1",), ("https://a.gov/2",)], "url string")
    got = Frontier(f"{tmp_path}/crawl", seeds, read).run(pages=2, depth=1, per_round=2, rounds=1)
    assert got.where("read").count() == 2 and len(asked) == 1
