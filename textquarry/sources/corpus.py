"""Corpora and tables as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import long_enough
from ..functions.urls import host, website
from ..schemas import RAW_DOCUMENT

#: Characters that a document needs, trimmed; that a crawled page needs.
DOCUMENT_CHARS, PAGE_CHARS = 50, 200
# Seconds to wait for a page, for robots.txt.
PAGE_SECONDS, ROBOTS_SECONDS = 30.0, 10.0


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per JSON file under the folders of root: entity (the folder), file, the fields, and corrupt.

    Files that hold no such object have their text in corrupt; they are rows, not failures.
    """
    schema = T.StructType([*RAW_DOCUMENT.fields, T.StructField("corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("pathGlobFilter", "*.json").json(f"{root}/*")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.element_at(parts, -2).alias("entity"), F.col("_metadata.file_path").alias("file"), *schema.fieldNames())


def split_rejects(corpus: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects with a reason): broken files, short texts and, given entities, unknown ones."""
    reason = F.when(F.col("corrupt").isNotNull() | F.col("url").isNull(), "malformed").when(~long_enough(F.col("text"), DOCUMENT_CHARS) | F.col("text").isNull(), "short")
    named = corpus.withColumn("reason", reason)
    if entities is not None:
        known = entities.select(F.col("id").alias("org_id"), F.lit(True).alias("_known"))
        named = named.join(known, "org_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), "unknown entity"))).drop("_known")
    return named.where("reason is null").drop("reason", "corrupt"), named.where("reason is not null")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns are pushed to its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def http_fetcher(timeout: float = PAGE_SECONDS, agent: str = "textquarry") -> Callable[[str], str | None]:
    """A fetcher over HTTP: the decoded body of an answer with a 2xx status in time, None for any other."""

    def fetch(url: str) -> str | None:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:  # a status of 4xx or 5xx raises
            if not 200 <= answer.status < 300:
                return None
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str | None], url: str = "url", wait: Column | float = 0.0) -> DataFrame:
    """(url, html) through a fetcher that runs on the executors; html is null where it returns or raises nothing useful.

    wait is the seconds between two pages of a host, a number or a column (its robots.txt may ask
    for more); a host's pages are then read by one task, one after the other. Persist the
    result before it is used twice: a recomputed task fetches again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for one, site, pause in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pause and site is not None and site == last:
                    time.sleep(pause)
                last = site
                try:
                    found.append(fetch(one))
                except Exception:  # a page that fails is an error of that page only
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["url", "html"])

    rows = urls.select(F.col(url).alias("url"), host(F.col(url)).alias("site"), (wait if isinstance(wait, Column) else F.lit(float(wait))).cast("double").alias("wait"))
    if isinstance(wait, Column) or wait:
        rows = rows.repartition("site").sortWithinPartitions("site", "url")
    return rows.mapInArrow(run, "url string, html string")


def fetch_robots(urls: DataFrame, fetch: Callable[[str], str | None], url: str = "url") -> DataFrame:
    """(site, text) of the robots.txt of every host among the URLs that has one; a host without one forbids nothing."""
    places = urls.select(F.concat(website(F.col(url)), F.lit("/robots.txt")).alias("url")).where("url is not null").distinct()
    return fetch_pages(places, fetch).where("html is not null").select(host(F.col("url")).alias("site"), F.col("html").alias("text"))
