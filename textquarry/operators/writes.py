"""Appends of what is new, overlays of what is better known, and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.5


def first_per_key(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_page(pages: DataFrame, key: str) -> DataFrame:
    """The page that is read for each key: that of the first URL; of several pages of one URL that of the smallest html, one without html last."""
    return first_per_key(pages, key, "url", F.col("html").asc_nulls_last())


def pages_of_first_url(pages: DataFrame, key: str) -> DataFrame:
    """All pages of the first URL of each key. Only keys and URLs are grouped, so a URL of many pages is no group of html."""
    first = pages.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("url").alias("url"))
    return pages.join(first, [key, "url"], "left_semi")


def unseen(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet. Only the key of the stored table is read."""
    return rows.join(stored.select(key), key, "left_anti")


def identified(rows: DataFrame, *parts: str) -> DataFrame:
    """rows with an id made from their parts, the same on every run."""
    return rows.withColumn("id", F.sha2(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]), 256))


def overlay(entities: DataFrame, found: DataFrame, key: str = "id", columns: tuple[str, ...] = ("name", "type", "state", "website"), least: float = LEAST_CONFIDENCE) -> DataFrame:
    """entities with the found values where confidence is high enough; values that are null change nothing.

    Of several finds for one key the surest counts, the smallest of equally sure ones.
    """
    known = [F.col(c) for c in columns if c in found.columns]
    sure = first_per_key(found.where(F.col("confidence") >= least), key, F.col("confidence").desc(), *known).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns if c in found.columns])
    joined = entities.join(sure, key, "left")
    changed = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns if c in found.columns}
    return joined.withColumns(changed).select(*entities.columns)


def without_orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent exists: what a cascading delete leaves."""
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def in_array(rows: DataFrame, owner: DataFrame, ids: str, id_col: str = "id") -> DataFrame:
    """Rows whose id is in the array column of owner; none for an empty or null array."""
    return rows.join(owner.select(F.explode(ids).alias(id_col)), id_col, "left_semi")
