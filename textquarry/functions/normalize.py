"""Normalisers of what models return. Zero and the empty string count as missing where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENTITY_TYPES, PHASES
from .text import js_trim


def or_else(c: Column, other: object) -> Column:
    """c, or other where it is null or empty."""
    return F.when(c.isNull() | (c == ""), F.lit(other)).otherwise(c)


def phase(c: Column) -> Column:
    """Lower case, letters and underscores only; what is no phase is strategy."""
    bare = F.regexp_replace(F.lower(c), "[^a-z_]", "")
    return F.when(bare.isin([p[0] for p in PHASES]), bare).otherwise(F.lit("strategy"))


def confidence(c: Column) -> Column:
    """Between 0 and 1; null, NaN and 0 are 0.5."""
    given = F.nullif(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(given, F.lit(0.5))))


def entity_type(c: Column) -> Column:
    return F.when(c.isin(ENTITY_TYPES), c).otherwise(F.lit("other"))


def state(c: Column) -> Column:
    """Two capitals."""
    return F.substring(F.upper(c), 1, 2)


def fiscal_year(c: Column) -> Column:
    """0 is null."""
    return F.nullif(c.cast("int"), F.lit(0))


def summary(record: Column) -> Column:
    """A summary record with its defaults."""
    return F.struct(
        or_else(record["title"], "Untitled Document").alias("title"), or_else(record["summary"], "No summary available").alias("summary"), F.coalesce(record["keywords"], F.array().cast("array<string>")).alias("keywords"),
        or_else(record["document_type"], "other").alias("document_type"), fiscal_year(record["fiscal_year"]).alias("fiscal_year"),
    )


def project(record: Column) -> Column:
    """A project record with its defaults, its phase and confidence normalised."""
    empty = F.array().cast("array<string>")
    return F.struct(
        or_else(record["title"], "Unnamed Project").alias("title"), F.coalesce(record["description"], F.lit("")).alias("description"), phase(record["phase"]).alias("phase"),
        F.coalesce(record["phase_reasoning"], F.lit("")).alias("phase_reasoning"), confidence(record["phase_confidence"]).alias("phase_confidence"), or_else(record["category"], "other").alias("category"),
        record["estimated_value"].alias("estimated_value"), record["fiscal_year"].alias("fiscal_year"), record["timeline_notes"].alias("timeline_notes"), record["contacts"].alias("contacts"),
        F.coalesce(record["evidence_excerpts"], empty).alias("evidence_excerpts"), F.coalesce(record["keywords"], empty).alias("keywords"),
    )


def entity(record: Column) -> Column:
    """An entity record, null without name or type."""
    good = (js_trim(record["name"]) != "") & (js_trim(record["type"]) != "")
    return F.when(good, F.struct(record["name"].alias("name"), entity_type(record["type"]).alias("type"), state(record["state"]).alias("state"), record["confidence"].alias("confidence")))
