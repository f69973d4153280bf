"""Phase lookups, dense roll-ups, counts per entity, optional filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PHASES, phase_dimension


def with_phase(rows: DataFrame, phase: str = "phase") -> DataFrame:
    """rows with label, emoji, description and priority of their phase; an unknown one has those of the first phase."""
    known = phase_dimension(rows.sparkSession)
    spare = dict(zip(known.columns, PHASES[0], strict=True))
    joined = rows.join(F.broadcast(known.withColumnRenamed("phase", "_phase")), F.col(phase) == F.col("_phase"), "left").drop("_phase")
    names = [c for c in known.columns if c != "phase"]
    return joined.withColumns({c: F.coalesce(c, F.lit(spare[c])) for c in names})


def matching(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal all values given; None and the empty string ask for nothing. The filter reaches the scan."""
    given: list[Column] = [F.col(c) == v for c, v in wanted.items() if v]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def count_by_phase(rows: DataFrame, phase: str = "phase") -> DataFrame:
    """All six phases in order with their number of rows; unknown phases count nowhere."""
    counts = rows.where(F.col(phase).isin([p[0] for p in PHASES])).groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("n"))
    return phase_dimension(rows.sparkSession).join(F.broadcast(counts), "phase", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def totals(rows: DataFrame, value: str = "estimated_value") -> DataFrame:
    """One row: total (all rows, unknown phases too) and total_estimated_value (0 for none), an exact decimal sum."""
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col(value).cast("decimal(15,2)")), F.lit(0)).cast("decimal(25,2)").alias("total_estimated_value"))


def counts_per(entities: DataFrame, key: str, facts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """entities with a count of rows for each fact (name -> table, its key); 0 for none.

    Each fact is aggregated before it is joined, so facts do not multiply one another.
    """
    out = entities
    for name, (fact, fact_key) in facts.items():
        own = fact.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias(name))
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def scalars(**counts: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
