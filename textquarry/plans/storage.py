"""Stored tables that are dealt by key, so that work on some keys leaves the rest alone.

A table is bucketed by its key and lies in parts, each of a few of its buckets: a key's hash gives
its bucket, the bucket its part. So

* an existence check reads the parts that the new keys fall in, and shuffles the new rows only: the
  stored side is in the order of the join as it lies (no Exchange);
* an append adds files to those parts;
* an overlay rewrites those parts and no other: untouched files keep their names.

The catalog knows a table by its folder; a session that has not seen it registers it from what lies there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.writes import overlay

#: Buckets of a table, and parts that they lie in. A table keeps the numbers that it was made with.
BUCKETS, PARTS = 32, 8
_PART = "part"
_MODE = "spark.sql.sources.partitionOverwriteMode"


def written(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write the rows and return how many there were, from one run of their plan."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


class KeyedTable:
    """The table below ``folder``, of ``schema``, dealt by ``key``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "id", buckets: int | None = None, parts: int | None = None):
        buckets, parts = buckets or BUCKETS, parts or PARTS
        if buckets % parts:
            raise ValueError("the number of buckets must be a multiple of the number of parts")
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.buckets, self.parts = self._made_with() or (buckets, parts)
        self.name = f"textquarry_{hashlib.sha256(self._data.encode()).hexdigest()[:24]}"
        self._register()

    # ------------------------------------------------------------------ where it lies

    @property
    def _data(self) -> str:
        return f"{self.folder}/buckets={self.buckets}-parts={self.parts}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _made_with(self) -> tuple[int, int] | None:
        at, files = self._files(self.folder)
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        made = next((n for n in sorted(names) if n.startswith("buckets=")), None)
        return tuple(int(x.split("=")[1]) for x in made.split("-")) if made else None  # type: ignore[return-value]

    def _register(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            return
        at, files = self._files(self._data)
        files.mkdirs(at)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}, `{_PART}` int) USING parquet PARTITIONED BY (`{_PART}`) CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self._data}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def part_of(self, key: Column) -> Column:
        """The part of a key: that of its bucket, since the number of buckets is a multiple of the number of parts."""
        return F.pmod(F.hash(key), F.lit(self.parts)).cast("int")

    # ------------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(_PART)

    def near(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the parts that the keys fall in: what a join with them needs to read."""
        parts = [r[0] for r in keys.select(self.part_of(F.col(self.key)).alias(_PART)).distinct().collect()]  # at most the number of parts
        stored = self.spark.table(self.name)
        return (stored.where(F.col(_PART).isin(sorted(parts))) if len(parts) < self.parts else stored).drop(_PART)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not stored yet. Of the stored table the keys of some parts are read, and none is shuffled."""
        return rows.join(self.near(rows).select(self.key), self.key, "left_anti").select(*rows.columns)

    # ------------------------------------------------------------------ writing

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """The table's columns, those that rows lack null, dealt as it is: a file for each bucket that is written."""
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        return shaped.withColumn(_PART, self.part_of(F.col(self.key))).repartition(self.buckets, self.key)

    @contextmanager
    def _dynamic(self):
        before = self.spark.conf.get(_MODE)
        self.spark.conf.set(_MODE, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(_MODE, before)

    def append(self, rows: DataFrame) -> int:
        """Add rows and return how many."""
        return written(self._shaped(rows), lambda df: df.write.mode("append").insertInto(self.name))

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the parts that the keys fall in by what ``change`` makes of their rows; returns the rows of those parts.

        A part is swapped when all new files are written; other parts are neither read nor written.
        ``change`` must not move a row to another key.
        """
        if keys.isEmpty():
            return 0
        rows = self._shaped(change(self.near(keys)))
        with self._dynamic():
            return written(rows, lambda df: df.write.mode("overwrite").insertInto(self.name))

    def overlay(self, found: DataFrame, **options) -> int:  # noqa: ANN003
        """The stored rows with what was found of them (operators.writes.overlay), in the parts in which that changes a row."""
        stored = self.near(found)
        changed = overlay(stored, found, key=self.key, **options).subtract(stored).select(self.key)
        return self.rewrite(changed, lambda rows: overlay(rows, found, key=self.key, **options))

    def drop_registration(self) -> None:
        """Let the catalog forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
