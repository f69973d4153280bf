"""A ledger of answered requests, so that no run pays twice for the same one.

A request's key is a hash of its kind, the model's name and the whole prompt. Requests are joined
with the ledger before anything is called; what is missing is asked once for each key, in
blocks that are written when they are answered, so a failed run or a lost executor costs one block
at most. Repeated prompts (the same chunk in many documents) are one request.

A failure is not an answer: it is left out, and asked again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, ship

#: Requests that are answered before any are written, about.
BLOCK = 20_000
_LEDGER = "key string, answer string, kind string"


def request_key(kind: str, model: str, *prompt: Column) -> Column:
    """A hash of all that decides an answer; parts are told apart by their lengths."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in prompt]
    sized = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return F.sha2(F.concat(F.lit(f"{kind}:{model}:"), *sized), 256)


class Ledger:
    """Answers below ``root``, a folder for each kind. ``model`` names what answers: another name is another ledger in effect."""

    def __init__(self, spark: SparkSession, root: str, model: str, block: int = BLOCK):
        self.spark, self.root, self.model, self.block = spark, root.rstrip("/"), model, block

    def known(self, kind: str) -> DataFrame:
        """(key, answer) of all that is answered."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/kind={kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "key string, answer string")
        return self.spark.read.schema(_LEDGER.replace(", kind string", "")).parquet(f"{self.root}/kind={kind}")

    def ask(self, kind: str, requests: DataFrame, prompt: list[str], call: Callable[[list[tuple]], list[str | None]], at_once: int = 16) -> DataFrame:
        """(key, answer) of the requests that are answered, once each. requests: the columns of ``prompt``.

        call takes up to at_once tuples of them and returns as many answers, None for a failure.
        """
        ship(self.spark)
        key = request_key(kind, self.model, *[F.col(p) for p in prompt])
        asked = requests.select(key.alias("key"), *prompt)
        scratch = Scratch(self.spark)
        # Keys first: prompts are long, and a prompt that very many rows share is one row before it is shuffled.
        missing = asked.groupBy("key").agg(*[F.first(p).alias(p) for p in prompt]).join(self.known(kind).select("key"), "key", "left_anti")
        missing = scratch.save(missing)
        blocks = -(-missing.count() // self.block)
        for b in range(blocks):
            some = missing.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
            some.mapInArrow(_answered(call, at_once), "key string, answer string").where("answer is not null").write.mode("append").parquet(f"{self.root}/kind={kind}")
        scratch.drop(missing)
        # A task that was tried twice may have written a key twice; any of its answers will do, the smallest always does.
        return self.known(kind).join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("answer").alias("answer"))


def _answered(call: Callable[[list[tuple]], list[str | None]], at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                some = batch.slice(i, at_once)
                rows = list(zip(*(c.to_pylist() for c in some.columns[1:]), strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(call(rows), pa.string())], names=["key", "answer"])

    return run
