"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow. Its documents, in the order of the MD5 of their ids, queue up once for
each epoch; a queued document's virtual finish time is the words its flow has queued up to and
with it, divided by the flow's target. All flows are served in order of finish times until the
total budget is spent. A flow's finish times pass 1 where it has queued its target, so serving
cuts every flow off near its target.

No sum runs through a whole flow in one task. Running sums are made in two levels: a key's
leading bits name a bucket, buckets of a flow are summed and accumulated (a small table), and
the order inside a bucket is accumulated by a window over that bucket alone. Buckets grow in
number with the rows, so a window holds about BUCKET_ROWS rows of any flow, the hot one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that a bucket of the running sums holds, about.
BUCKET_ROWS = 4096
#: No document and no source is taken more often.
EPOCHS = 3
#: A table of more sources than this is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = EPOCHS) -> DataFrame:
    """sizes: (source, source_size, ...), a row for each source. Adds rank (from 0) and target.

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets share the sum of
    all sizes by weight; one that passes ``most`` times its source's size stops there and the
    rest is shared again, until none is above. That is min(most * size, level * weight) for
    one level, found from running sums in the order of most * size / weight.
    """
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    gone = lambda c: F.sum(c).over(everything) - F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / gone("weight")
    named = named.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)
    named = named.withColumn("level", fits["level"])
    return named.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("weight", "cap", "full_at", "level")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How often each document is taken so that sources come near their targets.

    Returns one row per input row: the id, size (words), source_size, target (its source's)
    and taken (words the mix takes of it, repeats counted; 0 to 3 times its size).

    A null or empty text has size 0 and is never taken. A null source is a source, the last
    one. Null ids and repeated rows are documents like others; rows that agree in source, id
    and size may be exchanged for one another, which leaves the result as it is. An empty
    table gives an empty result. The order comes from ids, so reruns agree. Other columns are
    neither read nor returned.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    docs = scratch.save(documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("key")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"), F.count("*").alias("rows"))
    sources = scratch.save(targets(sizes, weights))
    bits = F.greatest(F.lit(0), F.least(F.lit(28), F.ceil(F.log2(F.col("rows") / BUCKET_ROWS)).cast("int")))
    sources = sources.withColumn("bits", bits)
    total = sources.agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.max(F.when((F.col("target") > 0) & (F.col("target") < F.col("source_size") * EPOCHS), F.col("largest") / F.col("target"))), F.lit(0.0)).alias("late"),
    ).first()
    if total["sources"] <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    # Running sums within each source: buckets of the key first, then inside a bucket.
    flows = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    head = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    flows = flows.withColumn("bucket", F.floor(head / F.pow(F.lit(2.0), F.lit(28) - F.col("bits"))).cast("long"))
    step = flows.groupBy("rank", "bucket").agg(F.sum("size").alias("step"))
    step = step.select("rank", "bucket", (F.sum("step").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("step")).alias("before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = flows.join(step, ["rank", "bucket"]).withColumn("queued", F.col("before") + F.sum("size").over(inside))
    queued = scratch.save(queued.select("id", "size", "source_size", "target", "rank", "queued"))

    # Serve all flows by finish time until the budget is spent.
    finish = lambda epoch: (F.col("source_size") * epoch + F.col("queued")) / F.nullif(F.col("target"), F.lit(0.0))
    slot = lambda v: F.floor(v * (total["rows"] // BUCKET_ROWS + 1)).cast("long")
    served = queued.where("size > 0").select("size", "rank", F.explode(F.array(*[finish(F.lit(e)) for e in range(EPOCHS)])).alias("v")).where(F.col("v") <= 1 + total["late"] * 1.000001 + 1e-9)
    served = served.withColumn("slot", slot(F.col("v")))
    spent = served.groupBy("slot").agg(F.sum("size").alias("step"))
    spent = spent.select("slot", "step", F.sum("step").over(Window.orderBy("slot")).alias("upto"))
    last = spent.where(F.col("upto") > total["budget"]).orderBy("slot").first()
    if last is None:
        taken = [F.col("size") > 0] * EPOCHS if total["budget"] else [F.lit(False)] * EPOCHS
        taken = [t & (finish(F.lit(e)) <= 1 + total["late"] * 1.000001 + 1e-9) for e, t in enumerate(taken)]
    else:
        at = served.where(F.col("slot") == last["slot"]).withColumn("upto", F.sum("size").over(Window.orderBy("v", "rank")) + (last["upto"] - last["step"]))
        cut = at.where(F.col("upto") <= total["budget"]).agg(F.max(F.struct("v", "rank")).alias("cut")).first()["cut"]
        taken = []
        for e in range(EPOCHS):
            v = finish(F.lit(e))
            ends = F.lit(False) if cut is None else (slot(v) == last["slot"]) & ((v < cut["v"]) | ((v == cut["v"]) & (F.col("rank") <= cut["rank"])))
            taken.append((slot(v) < last["slot"]) | ends)
    times = sum((F.when(t, 1).otherwise(0) for t in taken), F.lit(0))
    return queued.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def take(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Every row of documents as often as the mix takes it, columns as given.

    Rows that share an id are taken equally often, their mean, rounded. Texts without words go.
    """
    mixed = mix(documents, id_col, **options).where("taken > 0").groupBy(F.col(id_col).alias("_id")).agg(F.sum(F.col("taken") / F.col("size")).alias("sum"))
    rows = documents.groupBy(F.col(id_col).alias("_row")).agg(F.count("*").alias("rows"))
    times = mixed.join(rows, F.col("_id").eqNullSafe(F.col("_row"))).select("_id", F.round(F.col("sum") / F.col("rows")).cast("int").alias("_times")).where("_times > 0")
    joined = documents.join(times, documents[id_col].eqNullSafe(times["_id"])).where(F.length(documents[options.get("text_col", "text")]) > 0)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[documents[c] for c in documents.columns])
