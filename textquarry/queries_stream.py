"""Registered queries that run as streams, over files that Spark makes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import ORACLES, query, spoken, turn_of
from .runtime import Scratch
from .streaming.alerts import phase_alerts, rocks

#: Half hours that a row may come late, and batches that the rows come in.
_LATE, _BATCHES = 3, 4


@query(ORACLES["phase_changes"])
def phase_alert_stream(spark, sf):
    """The changes of phase_changes from a stream in several batches, rows up to an hour and a half out of order.

    The last batch holds a row far in the future, which moves the watermark past all others.
    """
    scratch = Scratch(spark)
    rows = spoken(spark, sf)
    turn = turn_of()
    most = rows.agg(F.max(turn)).first()[0] or 0
    share = max(1, -(-(most + 1) // (_BATCHES - 1)))
    # A row's batch is that of its turn, or of one up to _LATE - 1 earlier or later, by its id.
    dealt = rows.withColumn("batch", F.least(F.floor((turn + F.pmod(F.hash("conv_id", "role"), F.lit(_LATE))) / share), F.lit(_BATCHES - 2)))
    last = rows.agg(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit("").alias("role"), (F.max("created_at") + F.expr("interval 30 days")).alias("created_at"))
    for b in range(_BATCHES):  # a batch is whatever has come since the stream stopped
        (dealt.where(F.col("batch") == b).drop("batch") if b < _BATCHES - 1 else last).write.parquet(f"{scratch.base}/in/{b}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{scratch.base}/in/*")
        with rocks(spark):
            alerts = phase_alerts(stream, ["conv_id"], phase="role", late=f"{_LATE * 30 + 30} minutes")
            running = alerts.writeStream.format("parquet").option("path", f"{scratch.base}/out").option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    found = spark.read.schema(alerts.schema).parquet(f"{scratch.base}/out")
    return found.select("conv_id", turn_of().alias("turn"), "role", "before")
