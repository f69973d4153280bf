"""Documents as a stream of files, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import long_enough
from ..schemas import RAW_DOCUMENT
from ..sources.corpus import DOCUMENT_CHARS


def document_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON files below the folders of root, long enough, each URL once a day.

    The state of the deduplication is bounded by a watermark on the time of arrival; the sink
    leaves out what is stored already, so a URL that comes again later is not stored twice.
    """
    raw = spark.readStream.schema(RAW_DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").json(f"{root}/*")
    arrived = raw.withColumn("file", F.col("_metadata.file_path")).withColumn("arrived", F.col("_metadata.file_modification_time"))
    good = arrived.where(F.col("url").isNotNull() & long_enough(F.col("text"), DOCUMENT_CHARS))
    return good.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["url"])


def start(documents: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every batch to sink; once: what is there now, then stop."""
    writer = documents.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number and sum of events by type in tumbling windows; works on streams and tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
