"""Phase alerts: a stream's equal a table's, however rows are dealt; expiry, late rows, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.streaming.alerts import phase_alerts, phase_changes, rocks

SCHEMA = "org string, title string, phase string, created_at timestamp"


def rows_of(spark, rows):
    """rows: (org, title, phase, minutes)"""
    df = spark.createDataFrame(rows, "org string, title string, phase string, minutes long")
    return df.select("org", "title", "phase", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minutes") * 60).alias("created_at"))


class Feed:
    """A folder that a stream reads one file a batch from, and what its alerts were so far."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options, self.n = spark, root, options, 0

    def put(self, rows):
        self.n += 1
        rows_of(self.spark, rows).coalesce(1).write.parquet(f"{self.root}/in/{self.n:03d}")
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in/*")
        with rocks(self.spark):
            alerts = phase_alerts(stream, ["org", "title"], **self.options)
            query = alerts.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def alerts(self):
        return sorted(tuple(r) for r in self.spark.read.schema("org string, title string, before string, phase string, created_at timestamp").parquet(f"{self.root}/out").collect())


def table_alerts(spark, rows, **options):
    return sorted(tuple(r) for r in phase_changes(rows_of(spark, rows), ["org", "title"], **options).collect())


FLUSH = ("flush", "f", "x", 1_000_000)


def test_stream_equals_table(spark, tmp_path):
    """Three runs of one checkpoint, rows out of order within the watermark, nulls, equal times; each run starts anew from its state."""
    rnd = random.Random(3)
    rows = sorted({(f"o{rnd.randrange(2)}", f"t{rnd.randrange(3)}", rnd.choice(["a", "b", "c", None]), m) for m in rnd.sample(range(600), 90)}, key=lambda r: r[3])
    jittered = sorted(rows, key=lambda r: r[3] + rnd.randrange(50))
    feed = Feed(spark, str(tmp_path))
    for part in (jittered[:30], jittered[30:60], [*jittered[60:], FLUSH]):
        feed.put(part)
    want = table_alerts(spark, rows)
    assert len(want) > 20 and feed.alerts() == want


def test_expiry_and_late_rows(spark, tmp_path):
    """A key silent for over a day starts anew; a row behind the watermark is left out."""
    day = 1440
    feed = Feed(spark, str(tmp_path), forget_days=1)
    rows = [("o", "t", "a", 0), ("o", "t", "b", 10), ("o", "t", "c", 10 + day + 1), ("o", "t", "d", 20 + day), ("p", "t", "a", 3 * day)]
    feed.put(rows)
    feed.put([("o", "t", "late", 15), ("p", "t", "b", 3 * day + 5), FLUSH])
    got = [(r[0], r[2], r[3]) for r in feed.alerts()]
    assert got == [("o", "a", "b"), ("o", "c", "d"), ("p", "a", "b")]
    assert got == [(r[0], r[2], r[3]) for r in table_alerts(spark, [*rows, ("p", "t", "b", 3 * day + 5)], forget_days=1)]


def test_provider_is_restored(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), rocks(spark):
        raise KeyError
    assert spark.conf.get(name, None) == before


def test_a_key_sets_one_timer_for_a_batch():
    import pandas as pd

    from textquarry.streaming.alerts import PhaseAlerts

    class Fake:
        def __init__(self):
            self.timers, self.rows = [], []

        registerTimer = lambda self, ms: self.timers.append(ms)
        appendList = lambda self, rows: self.rows.extend(rows)
        getCurrentWatermarkInMs = lambda self: 0

    fake, alerts = Fake(), PhaseAlerts(["k"], "phase", "at", 1000)
    alerts.handle = alerts.waiting = fake
    list(alerts.handleInputRows(("a",), iter([pd.DataFrame({"at": pd.to_datetime([3000, 1000, 2000], unit="ms"), "phase": ["x", "y", "z"]})]), fake))
    assert len(fake.rows) == 3 and fake.timers == [1000]
