"""Live tracking with Structured Streaming: messages to smoothed readings, stays, and idempotent sinks.

Messages arrive as files of JSON lines (topic, payload, ts) or from a message log (``sources.log``); a broker
connector would replace only ``messages``. Each anchor's filter is an entry of a map in Spark's state store. Sinks write
one folder for each batch id, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wavefix.functions import constants as K
from wavefix.operators import kalman
from wavefix.sources.readings import parsed

OUT = "event_id long, beacon long, anchor_id string, t double, rssi double, x double, cycle boolean"
FORGET_MS = 3_600_000


def rocks(spark: SparkSession) -> None:
    """Keep this session's streaming state in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("event_id long, topic string, payload string, t double").json(path)


def readings(stream: DataFrame, beacons: list[int] | None = None) -> DataFrame:
    """Device readings of a message stream, of all beacons or of those that are tracked."""
    out = parsed(stream).withColumn("beacon", F.col("device").try_cast("long")).where("beacon IS NOT NULL")
    return out if beacons is None else out.where(F.col("beacon").isin(beacons))


def on_time(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Readings in event time (``ts``): repeats of a message within ``late`` are dropped, and so are readings behind the watermark.

    Those are counted by the query (``dropped``).
    """
    ts = F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    return stream.withColumn("ts", ts).withWatermark("ts", late).dropDuplicatesWithinWatermark(["beacon", "anchor_id", "event_id"])


def dropped(query: StreamingQuery) -> int:
    """Rows that the query's operators found behind the watermark, in the batches whose progress is kept."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


class Smoother(StatefulProcessor):
    """Smoothed readings of a beacon, and which of them start a cycle. A reading older than its anchor's newest gives no row."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchors = handle.getMapState("anchors", "anchor_id string", "t double, x double, v double, p00 double, p01 double, p11 double", self.ttl_ms)
        self.clock = handle.getValueState("clock", "t double", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[str, tuple | None] = {}
        last = self.clock.get()[0] if self.clock.exists() else None
        out = []
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])  # one beacon's share of a micro-batch
        for event_id, anchor, t, z in zip(pdf["event_id"].tolist(), pdf["anchor_id"].tolist(), pdf["t"].tolist(), pdf["rssi"].tolist(), strict=True):
            if anchor not in known:
                known[anchor] = tuple(self.anchors.getValue((anchor,))) if self.anchors.containsKey((anchor,)) else None
            s = known[anchor]
            if s is not None and t < s[0]:
                continue
            known[anchor] = s = kalman.step(s, t, z)
            due = last is None or t - last >= K.MIN_INTERVAL_S
            last = t if due else last
            out.append((event_id, key[0], anchor, t, z, s[1], due))
        for anchor, s in known.items():
            if s is not None:
                self.anchors.updateValue((anchor,), s)
        if last is not None:
            self.clock.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "beacon", "anchor_id", "t", "rssi", "x", "cycle"])

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, forget: bool = False) -> DataFrame:
    """Smoothed readings, and which of them start a cycle.

    With ``forget`` state lives for an hour after its last change; such a query never
    runs out of work, so it is for endless triggers only.
    """
    rocks(stream.sparkSession)
    rows = stream.select("beacon", "event_id", "anchor_id", "t", F.col("rssi").cast("double").alias("rssi"))
    return rows.groupBy("beacon").transformWithStateInPandas(Smoother(FORGET_MS if forget else None), OUT, "append", "processingTime" if forget else "none")


def visits(positions: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stays at a label in event time: sessions of (beacon, label) from (beacon, label, ts)."""
    return positions.withWatermark("ts", late).groupBy("beacon", "label", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("beacon", "label", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, a folder for each batch; starts and returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
