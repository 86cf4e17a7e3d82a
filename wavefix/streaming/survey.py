"""Survey collection over a stream: a marker opens a point's window, and its readings become a fingerprint.

A stateful processor holds the open window of each surveying device and its readings as a list. The window closes when the watermark passes its end (an event-time
timer) or the next marker comes, and gives its readings; a batch of closed windows is then aggregated, checked and stored as any survey is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wavefix.functions import constants as K
from wavefix.operators import survey
from wavefix.streaming import live

SAMPLE = "beacon long, point_id long, which string, started double, anchor_idx int, rssi double"


class Dwell(StatefulProcessor):
    """Readings (anchor_idx, rssi) and markers (point_id, pass) of a device, told apart by ``point_id``, to the samples of closed windows.

    A reading at a window's start is inside, one at its end isn't; readings outside windows are dropped. A marker ends the window before it.
    """

    def __init__(self, dwell: dict[str, float]):
        self.dwell = dwell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "point_id long, which string, started double, ends double")
        self.rows = handle.getListState("rows", "anchor_idx int, rssi double, t double")

    def _closed(self, beacon: int) -> pd.DataFrame | None:
        if not self.open.exists():
            return None
        point, which, started, _ = self.open.get()
        rows = [(beacon, point, which, started, r[0], r[1]) for r in self.rows.get()] if self.rows.exists() else []
        self.open.clear()
        self.rows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame(rows, columns=["beacon", "point_id", "which", "started", "anchor_idx", "rssi"]) if rows else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beacon, fresh = int(key[0]), []
        # One device's share of a micro-batch; a marker comes before the readings of its time.
        pdf = pd.concat(list(rows)).sort_values(["t", "point_id"], na_position="last")
        for t, point, which, anchor, rssi in zip(pdf["t"], pdf["point_id"], pdf["which"], pdf["anchor_idx"], pdf["rssi"], strict=True):
            if not pd.isna(point):
                if fresh:
                    self.rows.appendList(fresh)
                    fresh = []
                out = self._closed(beacon)
                if out is not None:
                    yield out
                ends = float(t) + self.dwell[which]
                self.open.update((int(point), which, float(t), ends))
                self.handle.registerTimer(int(ends * 1000))
            elif self.open.exists() and t < self.open.get()[3]:
                fresh.append((int(anchor), float(rssi), float(t)))
        if fresh:
            self.rows.appendList(fresh)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._closed(int(key[0]))
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def collected(events: DataFrame, late: str = "5 seconds", dwell: float = K.SURVEY_DWELL_S, occluded: float = K.OCCLUDED_DWELL_S) -> DataFrame:
    """Samples of closed windows from a stream of events (beacon, t, point_id and pass of markers, anchor_idx and rssi of readings)."""
    live.rocks(events.sparkSession)
    rows = events.select("beacon", "t", "point_id", F.col("pass").alias("which"), "anchor_idx", F.col("rssi").cast("double").alias("rssi"), F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("beacon").transformWithStateInPandas(Dwell({survey.NORMAL: dwell, survey.OCCLUDED: occluded}), SAMPLE, "append", "eventTime").withColumnRenamed("which", "pass")


def into(events: DataFrame, path: str, checkpoint: str, **how: Any) -> StreamingQuery:
    """Store the fingerprints of a stream of survey events, a folder for each batch: points that pass the check in ``fingerprints``, the others in ``rejected``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        points = survey.aggregated(batch.drop("beacon", "started")).join(batch.select("point_id", "pass").distinct(), "point_id").withColumn("notes", F.when(F.col("pass") == survey.OCCLUDED, survey.OCCLUDED).otherwise("")).persist()
        points.where("NOT rejected").write.mode("overwrite").parquet(f"{path}/fingerprints/batch={batch_id}")
        points.where("rejected").write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        points.unpersist()

    return collected(events, **how).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
