"""The live cycle over a stream, with each beacon's state in Spark's state store.

A stateful processor holds three variables for each beacon: a map of its anchors, the model (clock, floor belief, last
positions), and the particles. Readings of a micro-batch load the state of the beacons that they
are of, and only what they change is written: anchors heard, and the model and the particles of beacons whose cycle
was due. Silent beacons cost nothing. State is forgotten by a time to live (processing time), or by a timer once the
watermark has passed a beacon's last reading by ``idle`` seconds (event time). Rooms, zones and activity are
joined to the records as columns.

A beacon's readings of one micro-batch are put in order in memory; the source's rate bounds them. Over a table (``trajectories``)
Spark sorts the rows, and the same steps move many beacons on side by side; no state is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wavefix.functions import constants as K
from wavefix.functions.signal import activity, activity_score
from wavefix.operators import space
from wavefix.operators.beacon import Beacon, Fleet, Heard, House
from wavefix.sources import layout
from wavefix.streaming import live

RECORD = "beacon long, event_id long, t double, x double, y double, floor int, confidence double, n_eff double, belief array<double>, delta_mean double, var_mean double, displacement_ft double, n_late long"
ANCHOR = "event_id long, t double, raw double, at double, x double, v double, p00 double, p01 double, p11 double, was double, past array<double>"
MODEL = "t double, held double, cycles long, late long, belief array<double>, recent array<struct<x: double, y: double, floor: int>>"
CLOUD = "x array<double>, y array<double>, floor array<int>, w array<double>, cooldown array<double>"


class Cycle(StatefulProcessor):
    """Readings (event_id, t, anchor_idx, rssi) of a beacon to its position records.

    ``ttl_ms`` forgets by processing time, ``idle_s`` by event time.
    """

    def __init__(self, house: House, n: int = K.PARTICLES, ttl_ms: int | None = None, idle_s: float | None = None):
        self.house, self.n, self.ttl_ms, self.idle_s = house, n, ttl_ms, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchors = handle.getMapState("anchors", "anchor_idx int", ANCHOR, self.ttl_ms)
        self.model = handle.getValueState("model", MODEL, self.ttl_ms)
        self.cloud = handle.getValueState("cloud", CLOUD, self.ttl_ms)

    def _loaded(self, number: int) -> Beacon:
        b = Beacon(self.house, number, self.n)
        for (anchor,), s in self.anchors.iterator():
            b.heard[anchor] = Heard(s[0], s[1], s[2], tuple(s[3:9]), s[9], list(s[10]))
        if self.model.exists():
            b.last, b.hold, b.cycles, b.late, belief, recent = self.model.get()
            b.belief = dict(zip(b.floors, belief, strict=True))
            b.recent = [tuple(r) for r in recent]
        if self.cloud.exists():
            x, y, floor, w, cooldown = self.cloud.get()
            b.x, b.y, b.floor, b.w, b.cooldown = np.array(x), np.array(y), np.array(floor), np.array(w), np.array(cooldown)
        return b

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b, changed, cycled = self._loaded(int(key[0])), set(), False
        out, pdf = [], pd.concat(list(rows)).sort_values(["t", "event_id"])
        for event_id, anchor, t, raw in zip(pdf["event_id"].tolist(), pdf["anchor_idx"].tolist(), pdf["t"].tolist(), pdf["rssi"].tolist(), strict=True):
            record = b.reading(event_id, anchor, t, raw)
            changed.add(anchor)
            if record is not None:
                out.append({"beacon": b.number, **record})
        if out:
            cycled = True
            yield pd.DataFrame(out)
        for a in b.heard if cycled else changed:  # a cycle notes every anchor's strength
            h = b.heard[a]
            self.anchors.updateValue((a,), (h.event_id, h.t, h.raw, *h.state, h.was, h.past))
        self.model.update((b.last, b.hold, b.cycles, b.late, [b.belief[f] for f in b.floors], b.recent))
        if cycled:
            self.cloud.update((b.x.tolist(), b.y.tolist(), b.floor.tolist(), b.w.tolist(), b.cooldown.tolist()))
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((max(h.t for h in b.heard.values()) + self.idle_s) * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.anchors.clear()
        self.model.clear()
        self.cloud.clear()
        return iter(())

    def close(self) -> None:
        pass


def _numbered(readings: DataFrame, plan: DataFrame) -> DataFrame:
    """(beacon, event_id, t, anchor_idx, rssi) and ``ts`` where there is one, of readings of the plan's anchors."""
    a = F.broadcast(layout.anchors(plan).select("anchor_id", "anchor_idx"))
    return readings.join(a, "anchor_id").select("beacon", "event_id", "t", "anchor_idx", F.col("rssi").cast("double").alias("rssi"), *(c for c in ("ts",) if c in readings.columns))


def cycles(readings: DataFrame, house: House, plan: DataFrame, ttl_ms: int | None = None, idle_s: float | None = None, n: int = K.PARTICLES) -> DataFrame:
    """Position records of a stream of readings (beacon, event_id, t, anchor_id, rssi); with ``idle_s`` it needs a watermark on ``ts``.

    A query with a time to live never runs out of work: it is for endless triggers.
    """
    live.rocks(readings.sparkSession)
    mode = "processingTime" if ttl_ms is not None else "eventTime" if idle_s is not None else "none"
    return _numbered(readings, plan).groupBy("beacon").transformWithStateInPandas(Cycle(house, n, ttl_ms, idle_s), RECORD, "append", mode)


def records(out: DataFrame, house: House, plan: DataFrame) -> DataFrame:
    """What a cycle stores: place, room, zone, activity and the belief in floors by name."""
    rows = space.labelled(out, plan).withColumn("activity_score", activity_score("var_mean", "delta_mean", "displacement_ft"))
    belief = F.map_from_arrays(F.array(*(F.lit(int(f)) for f in house.floors)), F.transform("belief", lambda p: F.round(p, 4)))
    return rows.select(
        "beacon", "event_id", "t", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "floor", "confidence", "n_eff", "room", F.col("zone").alias("location_label"),
        "activity_score", activity("activity_score").alias("activity"), "displacement_ft", belief.alias("floor_belief"), "n_late",
    )


def positions(readings: DataFrame, path: str, checkpoint: str, house: House | None = None, **how: Any) -> StreamingQuery:
    """Position records of a stream of readings into a Parquet table, a folder for each batch; starts and returns the query."""
    plan = layout.read(readings.sparkSession)
    house = House.of(plan, space.grid(plan)) if house is None else house
    return live.into(records(cycles(readings, house, plan, **how), house, plan), path, checkpoint)


#: Beacons that a task moves on side by side, and the most cycles of theirs that wait for it.
ABREAST, WAITING = 32, 200_000
PLACE = "event_id long, beacon long, x double, y double, floor int, confidence double, n_eff double"


def _sailed(house: House, waiting: list[tuple[Beacon, list[tuple]]]) -> Iterator[pd.DataFrame]:
    """The cycles that wait of some beacons, those of each in turn."""
    waiting = sorted((w for w in waiting if w[1]), key=lambda w: -len(w[1]))
    if not waiting:
        return
    fleet, counts, out = Fleet(house, [b for b, _ in waiting]), np.array([len(due) for _, due in waiting]), []
    for k in range(counts[0]):
        m = int((counts > k).sum())
        event_id, cycle, dt, heard, live = zip(*(due[k] for _, due in waiting[:m]), strict=True)
        n_eff, x, y, floor, confidence = fleet.step(cycle, np.array(heard), np.array(live), np.array(dt))
        out.append((event_id, [b.number for b, _ in waiting[:m]], x, y, floor, confidence, np.round(n_eff, 1)))
    fleet.back()
    yield pd.DataFrame({n: np.concatenate(v) for n, v in zip([c.split()[0] for c in PLACE.split(", ")], zip(*out, strict=True), strict=True)})


def trajectories(readings: DataFrame, plan: DataFrame, cells: DataFrame, n: int = K.PARTICLES, walls: DataFrame | None = None) -> DataFrame:
    """The same cycles over a table of readings (beacon, event_id, t, anchor_idx, rssi): (event_id, beacon, x, y, floor, confidence, n_eff) of each."""
    spark: SparkSession = readings.sparkSession
    house, abreast, most = House.of(plan, cells, walls), ABREAST, WAITING

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[Beacon, list[tuple]]] = []
        b, held, anchors = None, 0, list(house.anchors)
        for pdf in batches:
            for number, event_id, anchor, t, raw in zip(*(pdf[c].tolist() for c in ("beacon", "event_id", "anchor_idx", "t", "rssi")), strict=True):
                if b is None or b.number != number or held >= most:
                    if held >= most or len(waiting) >= abreast:
                        yield from _sailed(house, waiting)
                        waiting, held = [], 0
                    b = b if b is not None and b.number == number else Beacon(house, number, n)
                    waiting.append((b, []))
                due = b.taken(event_id, anchor, t, raw)
                if due is not None:
                    dt, live = due
                    waiting[-1][1].append((event_id, b.cycles, dt, [live[a].x if a in live else 0.0 for a in anchors], [a in live for a in anchors]))
                    held += 1
        yield from _sailed(house, waiting)

    rows = readings.select("beacon", "event_id", "t", "anchor_idx", F.col("rssi").cast("double").alias("rssi"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "beacon").sortWithinPartitions("beacon", "t", "event_id").mapInPandas(follow, PLACE)
