"""Per-cycle signal features. Every reading of a beacon is one cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K

#: Added before rounding, so that ties do not depend on the last bit of a sum.
TIE = 1e-9


def cycles(readings: DataFrame) -> DataFrame:
    """Add ``cycle``, from 1 within the beacon."""
    return readings.withColumn("cycle", F.row_number().over(W.partitionBy("beacon").orderBy("t", "event_id")).cast("long"))


def as_of(rows: DataFrame, *columns: str) -> DataFrame:
    """For each cycle and each anchor that its beacon has heard so far, ``columns`` of the newest reading, its age and when it was first heard.

    An as-of join of cycles (event_id, beacon, anchor_idx, cycle, t) with all anchors as one window over (beacon, anchor). A cycle
    meets only anchors its beacon has heard by then, so it makes no rows but those it returns, whatever anchors there are.
    """
    first = rows.groupBy("beacon", "anchor_idx").agg(F.min("cycle").alias("first_seen")).groupBy("beacon").agg(F.collect_list(F.struct(F.col("anchor_idx").alias("anchor"), "first_seen")).alias("known"))
    out = rows.select("event_id", "beacon", "anchor_idx", "cycle", "t", *columns).join(first, "beacon")
    out = out.withColumn("k", F.explode(F.filter("known", lambda k: k["first_seen"] <= F.col("cycle"))))
    heard = F.when(F.col("k.anchor") == F.col("anchor_idx"), F.struct(*columns, F.col("t").alias("_at")))
    so_far = W.partitionBy("beacon", "k.anchor").orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    out = out.select("event_id", "beacon", "cycle", "t", F.col("k.anchor").alias("anchor_idx"), F.col("k.first_seen").alias("first_seen"), F.last(heard, True).over(so_far).alias("_h"))
    return out.select("event_id", "beacon", "cycle", "t", "anchor_idx", *(F.col(f"_h.{c}").alias(c) for c in columns), (F.col("t") - F.col("_h._at")).alias("age"), "first_seen")


def vectors(cycle_rows: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """The newest raw and, with the filters' ``states``, smoothed strength (x) of each anchor in each cycle."""
    if states is None:
        return as_of(cycle_rows, "rssi").withColumnRenamed("rssi", "raw")
    return as_of(cycle_rows.join(states.select("event_id", "x"), "event_id"), "rssi", "x").withColumnRenamed("rssi", "raw")


def deltas(vec: DataFrame) -> DataFrame:
    """Change of each anchor's raw strength since the cycle before; an anchor new in a cycle has none."""
    prev = F.lag("raw").over(W.partitionBy("beacon", "anchor_idx").orderBy("cycle"))
    return vec.withColumn("delta", F.col("raw") - prev)


def delta_features(vec: DataFrame) -> DataFrame:
    d = F.abs("delta")
    return deltas(vec).groupBy("event_id", "beacon", "cycle").agg(F.coalesce(F.round(F.avg(d) + TIE, 3), F.lit(0.0)).alias("delta_mean"), F.coalesce(F.round(F.max(d) + TIE, 3), F.lit(0.0)).alias("delta_max"))


def variances(readings: DataFrame, window: int = K.FEATURE_WINDOW) -> DataFrame:
    """Sample variance of each series' last ``window`` changed strengths, and how many there are; repeats of a value add nothing."""
    series = W.partitionBy("beacon", "anchor_idx").orderBy("t", "event_id")
    out = readings.withColumn("new", F.coalesce(F.col("rssi") != F.lag("rssi").over(series), F.lit(True)))
    changed = W.partitionBy("beacon", "anchor_idx", "new").orderBy("t", "event_id").rowsBetween(-(window - 1), 0)
    out = out.withColumn("v", F.when(F.col("new"), F.struct(F.round(F.coalesce(F.var_samp("rssi").over(changed) + TIE, F.lit(0.0)), 3).alias("var"), F.count("rssi").over(changed).alias("n"))))
    carried = F.last("v", True).over(series.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("v", carried).select("event_id", "beacon", "anchor_idx", "t", F.col("v.var").alias("variance"), F.col("v.n").alias("n_window"))


def fresh(vec: DataFrame, stale: float = K.STALE_S) -> DataFrame:
    return vec.where(F.col("age") <= stale)


def ranks(vec: DataFrame) -> DataFrame:
    """Rank of each live anchor in a cycle by smoothed strength; ties (to nine decimals) go to the one heard first."""
    order = W.partitionBy("event_id").orderBy(F.desc(F.round("x", 9)), "first_seen", "anchor_idx")
    return fresh(vec).withColumn("rank", F.row_number().over(order).cast("long"))


def rank_changes(ranked: DataFrame) -> DataFrame:
    """How many anchors of a cycle were live in the cycle before at another rank."""
    before = ranked.select("beacon", "anchor_idx", (F.col("cycle") + 1).alias("cycle"), F.col("rank").alias("was"))
    out = ranked.join(before, ["beacon", "anchor_idx", "cycle"], "left")
    return out.groupBy("event_id", "beacon", "cycle").agg(F.count_if(F.col("was") != F.col("rank")).alias("rank_changes"))


def strongest(ranked: DataFrame) -> DataFrame:
    """Strongest anchor of each cycle and how far the second is behind it."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("x")))
    return ranked.groupBy("event_id", "beacon", "cycle").agg(F.max(F.when(F.col("rank") == 1, F.col("anchor_idx"))).alias("strongest"), F.coalesce(F.round(at(1) - at(2), 3), F.lit(0.0)).alias("gap"), F.count(F.lit(1)).alias("n_reporting"))


def floor_signal(vec: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per cycle: each floor's count and mean, the best floor, and how far it is above the mean of the others."""
    per = fresh(vec).join(F.broadcast(anchors.select("anchor_idx", "floor")), "anchor_idx").groupBy("event_id", "beacon", "cycle", "floor").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    best = F.max_by("floor", F.struct(F.round("mean", 9), -F.col("floor")))
    out = per.groupBy("event_id", "beacon", "cycle").agg(best.alias("best_floor"), F.max("mean").alias("top"), F.sum("mean").alias("total"), F.count(F.lit(1)).alias("n_floors"))
    return out.select("event_id", "beacon", "cycle", "best_floor", F.when(F.col("n_floors") > 1, F.round(F.col("top") - (F.col("total") - F.col("top")) / (F.col("n_floors") - 1) + TIE, 2)).otherwise(0.0).alias("ratio"), "n_floors")


def displacement(positions: DataFrame, window: int = K.POSITION_WINDOW) -> DataFrame:
    """Distance from the oldest of the last ``window`` positions; 1 where the floor differs, 0 with one position only."""
    w = W.partitionBy("beacon").orderBy("t", "event_id").rowsBetween(-(window - 1), 0)
    first = lambda c: F.first(c).over(w)
    d = F.sqrt((F.col("x") - first("x")) * (F.col("x") - first("x")) + (F.col("y") - first("y")) * (F.col("y") - first("y")))
    value = F.when(F.count(F.lit(1)).over(w) < 2, 0.0).when(first("floor") != F.col("floor"), 1.0).otherwise(d)
    return positions.select("event_id", "beacon", F.round(value, 3).alias("displacement_ft"))


def dt(cycle_rows: DataFrame) -> Column:
    """Seconds since the beacon's last cycle, at most MAX_DT; the first gets the default."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy("beacon").orderBy("t", "event_id"))
    return F.coalesce(F.least(gap, F.lit(K.MAX_DT)), F.lit(K.DEFAULT_DT))
