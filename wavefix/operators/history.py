"""History analytics and the serving views over readings and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K


def latest(readings: DataFrame) -> DataFrame:
    """Newest reading of each (beacon, anchor)."""
    cols = [c for c in readings.columns if c not in ("beacon", "anchor_idx")]
    return readings.groupBy("beacon", "anchor_idx").agg(F.max_by(F.struct(*cols), F.struct("t", "event_id")).alias("s")).select("beacon", "anchor_idx", "s.*")


def devices(newest: DataFrame) -> DataFrame:
    return newest.groupBy("beacon").agg(F.count(F.lit(1)).alias("anchor_count"), F.round(F.min("rssi"), 6).alias("min_rssi"), F.round(F.max("rssi"), 6).alias("max_rssi"))


def device_maps(newest: DataFrame) -> DataFrame:
    """The summary with a map of each device's anchors, as the API shows it."""
    return newest.groupBy("beacon").agg(F.count(F.lit(1)).alias("anchor_count"), F.map_from_entries(F.collect_list(F.struct("anchor_id", "rssi"))).alias("anchors"))


#: Relative accuracy of the sketch that finds the range of values around a rank is one by this; groups of no more rows need none.
ACCURACY = 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(*by, q0, q1, ...): exact linear-interpolated quantiles of each group, without a group in any one task.

    A mergeable sketch bounds the values around each rank; a second pass counts what is below and, by value, what is
    inside, with partial sums, so that a task orders only the distinct values of a range: some ten-thousandths of a group. Nulls don't count; a
    group of nulls alone has no row.
    """
    group = [f"_g{i}" for i in range(len(by))]
    known = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    around = [min(max(q + d / ACCURACY, 0.0), 1.0) for q in at for d in (-4, 4)]
    ends = known.groupBy(*(F.col(f"_k{i}").alias(g) for i, g in enumerate(group))).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", around, ACCURACY).alias("_a"))
    few = F.col("_n") <= ACCURACY
    side = lambda i, all_: F.when(few, F.col(all_)).otherwise(F.col("_a")[i]).alias("_lo" if all_ == "_min" else "_hi")
    ranges = F.array(*(F.struct(F.lit(i).alias("_i"), ((F.col("_n") - 1) * F.lit(q)).alias("_at"), side(2 * i, "_min"), side(2 * i + 1, "_max")) for i, q in enumerate(at)))
    todo = ends.select(*group, F.explode(ranges).alias("_r")).select(*group, "_r.*")
    mine = [F.col(f"_k{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)] + [F.col("_v") <= F.col("_hi")]
    inside = known.join(todo, mine).groupBy(*group, "_i", "_at", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    past = F.sum("_n").over(W.partitionBy(*group, "_i").orderBy(F.asc_nulls_first("_x")))
    inside = inside.withColumn("_past", past)
    found = lambda f: F.min(F.when(F.col("_past") > f("_at"), F.col("_x")))
    low, high, part = found(F.floor), found(F.ceil), F.first("_at") - F.floor(F.first("_at"))
    each = inside.groupBy(*group, "_i").agg((low + F.when(part > 0, (high - low) * part).otherwise(0.0)).alias("_q"))
    return each.groupBy(*group).agg(*(F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(at)))).select(*(F.col(g).alias(c) for g, c in zip(group, by, strict=True)), *(f"q{i}" for i in range(len(at))))


def gaps(readings: DataFrame) -> DataFrame:
    """Message rate and gaps of each beacon."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy("beacon").orderBy("t", "event_id"))
    rows = readings.withColumn("gap", gap)
    out = rows.groupBy("beacon").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    out = out.join(quantiles(rows, ["beacon"], "gap", [0.5]).withColumnRenamed("q0", "median_gap"), "beacon", "left")
    return out.withColumn("rate", F.when(F.col("b") > F.col("a"), (F.col("n") - 1) / (F.col("b") - F.col("a")))).drop("a", "b")


def page(rows: DataFrame, limit: int, beacon: Column | None = None) -> DataFrame:
    """The newest ``limit`` rows, newest first."""
    return (rows if beacon is None else rows.where(beacon)).orderBy(F.desc("t"), F.desc("event_id")).limit(limit)


def dwell_rows(rows: DataFrame) -> DataFrame:
    """Share of rows at each label."""
    per = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("fraction"))


def dwell_time(rows: DataFrame) -> DataFrame:
    """Share of time at each label: a row lasts until its beacon's next one."""
    until = F.lead("t").over(W.partitionBy("beacon").orderBy("t", "event_id"))
    per = rows.withColumn("s", F.coalesce(until - F.col("t"), F.lit(0.0))).groupBy("label").agg(F.sum("s").alias("s"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("s").alias("total")))).select("label", F.col("s").alias("seconds"), (F.col("s") / F.col("total")).alias("fraction"))


def activity_breakdown(rows: DataFrame) -> DataFrame:
    per = rows.groupBy(F.coalesce("activity", F.lit("unknown")).alias("activity")).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("activity", "n", (F.col("n") * 100 / F.col("total")).alias("pct"))


def floor_timeline(rows: DataFrame) -> DataFrame:
    """Runs of constant floor per beacon, each lasting to the first row of the next; minutes from the beacon's start.

    A last run of a single row is left out, as its end is its start.
    """
    w = W.partitionBy("beacon").orderBy("t", "event_id")
    out = rows.withColumns({"new": F.coalesce(F.col("floor") != F.lag("floor").over(w), F.lit(True)), "t0": F.min("t").over(W.partitionBy("beacon"))})
    out = out.withColumn("seg", F.sum(F.col("new").cast("int")).over(w))
    per = out.groupBy("beacon", "seg").agg(F.first("floor").alias("floor"), F.min("t").alias("a"), F.max("t").alias("z"), F.count(F.lit(1)).alias("n"), F.first("t0").alias("t0"))
    after = F.lead("a").over(W.partitionBy("beacon").orderBy("seg"))
    per = per.withColumn("after", after).where("after IS NOT NULL OR n > 1")
    return per.select("beacon", "seg", "floor", ((F.col("a") - F.col("t0")) / 60).alias("start_min"), ((F.coalesce("after", "z") - F.col("t0")) / 60).alias("end_min"))


def trail(rows: DataFrame, last: int = 60, slices: int = 5) -> DataFrame:
    """The newest ``last`` positions of each beacon in ``slices`` overlapping pieces: (beacon, seg, n, first and last point)."""
    newest = W.partitionBy("beacon").orderBy(F.desc("t"), F.desc("event_id"))
    kept = rows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last)
    kept = kept.withColumns({"i": F.row_number().over(W.partitionBy("beacon").orderBy("t", "event_id")) - 1, "total": F.count(F.lit(1)).over(W.partitionBy("beacon"))})
    step = F.greatest(F.lit(1), F.floor(F.col("total") / slices))
    out = kept.withColumn("step", step).withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    out = out.where((F.col("i") >= F.col("seg") * F.col("step")) & (F.col("i") <= F.col("seg") * F.col("step") + F.col("step")))
    at = lambda pick, c: pick(c, "i").alias
    return out.groupBy("beacon", "seg").agg(F.count(F.lit(1)).alias("n"), at(F.min_by, "x")("x0"), at(F.min_by, "y")("y0"), at(F.max_by, "x")("x1"), at(F.max_by, "y")("y1")).where("n > 1")


def sparkline(readings: DataFrame) -> DataFrame:
    """Index of each reading within its (beacon, anchor) series."""
    return readings.withColumn("i", F.row_number().over(W.partitionBy("beacon", "anchor_idx").orderBy("t", "event_id")) - 1)


def zone_means(probabilities: DataFrame, samples: DataFrame, top: int = 6) -> DataFrame:
    """Mean probability of each zone over all samples, absent ones counting as 0; the ``top`` of them."""
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    return probabilities.groupBy("zone").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(n)).select("zone", (F.col("s") / F.col("n")).alias("mean_p")).orderBy(F.desc(F.round("mean_p", 9)), "zone").limit(top)


def top_zones(probabilities: DataFrame, top: int = 4) -> DataFrame:
    """The ``top`` likeliest zones of each sample with their rank."""
    order = W.partitionBy("sample_id").orderBy(F.desc(F.round("p", 9)), "zone")
    return probabilities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Rows shown for a history of so many hours: fixed values.
WINDOWS = {1: 500, 3: 1500, 6: 3000, 12: 5000, 24: 10000}


def window(rows: DataFrame, hours: int) -> DataFrame:
    """The newest rows of the last ``hours``, in order, as many as that window shows."""
    last = rows.agg(F.max("t").alias("last"))
    recent = rows.crossJoin(F.broadcast(last)).where(F.col("t") >= F.col("last") - hours * 3600).drop("last")
    return page(recent, WINDOWS[hours]).orderBy("t", "event_id")


def records(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """What a cycle stores: positions (with room and zone of the plan) and the classifier's (event_id, zone, confidence).

    The classifier's zone is the label where it has one, else the plan's.
    """
    z = zones.select("event_id", F.col("zone").alias("zone_label"), F.round(F.col("confidence") + 1e-9, 3).alias("zone_confidence"))
    out = positions.withColumnRenamed("zone", "polygon_label").join(z, "event_id", "left")
    return out.select(
        "event_id", "beacon", "ts", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "floor", F.round("confidence", 3).alias("confidence"), F.coalesce("zone_label", "polygon_label").alias("location_label"),
        "activity", "polygon_label", "zone_label", F.coalesce("zone_confidence", F.lit(0.0)).alias("zone_confidence"),
    )


def density(points: DataFrame, size: float = K.DENSITY_FT) -> DataFrame:
    """Neighbours of each particle in its 3 x 3 bins, scaled to 0..1 (0.5 where all are equal)."""
    bins = points.withColumns({"bx": (F.col("x") / size).cast("int"), "by": (F.col("y") / size).cast("int")})
    counts = bins.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    step = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    spread = counts.select("n", step("bx"), "by").select("n", "bx", step("by")).groupBy("bx", "by").agg(F.sum("n").alias("near"))
    out = bins.join(spread, ["bx", "by"])
    ends = out.agg(F.min("near").alias("lo"), F.max("near").alias("hi"))
    return out.crossJoin(F.broadcast(ends)).select("pid", F.when(F.col("hi") > F.col("lo"), (F.col("near") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5).alias("density"))


def heatmap(points: DataFrame, size: float = K.DENSITY_FT) -> DataFrame:
    return points.groupBy("floor", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def floor_agreement(beliefs: DataFrame, positions: DataFrame) -> DataFrame:
    """Does the belief's likeliest floor agree with the filter's?"""
    return beliefs.select("event_id", F.col("floor").alias("hmm_floor")).join(positions.select("event_id", F.col("floor").alias("pf_floor")), "event_id").withColumn("agree", F.col("hmm_floor") == F.col("pf_floor"))


def stage_percentiles(times: DataFrame) -> DataFrame:
    """Linear-interpolated percentiles of stage times (stage, ms), with throughput and share of the total."""
    out = times.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("min_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total"))
    out = out.join(quantiles(times, ["stage"], "ms", [0.5, 0.95, 0.99]), "stage")
    whole = out.agg(F.sum("total").alias("whole"))
    return out.crossJoin(F.broadcast(whole)).select("stage", "n", "min_ms", "mean_ms", F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99"), "max_ms", (1000 / F.col("mean_ms")).alias("per_s"), (F.col("total") * 100 / F.col("whole")).alias("pct"))
