"""Site survey, calibration, and the zone classifier's data preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import distance, expected_rssi, gaussian, noise
from wavefix.operators import space
from wavefix.sources import layout


def aggregated(samples: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of each (point_id, anchor_idx), with the point's counts and flags."""
    one = F.count(F.lit(1)) < 2
    out = samples.groupBy("point_id", "anchor_idx").agg(F.when(one, F.round(F.avg("rssi") + 1e-9, 1)).otherwise(F.round(F.avg("rssi") + 1e-9, 2)).alias("mean"), F.when(one, 0.0).otherwise(F.round(F.stddev_samp("rssi") + 1e-9, 2)).alias("std"), F.count(F.lit(1)).alias("n"))
    point = out.groupBy("point_id").agg(F.count(F.lit(1)).alias("anchor_count"), F.avg("n").cast("int").alias("n_readings"))
    return out.join(point, "point_id").withColumns({"high_var": F.col("std") > K.SURVEY_HIGH_STD, "rejected": F.col("anchor_count") < K.SURVEY_MIN_ANCHORS})


def survey_points(plan: DataFrame, cells: DataFrame, step: float = K.SURVEY_FT) -> DataFrame:
    """Grid, openings, stair entries and points of interest that are walkable, labelled, without repeats, in serpentine order.

    Of points that agree when rounded to whole feet the first kind in this order stays.
    """
    dims = layout.floors(plan)
    axis = lambda lo, hi, name: F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((hi - lo - step / 2) / step).cast("int")), lambda i: lo + step / 2 + i * step)).alias(f"{name}_i", name)
    grid = dims.select("floor", axis(F.col("x_min"), F.col("x_max"), "x"), "y_min", "y_max").select("floor", "x", axis(F.col("y_min"), F.col("y_max"), "y"))
    o = layout.openings(plan)
    kinds = [("grid", grid), ("doorway", o.select("floor", F.col("cx").alias("x"), F.col("cy").alias("y"))), ("stairs", layout.stairs(plan).select(F.col("from_floor").alias("floor"), F.col("ex").alias("x"), F.col("ey").alias("y"))), ("poi", layout.pois(plan).select("floor", F.col("px").alias("x"), F.col("py").alias("y")))]
    out = None
    for i, (name, rows) in enumerate(kinds):
        rows = rows.select("floor", "x", "y", F.lit(name).alias("kind"), F.lit(i).alias("source_rank"))
        out = rows if out is None else out.unionByName(rows)
    arrays = space.grid_arrays(cells)
    out = out.join(F.broadcast(arrays), "floor").where(space.is_walkable(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max"))).drop("w", "h", "free", "x_max", "y_max")
    first = W.partitionBy("floor", F.round("x"), F.round("y")).orderBy("source_rank", "x", "y")
    out = space.labelled(out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"), plan)
    col = F.floor(F.col("x") / step)
    serpentine = W.partitionBy("floor").orderBy(col, F.when(col % 2 == 1, -F.col("y")).otherwise(F.col("y")), "x")
    return out.withColumn("seq", F.row_number().over(serpentine)).select("seq", "floor", "x", "y", "room", "zone", "kind")


def minutes(points: DataFrame) -> DataFrame:
    """Estimated survey time."""
    poi = F.count_if(F.col("kind") == "poi")
    return points.groupBy("floor").agg(F.count(F.lit(1)).alias("n"), (((F.count(F.lit(1)) - poi) * (K.SURVEY_DWELL_S + 15) + poi * 25) / 60).alias("minutes"))


def label_distribution(samples: DataFrame) -> DataFrame:
    """Counts by floor, by room and by zone in one pass."""
    by = [F.col(c) for c in ("floor", "room", "zone")]
    return samples.groupingSets([[c] for c in by], *by).agg(F.count(F.lit(1)).alias("n")).select("floor", "room", "zone", "n")


def remaining(points: DataFrame, completed: DataFrame) -> DataFrame:
    return points.join(completed, "point_id", "left_anti")


#: The two passes of a survey, as fingerprints' notes name them: fixed values.
NORMAL, OCCLUDED = "normal", "occluded"


def note_pass(notes: Column) -> Column:
    """The pass that a fingerprint's notes tell of."""
    return F.when(F.coalesce(notes, F.lit("")).rlike(f"^{OCCLUDED}($|;)"), OCCLUDED).otherwise(NORMAL)


def progress(log: DataFrame) -> DataFrame:
    """Newest entry of each (point_id, pass) of a log (point_id, pass, t, seq, done); a redo is an entry that isn't done."""
    return log.groupBy("point_id", "pass").agg(F.max_by(F.struct("t", "done"), F.struct("t", "seq")).alias("s")).select("point_id", "pass", "s.t", "s.done")


def resumed(points: DataFrame, log: DataFrame, skip_occluded: bool = False) -> DataFrame:
    """What is left of a survey: (point_id, pass) of points (point_id, kind) whose newest entry isn't done.

    Every point is due in the normal pass, points of interest in the occluded one too.
    """
    passes = F.array(F.lit(NORMAL)) if skip_occluded else F.when(F.col("kind") == "poi", F.array(F.lit(NORMAL), F.lit(OCCLUDED))).otherwise(F.array(F.lit(NORMAL)))
    due = points.withColumn("pass", F.explode(passes))
    return due.join(progress(log).where("done"), ["point_id", "pass"], "left_anti")


def path_loss(samples: DataFrame) -> DataFrame:
    """Least squares of strength over log distance: (tx_power, path_loss_n, rmse, n); defaults with fewer than two points."""
    s = samples.select(F.log10(F.col("distance_ft") * K.METRES_PER_FOOT).alias("u"), "rssi").where("u IS NOT NULL")
    f = s.agg(F.regr_intercept("rssi", "u").alias("a"), F.regr_slope("rssi", "u").alias("b"), F.count(F.lit(1)).alias("n"))
    err = s.crossJoin(F.broadcast(f)).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.sqrt(F.avg((F.col("rssi") - F.col("a") - F.col("b") * F.col("u")) * (F.col("rssi") - F.col("a") - F.col("b") * F.col("u")))).alias("e"))
    few = F.coalesce(F.col("n") < 2, F.lit(True)) | F.col("b").isNull()
    return err.select(F.when(few, K.TX_POWER_DBM).otherwise(F.round("a", 1)).alias("tx_power"), F.when(few, K.PATH_LOSS_N).otherwise(F.round(-F.col("b") / 10, 2)).alias("path_loss_n"), F.round("e", 2).alias("rmse"), F.coalesce("n", F.lit(0)).alias("n"))


def residuals(samples: DataFrame) -> DataFrame:
    """Samples (key, distance_ft, rssi) with what their strength differs from the fitted line by; none with fewer than two points."""
    s = samples.withColumn("u", F.log10(F.col("distance_ft") * K.METRES_PER_FOOT)).where("u IS NOT NULL")
    f = s.agg(F.regr_intercept("rssi", "u").alias("a"), F.regr_slope("rssi", "u").alias("b"), F.count(F.lit(1)).alias("n"))
    return s.crossJoin(F.broadcast(f)).where("n >= 2 AND b IS NOT NULL").select("key", F.round(F.col("rssi") - F.col("a") - F.col("b") * F.col("u"), 2).alias("residual"))


def file_fits(samples: DataFrame) -> DataFrame:
    """Path loss fitted to the samples (file, distance_ft, rssi) of all files together (file is null) and to each file's."""
    s = samples.withColumn("u", F.log10(F.col("distance_ft") * K.METRES_PER_FOOT)).where("u IS NOT NULL")
    f = s.groupingSets([[], ["file"]], "file").agg(F.regr_intercept("rssi", "u").alias("a"), F.regr_slope("rssi", "u").alias("b"), F.count(F.lit(1)).alias("n"), F.var_pop("rssi").alias("v"), F.covar_pop("rssi", "u").alias("c"))
    # The mean square of residuals is what the slope leaves of the variance.
    left = F.sqrt(F.greatest(F.col("v") - F.col("b") * F.col("c"), F.lit(0.0)))
    few = (F.col("n") < 2) | F.col("b").isNull()
    return f.select("file", F.when(few, K.TX_POWER_DBM).otherwise(F.round("a", 1)).alias("tx_power"), F.when(few, K.PATH_LOSS_N).otherwise(F.round(-F.col("b") / 10, 2)).alias("path_loss_n"), F.round(left, 2).alias("rmse"), "n")


def wall_attenuation(samples: DataFrame) -> DataFrame:
    """Loss per wall: mean and population deviation of what is missing to free space."""
    d = F.greatest(F.col("distance_ft") * K.METRES_PER_FOOT, F.lit(0.3)) / K.METRES_PER_FOOT
    per = samples.where("n_walls > 0").withColumn("db", (expected_rssi(d) - F.col("rssi")) / F.col("n_walls"))
    return per.agg(F.round(F.avg("db"), 1).alias("db"), F.round(F.stddev_pop("db"), 1).alias("std"), F.count(F.lit(1)).alias("n"))


def calibration_stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy("distance_ft").agg(F.avg("rssi").alias("mean"), F.stddev_pop("rssi").alias("std"), F.count(F.lit(1)).alias("n"))


def poi_relabelled(samples: DataFrame, pois: DataFrame) -> DataFrame:
    """Samples (sample_id, floor, room, x, y, label) within a zone's radius take the nearest zone, others keep their label."""
    p = pois.select("floor", "room", "zone", "zone_pos", "px", "py", "radius")
    d = distance("x", "y", "px", "py")
    out = samples.join(F.broadcast(p), ["floor", "room"], "left").withColumn("d", d)
    out = out.groupBy("sample_id", "label").agg(F.min_by("zone", F.when(F.col("d") <= F.col("radius"), F.struct(F.round("d", 9), "zone_pos"))).alias("near"), F.count_if(F.col("d") <= F.col("radius")).alias("n"))
    return out.select("sample_id", F.when(F.col("n") > 0, F.col("near")).otherwise(F.col("label")).alias("zone"))


def relabelled(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many samples of each former label (sample_id, label) have another zone (sample_id, zone) now."""
    return before.join(after, "sample_id").groupBy("label").agg(F.count_if(F.col("zone") != F.col("label")).alias("relabelled"), F.count(F.lit(1)).alias("n"))


#: Feature families of the classifier's vector, with the value of an absent feature.
FAMILIES = (("rssi", K.MISSING_RSSI), ("delta", 0.0), ("rank", 0.0), ("variance", 0.0))


def feature_names(anchor_ids: list[str]) -> list[str]:
    """The canonical order: four families over the anchors, then sixteen scalars."""
    names = [f"{family}_{a}" for family, _ in FAMILIES for a in sorted(anchor_ids)]
    for f in (1, 2, 3):
        names += [f"n_anchors_floor_{f}", f"rssi_mean_floor_{f}"]
    return [*names, "rssi_best_floor", "same_vs_cross_ratio", "delta_mean", "delta_max", "rank_changes", "rank_gap", "var_mean", "var_max", "n_anchors_reporting", "activity_score"]


def feature_vector(samples: DataFrame, features: DataFrame, names: DataFrame) -> DataFrame:
    """(sample_id, idx, value) with every canonical feature: names match in any case, absent ones get their default."""
    full = samples.select("sample_id").crossJoin(F.broadcast(names))
    got = features.select("sample_id", F.lower("name").alias("key"), "value")
    return full.withColumn("key", F.lower("name")).join(got, ["sample_id", "key"], "left").select("sample_id", "idx", F.coalesce("value", "default").alias("value"))


def scoped(probabilities: DataFrame, zones: DataFrame, rooms: DataFrame) -> DataFrame:
    """Zone probabilities (sample_id, zone, p) of each sample's room (sample_id, room), scaled to 1 and rounded."""
    kept = probabilities.join(F.broadcast(zones), "zone").join(rooms, ["sample_id", "room"])
    total = kept.groupBy("sample_id").agg(F.sum("p").alias("total"))
    return kept.join(total, "sample_id").where("total > 0").select("sample_id", "zone", F.round(F.col("p") / F.col("total"), 4).alias("p"))


def _shaken(key: Column, rssi: Column) -> Column:
    """A heard strength with noise; an absent one stays absent."""
    return F.when(rssi > K.MISSING_RSSI, rssi + K.AUGMENT_SIGMA * gaussian(key, "u1", "u2")).otherwise(rssi)


def augmented(samples: DataFrame, factor: int = K.AUGMENT_FACTOR) -> DataFrame:
    """The samples (sample_id, anchor_idx, rssi) as copy 0 and ``factor`` noisy copies: heard strengths get noise, then some drop out."""
    out = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor))))
    key = F.concat_ws("/", "sample_id", "copy", "anchor_idx")
    return out.select("sample_id", "copy", "anchor_idx", F.when(F.col("copy") == 0, F.col("rssi")).when(noise(key, "drop") < K.AUGMENT_DROPOUT, K.MISSING_RSSI).otherwise(_shaken(key, F.col("rssi"))).alias("rssi"))


def ranked(rows: DataFrame, by: str, key: str, block: int = 4096) -> DataFrame:
    """Add i, the rank from 0 by an integer key within ``by``: blocks of keys are ranked alone, then moved up by those before."""
    rows = rows.withColumn("_block", F.floor(F.col(key) / block))
    sizes = rows.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(sizes.select(by, "_block", ahead.alias("_ahead")), [by, "_block"])
    return out.withColumn("i", F.row_number().over(W.partitionBy(by, "_block").orderBy(key)) - 1 + F.col("_ahead")).drop("_block", "_ahead")


def oversampled(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Extra rows (sample_id, label, copy, extra, anchor_idx, rssi) that bring each label to the largest one's count.

    ``pool`` is ``augmented``, ``labels`` are (sample_id, label). A label's augmented samples give copies in turn,
    each with noise of its own and without dropping out.
    """
    per = pool.select("sample_id", "copy").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("copies"))
    mine = ranked(labels.join(per, "sample_id"), "label", "sample_id")
    counts = mine.groupBy("label").agg(F.sum("copies").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    need = mine.join(F.broadcast(counts), "label").crossJoin(F.broadcast(most)).select("sample_id", "label", "copies", "i", "n", (F.col("most") - F.col("n")).alias("lack")).where("lack > 0")
    out = pool.join(need, "sample_id").withColumn("extras", F.ceil((F.col("lack") - F.col("i") * F.col("copies") - F.col("copy")) / F.col("n")))
    out = out.where("extras > 0").withColumn("extra", F.explode(F.sequence(F.lit(1), F.col("extras").cast("int"))))
    key = F.concat_ws("/", "sample_id", "copy", "anchor_idx", "extra")
    return out.select("sample_id", "label", "copy", "extra", "anchor_idx", _shaken(key, F.col("rssi")).alias("rssi"))


def summary(rows: DataFrame) -> DataFrame:
    """Accuracy, macro-F1 and counts of (label, predicted), rounded."""
    right = rows.agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    macro = class_metrics(rows).agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    return right.crossJoin(F.broadcast(macro))


def zone_of_room(probabilities: DataFrame, zones: DataFrame, rooms: DataFrame) -> DataFrame:
    """(sample_id, zone, confidence): the likeliest zone of each sample's room; no zone and 0 where the room has none."""
    best = scoped(probabilities, zones, rooms).groupBy("sample_id").agg(F.max("p").alias("confidence"), F.min_by("zone", F.struct(-F.col("p"), F.col("zone"))).alias("zone"))
    return rooms.select("sample_id").join(best, "sample_id", "left").select("sample_id", "zone", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def coverage(samples: DataFrame, least: int = 3) -> DataFrame:
    """Quality control by zone: points done of all (zone, point, done), and whether they are enough."""
    return samples.groupBy("zone").agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("total")).withColumn("enough", F.col("done") >= least)


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label in truth or prediction (label, predicted)."""
    pair = F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("label") == F.col("predicted")).cast("int").alias("h")), F.struct(F.col("predicted").alias("l"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("s")
    per = rows.select(pair).groupBy(F.col("s.l").alias("label")).agg(*(F.sum(f"s.{c}").alias(c) for c in "aph"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("label", div(F.col("h"), F.col("p")).alias("precision"), div(F.col("h"), F.col("a")).alias("recall"), div(2 * F.col("h"), F.col("a") + F.col("p")).alias("f1"), F.col("a").alias("support"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
