"""Particle filter steps as relational operators, and the whole filter as one state function per beacon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import distance, expected_rssi, gaussian, log_likelihood, noise, power
from wavefix.operators import space
from wavefix.sources import layout


def drift_targets(latest: DataFrame) -> DataFrame:
    """Power-weighted centre of each floor's anchors: (beacon, floor, tx, ty) from (beacon, floor, ax, ay, rssi)."""
    w = power("rssi")
    return latest.groupBy("beacon", "floor").agg((F.sum(w * F.col("ax")) / F.sum(w)).alias("tx"), (F.sum(w * F.col("ay")) / F.sum(w)).alias("ty"))


def predicted(cloud: DataFrame, targets: DataFrame, arrays: DataFrame, dt: float | Column) -> DataFrame:
    """Move particles by noise and drift, at most as fast as walking, where no wall is in the way: adds nx, ny, accepted."""
    out = cloud.join(targets.select("beacon", "floor", F.col("tx").alias("gx"), F.col("ty").alias("gy")), ["beacon", "floor"], "left")
    sigma = K.MOTION_SIGMA * dt**0.5
    move = lambda p, g, a, b: sigma * gaussian("pid", a, b) + F.coalesce(K.DRIFT_RATE * dt * (F.col(g) - F.col(p)), F.lit(0.0))
    out = out.withColumns({"mx": move("x", "gx", "u1", "u2"), "my": move("y", "gy", "n1", "n2")})
    far = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    cap = K.MAX_SPEED_FT_S * dt
    scale = F.when(far > cap, cap / far).otherwise(1.0)
    out = out.withColumns({"tx": F.col("x") + F.col("mx") * scale, "ty": F.col("y") + F.col("my") * scale})
    out = space.rays(out, arrays).join(F.broadcast(arrays), "floor")
    good = F.col("clear") & F.coalesce(space.is_walkable(F.col("tx"), F.col("ty"), F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max")), F.lit(False))
    return out.select("beacon", "pid", "floor", F.when(good, F.col("tx")).otherwise(F.col("x")).alias("nx"), F.when(good, F.col("ty")).otherwise(F.col("y")).alias("ny"), good.alias("accepted"))


def elevation(cloud: DataFrame, plan: DataFrame) -> DataFrame:
    """Add z: the floor's height, or along the first stair run (of the floor) that spans y when beside the staircase."""
    runs = layout.runs(plan).groupBy("floor").agg(F.array_sort(F.collect_list(F.struct("run_pos", "low_z", "high_z", "entry_y_low", "entry_y_high"))).alias("runs"))
    dims = layout.floors(plan).select("floor", "elevation").join(runs, "floor", "left").join(layout.staircase_bounds(plan), "floor", "left")
    out = cloud.join(F.broadcast(dims), "floor", "left")
    y = F.col("y")
    run = F.get(F.filter("runs", lambda r: (y >= F.least(r["entry_y_low"], r["entry_y_high"])) & (y <= F.greatest(r["entry_y_low"], r["entry_y_high"]))), F.lit(0))
    out = out.withColumn("_run", F.when(F.col("x") <= F.col("x_max"), run))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_run.entry_y_low") - y) / (F.col("_run.entry_y_low") - F.col("_run.entry_y_high"))))
    z = F.col("_run.low_z") + share * (F.col("_run.high_z") - F.col("_run.low_z"))
    return out.withColumn("z", F.coalesce(z, "elevation", F.lit(0.0))).drop("_run", "runs", "x_max", "elevation")


def seen_from(cloud: DataFrame, heard: DataFrame, plan: DataFrame, cells: DataFrame, walls: DataFrame) -> DataFrame:
    """Each beacon's particles with the anchors that hear it (beacon, anchor, rssi): distance and log likelihood.

    ``walls`` is ``space.anchor_rays``: of the plan's size, so it is broadcast.
    """
    a = heard.select("beacon", "anchor_idx", F.col("floor").alias("a_floor"), "ax", "ay", "az", "rssi")
    both = elevation(space.in_cells(cloud, cells), plan).join(a, "beacon")
    both = both.join(F.broadcast(walls.select("floor", "row", "col", "anchor_idx", "n_walls")), ["floor", "row", "col", "anchor_idx"], "left")
    d = distance("x", "y", "ax", "ay", "z", "az")
    expected = expected_rssi(d, F.abs(F.col("floor") - F.col("a_floor")), F.coalesce("n_walls", F.lit(0)))
    return both.withColumns({"dist": d, "expected": expected, "ll": log_likelihood("rssi", expected)})


def weights(pairs: DataFrame, prior: Column | None = None) -> DataFrame:
    """Normalised weights (beacon, pid, w) from ``seen_from``: a beacon's largest log weight is taken off before exp.

    A beacon has a fixed number of particles, so its window is small.
    """
    own = W.partitionBy("beacon")
    logw = pairs.groupBy("beacon", "pid", "floor", "x", "y").agg(F.sum("ll").alias("logw"))
    raw = logw.withColumn("raw", F.exp(F.col("logw") - F.max("logw").over(own)) * (F.lit(1.0) if prior is None else prior))
    total = F.sum("raw").over(own)
    return raw.select("beacon", "pid", "floor", "x", "y", F.when(total > 0, F.col("raw") / total).otherwise(1 / F.count(F.lit(1)).over(own)).alias("w"))


def n_eff(cloud: DataFrame, *by: str) -> DataFrame:
    """(n_eff, n) of all particles or of those of each ``by``."""
    return cloud.groupBy(*by).agg((1 / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), F.count(F.lit(1)).alias("n"))


def around(ids: DataFrame, cells: DataFrame, x: float, y: float, floor: int, spread: float = 5.0, tries: int = 100) -> DataFrame:
    """Places (beacon, pid, x, y, floor) for particles (beacon, pid) in a Gaussian cloud around a point.

    Each takes its first walkable draw of ``tries``. Those without any take the places of the beacon's others in turn;
    where a beacon has none at all its particles have no place.
    """
    arrays = space.grid_arrays(cells.where(F.col("floor") == floor)).drop("floor")
    draw = lambda k, at, a, b: at + spread * gaussian(F.concat_ws("/", "pid", k.cast("string")), a, b)
    spots = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: F.struct(draw(k, x, "u1", "u2").alias("x"), draw(k, y, "n1", "n2").alias("y")))
    good = F.filter("spots", lambda s: F.coalesce(space.is_walkable(s["x"], s["y"], F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max")), F.lit(False)))
    out = ids.crossJoin(F.broadcast(arrays)).withColumn("spots", spots).select("beacon", "pid", F.get(good, F.lit(0)).alias("s"))
    found = F.col("s").isNotNull()
    out = out.withColumns({"i": F.row_number().over(W.partitionBy("beacon", found).orderBy("pid")) - 1, "n": F.count("s").over(W.partitionBy("beacon"))})
    lender = out.where(found).select("beacon", F.col("i").alias("from"), F.col("s").alias("lent"))
    out = out.withColumn("from", F.when(found, F.lit(-1)).otherwise(F.expr("try_mod(i, n)"))).join(lender, ["beacon", "from"], "left")
    s = F.coalesce("s", "lent")
    return out.select("beacon", "pid", s["x"].alias("x"), s["y"].alias("y"), F.lit(floor).alias("floor"))


def changed_floor(cloud: DataFrame, belief: DataFrame, plan: DataFrame, dt: float | Column) -> DataFrame:
    """Particles (beacon, pid, x, y, floor, cooldown) after a step in which those beside a stairway may take it.

    Stairways count in order and a particle takes the first that its draw lets it take, if there is a way back; it then
    waits. ``belief`` (beacon, floor, p) is the floor model's; the chance falls with the distance.
    """
    s = layout.stairs(plan)
    back = s.groupBy(F.col("to_floor").alias("from_floor"), F.col("from_floor").alias("to_floor")).agg(F.min_by(F.struct("ex", "ey"), "stair_pos").alias("back"))
    ways = F.broadcast(s.join(back, ["from_floor", "to_floor"]).withColumnRenamed("from_floor", "floor"))
    out = cloud.withColumn("cooldown", F.greatest(F.col("cooldown") - dt, F.lit(0.0)))
    d = distance("x", "y", "ex", "ey")
    near = out.where("cooldown = 0").join(ways, "floor").withColumn("d", d).where(F.col("d") < K.STAIR_RADIUS_FT)
    near = near.join(belief.select("beacon", F.col("floor").alias("to_floor"), "p"), ["beacon", "to_floor"], "left")
    chance = F.least(F.coalesce("p", F.lit(0.0)) * K.STAIR_RATE * dt, F.lit(0.4)) * F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - F.col("d") / K.STAIR_RADIUS_FT))
    took = near.where(noise(F.concat_ws("/", "pid", "stair_pos"), "r") < chance).groupBy("beacon", "pid").agg(F.min_by(F.struct("to_floor", "back"), "stair_pos").alias("went"))
    out = out.join(took, ["beacon", "pid"], "left")
    moved = F.col("went").isNotNull()
    place = lambda c: F.when(moved, F.col(f"went.back.e{c}")).otherwise(F.col(c)).alias(c)
    return out.select("beacon", "pid", place("x"), place("y"), F.coalesce("went.to_floor", "floor").alias("floor"), F.when(moved, K.STAIR_COOLDOWN_S).otherwise(F.col("cooldown")).alias("cooldown"), moved.alias("moved"))


def teleported(cloud: DataFrame, belief: DataFrame, held: DataFrame, adjacency: DataFrame, cells: DataFrame) -> DataFrame:
    """Particles (beacon, pid, x, y, floor, w) after the check of the floor model against them: adds moved.

    Where the floor of most belief (beacon, floor, p) is not the one of most particles (the lower of equals) but beside it, is believed
    enough and has been for long enough (``held``: beacon, seconds), the particles of least weight
    go to walkable cells of that floor and all weights become equal.
    """
    n = F.count(F.lit(1))
    most = cloud.groupBy("beacon", "floor").agg(n.alias("k")).groupBy("beacon").agg(F.max_by("floor", F.struct("k", -F.col("floor"))).alias("most"), F.sum("k").alias("n"))
    best = belief.groupBy("beacon").agg(F.max_by(F.struct("floor", "p"), F.struct("p", -F.col("floor"))).alias("b"))
    due = most.join(best, "beacon").join(held, "beacon").where((F.col("b.floor") != F.col("most")) & (F.col("b.p") >= K.TELEPORT_BELIEF) & (F.col("seconds") >= K.TELEPORT_HOLD_S))
    due = due.join(F.broadcast(adjacency.select(F.col("floor_a").alias("most"), F.col("floor_b").alias("to"))), "most").where("to = b.floor")
    due = due.select("beacon", "to", "n", F.greatest(F.lit(1), F.floor(F.col("n") * K.TELEPORT_SHARE)).alias("k"))
    spots = cells.where("walkable").groupBy(F.col("floor").alias("to")).agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("spots"))
    least = W.partitionBy("beacon").orderBy("w", "pid")
    out = cloud.join(due.join(F.broadcast(spots), "to"), "beacon", "left").withColumn("i", F.row_number().over(least))
    moved = F.coalesce(F.col("i") <= F.col("k"), F.lit(False))
    spot = F.get("spots", F.floor(noise(F.concat_ws("/", "beacon", "pid"), "r") * F.size("spots")).cast("int"))
    place = lambda c, cell: F.when(F.col("moved"), (spot[cell] + 0.5) * K.GRID_FT).otherwise(F.col(c)).alias(c)
    return out.withColumn("moved", moved).select("beacon", "pid", place("x", "col"), place("y", "row"), F.when(F.col("moved"), F.col("to")).otherwise(F.col("floor")).alias("floor"), F.when(F.col("k").isNotNull(), 1 / F.col("n")).otherwise(F.col("w")).alias("w"), "moved")


def prefix_sums(cloud: DataFrame, blocks: int = 64) -> DataFrame:
    """Running sum of w by pid (cum, before) in two levels: within blocks of pids, then over the blocks' totals."""
    lo = cloud.agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    out = cloud.crossJoin(F.broadcast(lo)).withColumn("block", F.floor((F.col("pid") - F.col("lo")) * blocks / (F.col("hi") - F.col("lo") + 1)))
    sums = out.groupBy("block").agg(F.sum("w").alias("s"))
    ahead = sums.select("block", F.coalesce(F.sum("s").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("ahead"))
    inside = F.sum("w").over(W.partitionBy("block").orderBy("pid").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("inside", inside).join(F.broadcast(ahead), "block").withColumn("cum", F.col("inside") + F.col("ahead")).drop("block", "inside", "ahead", "lo", "hi")


def resampled(cloud: DataFrame, n: int, u: float) -> DataFrame:
    """Systematic resampling: slot i takes the particle whose cumulative weight first reaches (i + u) / n.

    A particle covers the slots from ceil(before * n - u) to ceil(cum * n - u) - 1, so each row
    explodes into its own slots and no range join is needed; the last particle takes what rounding leaves.
    """
    c = prefix_sums(cloud)
    last = cloud.agg(F.max("pid").alias("last"))
    first_slot = F.greatest(F.lit(0), F.ceil(F.round((F.col("cum") - F.col("w")) * n - u, 9)))
    end_slot = F.when(F.col("pid") == F.col("last"), n).otherwise(F.least(F.lit(n), F.ceil(F.round(F.col("cum") * n - u, 9))))
    out = c.crossJoin(F.broadcast(last)).withColumns({"a": first_slot, "b": end_slot}).where("a < b")
    return out.select(F.explode(F.sequence("a", F.col("b") - 1)).alias("slot"), "pid")


def estimate(cloud: DataFrame, *by: str) -> DataFrame:
    """Floor of most weight, its weighted mean position, confidence, and the effective number of particles."""
    w = F.col("w")
    per = cloud.groupBy(*by, "floor").agg(F.sum(w).alias("s"), *(F.sum(w * F.col(c)).alias(f"s{c}") for c in "xy"), *(F.sum(w * F.col(c) * F.col(c)).alias(f"q{c}") for c in "xy"), F.sum(w * w).alias("w2"))
    per = per.withColumns({"mx": F.col("sx") / F.col("s"), "my": F.col("sy") / F.col("s")})
    spread = F.sqrt(F.greatest(F.col("qx") / F.col("s") - F.col("mx") * F.col("mx"), F.lit(0.0)) + F.greatest(F.col("qy") / F.col("s") - F.col("my") * F.col("my"), F.lit(0.0)))
    per = per.withColumn("conf", F.round(F.col("s") * F.exp(-spread / 5), 3))
    best = F.max_by(F.struct("floor", "mx", "my", "conf"), F.struct("s", -F.col("floor"))).alias("b")
    return per.groupBy(*by).agg(best, F.round(1 / F.sum("w2"), 1).alias("n_eff")).select(*by, F.col("b.mx").alias("x"), F.col("b.my").alias("y"), F.col("b.floor").alias("floor"), F.col("b.conf").alias("confidence"), "n_eff")


def zone_reweighted(cloud: DataFrame, pois: DataFrame, probability: DataFrame, room: str, room_p: float) -> DataFrame:
    """Scale weights by the classifier's zone probabilities: (pid, zone, w).

    A particle within a zone's radius takes the first such zone in order that has a
    positive probability; others take the room's. Without any particle in a zone nothing changes.
    """
    z = pois.where(F.col("room") == room).join(probability, "zone").where("p > 0").select(F.col("floor").alias("zf"), "zone_pos", "zone", "px", "py", "radius", "p")
    near = (F.col("floor") == F.col("zf")) & (distance("x", "y", "px", "py") <= F.col("radius"))
    hit = cloud.join(F.broadcast(z), near, "left").groupBy("pid", "floor", "w").agg(F.min_by(F.struct("zone", "p"), "zone_pos").alias("z"))
    floors = z.agg(F.collect_set("zf").alias("zfs"))
    k = K.ZONE_LIKELIHOOD_STRENGTH
    factor = F.when(F.col("z.zone").isNotNull(), F.pow(F.greatest(F.col("z.p"), F.lit(0.01)), F.lit(k))).when(F.array_contains("zfs", F.col("floor")), F.lit(max(room_p, 0.01) ** k)).otherwise(1.0)
    out = hit.crossJoin(F.broadcast(floors)).withColumn("f", factor)
    total = out.agg(F.sum(F.col("w") * F.col("f")).alias("total"), F.count("z.zone").alias("n_in"), F.sum("w").alias("was"))
    scaled = F.when((F.col("n_in") > 0) & (F.col("total") > 0), F.col("w") * F.col("f") / F.col("total")).otherwise(F.col("w"))
    return out.crossJoin(F.broadcast(total)).select("pid", F.coalesce("z.zone", F.lit("")).alias("zone"), scaled.alias("w"))


def zone_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a reweighting did: particles in a zone, and how far the largest factor of a weight is from the least."""
    rows = before.select("pid", F.col("w").alias("was")).join(after, "pid").where("was > 0").withColumn("f", F.col("w") / F.col("was"))
    n = F.count_if(F.col("zone") != "")
    return rows.agg(n.alias("particles_in_poi"), n.alias("particles_reweighted"), F.when(n == 0, 1.0).otherwise(F.round(F.max("f") / F.greatest(F.min("f"), F.lit(1e-12)), 2)).alias("max_weight_shift"))
