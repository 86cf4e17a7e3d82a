"""Registered queries over the floor plan and the particle cloud."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import confidence_radius, noise, power
from wavefix.operators import floors, history, particles, space, survey
from wavefix.plans.signals import C, ORACLES, QUERIES, R, query, rounded
from wavefix.sources import layout, readings
from wavefix.streaming import cycle

__all__ = ["ORACLES", "QUERIES"]

V = layout.values
DT = 0.4


def _plan(spark: SparkSession) -> DataFrame:
    return readings.plan(spark)


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.particles(spark, sf_dir)


_FIXED: dict[tuple[str, str], DataFrame] = {}


def _fixed(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the plan's size, computed once in an application."""
    at = spark.sparkContext.applicationId, name
    if at not in _FIXED:
        for old in [x for x in _FIXED if x[0] != at[0]]:
            del _FIXED[old]
        df = make()
        _FIXED[at] = spark.createDataFrame(df.collect(), df.schema).coalesce(1)
    return _FIXED[at]


def _cells(spark: SparkSession) -> DataFrame:
    return _fixed(spark, "cells", lambda: space.grid(_plan(spark)))


def _walls(spark: SparkSession) -> DataFrame:
    return _fixed(spark, "walls", lambda: space.anchor_rays(_cells(spark), _snapped(spark, _cells(spark))))


def _by_events(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan-sized tables with how many readings concern their floor."""
    n = readings.readings(spark, sf_dir).groupBy("floor").agg(F.count(F.lit(1)).alias("n_readings"))
    return df.join(F.broadcast(n), "floor", "left").fillna(0, ["n_readings"])


COUNTS = "nf AS (SELECT floor, count(*) AS n FROM r GROUP BY 1)"


@query(f"WITH {R}, {COUNTS}, s AS (SELECT from_floor AS a, to_floor AS b FROM {V('stairs')}) SELECT DISTINCT a AS floor_a, b AS floor_b, coalesce(n, 0) AS n_readings FROM (SELECT a, b FROM s UNION ALL SELECT b, a FROM s) LEFT JOIN nf ON nf.floor = a")
def floor_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.adjacency(_plan(spark)).withColumnRenamed("floor_a", "floor")
    return _by_events(rows, spark, sf_dir).withColumnRenamed("floor", "floor_a")


@query(f"WITH {C}, {space.SQL_ROOM} SELECT pid, room, zone FROM lab")
def room_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.labelled(_cloud(spark, sf_dir), _plan(spark)).select("pid", "room", "zone")


@query(f"WITH {C}, {space.SQL_GRID}, k AS (SELECT floor, least(58, CAST(trunc(y / 0.5) AS INTEGER)) AS row, least(35, CAST(trunc(x / 0.5) AS INTEGER)) AS col, count(*) AS n FROM c GROUP BY ALL) SELECT g.floor, g.row, g.col, walkable, coalesce(n, 0) AS n_particles FROM grid g LEFT JOIN k USING (floor, row, col)")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = space.in_cells(_cloud(spark, sf_dir), _cells(spark)).groupBy("floor", "row", "col").agg(F.count(F.lit(1)).alias("n_particles"))
    return _cells(spark).join(n, ["floor", "row", "col"], "left").fillna(0, ["n_particles"]).select("floor", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "walkable", "n_particles").withColumn("floor", F.col("floor").cast("long"))


@query(f"WITH {C}, {space.SQL_GRID}, k AS (SELECT c.floor, avg(CASE WHEN walkable THEN 1 ELSE 0 END) AS occupied FROM c JOIN grid g ON g.floor = c.floor AND g.row = least(58, CAST(trunc(y / 0.5) AS INTEGER)) AND g.col = least(35, CAST(trunc(x / 0.5) AS INTEGER)) GROUP BY 1) SELECT CAST(g.floor AS INTEGER) AS floor, round(avg(CASE WHEN walkable THEN 1 ELSE 0 END), 6) AS fraction, round(any_value(occupied), 6) AS occupied FROM grid g JOIN k USING (floor) GROUP BY 1")
def walkable_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark)
    k = space.in_cells(_cloud(spark, sf_dir), cells).join(F.broadcast(cells), ["floor", "row", "col"]).groupBy("floor").agg(F.avg(F.col("walkable").cast("int")).alias("occupied"))
    return rounded(space.walkable_fraction(cells).join(k, "floor"), 6, "fraction", "occupied")


@query(f"WITH {C}, {space.SQL_GRID} SELECT pid, CAST(pid % 5 + 1 AS INTEGER) AS floor, coalesce(g.walkable, false) AS walkable FROM c LEFT JOIN grid g ON g.floor = pid % 5 + 1 AND g.row = least(58, CAST(trunc(y / 0.5) AS INTEGER)) AND g.col = least(35, CAST(trunc(x / 0.5) AS INTEGER))")
def walkable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles on five floors, of which the plan has three."""
    points = _cloud(spark, sf_dir).withColumn("floor", (F.col("pid") % 5 + 1).cast("int"))
    return space.walkable_at(points, _cells(spark)).select("pid", "floor", "walkable")


@query(f"WITH {C}, {space.SQL_ROOM}, m AS (SELECT zone, arg_max(room, (floor, room_pos)) AS room FROM (SELECT g.floor, g.room_pos, q.room, unnest([above, below]) AS zone FROM {V('gates', 'g')} JOIN {V('rooms', 'q')} ON q.floor = g.floor AND q.room_pos = g.room_pos) GROUP BY 1) SELECT lab.zone, coalesce(m.room, lab.zone) AS parent, count(*) AS n FROM lab LEFT JOIN m ON m.zone = lab.zone GROUP BY ALL")
def zone_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles by zone, with the room that a gate's zone lies in."""
    per = space.labelled(_cloud(spark, sf_dir), _plan(spark)).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(layout.gate_rooms(_plan(spark))), "zone", "left").select("zone", F.coalesce("room", "zone").alias("parent"), "n")


@query(f"WITH {R}, {space.SQL_GRID}, {space.SQL_SNAP}, l AS (SELECT anchor_idx, count(*) AS n_readings FROM r GROUP BY 1) SELECT anchor_idx, sx, sy, n_readings FROM snap JOIN l USING (anchor_idx)")
def nearest_walkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = readings.readings(spark, sf_dir).groupBy("anchor_idx").agg(F.count(F.lit(1)).alias("n_readings"))
    return _snapped(spark, _cells(spark)).join(n, F.col("key") == F.col("anchor_idx")).select("anchor_idx", "sx", "sy", "n_readings")


def _snapped(spark: SparkSession, cells: DataFrame) -> DataFrame:
    a = layout.anchors(_plan(spark)).select(F.col("anchor_idx").alias("key"), "floor", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return space.nearest_walkable(a, cells)


CELL = "greatest(0, least({m}, CAST(trunc({v} / 0.5) AS INTEGER)))"
RAYS = f"""ray_in AS (SELECT (c.pid, s.anchor_idx) AS rid, c.floor, {CELL.format(m=58, v="c.y")} AS r0, {CELL.format(m=35, v="c.x")} AS c0, {CELL.format(m=58, v="s.sy")} AS r1, {CELL.format(m=35, v="s.sx")} AS c1 FROM c JOIN snap s ON s.floor = c.floor)"""


@query(f"WITH RECURSIVE {C}, {space.SQL_GRID}, {space.SQL_SNAP}, {RAYS}, {space.SQL_RAYS} SELECT rid[1] AS pid, rid[2] AS anchor_idx, clear, n_walls FROM walked")
def ray_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.in_cells(_cloud(spark, sf_dir), _cells(spark)).join(F.broadcast(_walls(spark)), ["floor", "row", "col"]).select("pid", "anchor_idx", "clear", "n_walls")


@query(f"WITH {C}, d AS (SELECT pid, c.floor, min(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))) AS dist FROM c LEFT JOIN {V('stairs')} ON from_floor = c.floor GROUP BY ALL) SELECT pid, floor, round(dist, 6) AS dist, round(1 + 4 / (1 + (dist / 6) * (dist / 6)), 6) AS boost FROM d")
def stair_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(floors.stair_proximity(_cloud(spark, sf_dir), layout.stairs(_plan(spark))), 6, "dist", "boost")


@query(f"WITH {C}, s AS (SELECT from_floor AS a, to_floor AS b FROM {V('stairs')}), e AS (SELECT DISTINCT * FROM (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)), d AS (SELECT c.floor AS a, min(sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))) AS dist FROM c JOIN {V('stairs')} ON from_floor = c.floor GROUP BY 1), o AS (SELECT e.a, e.b, least(0.01 * 5 * (1 + 4 / (1 + (dist / 6) * (dist / 6))), 0.3) AS p FROM e JOIN d USING (a)) SELECT a AS floor_a, b AS floor_b, round(p, 6) AS p FROM o UNION ALL SELECT a, a, round(greatest(1 - sum(p), 0), 6) FROM o GROUP BY a")
def hmm_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark)
    near = floors.stair_proximity(_cloud(spark, sf_dir), layout.stairs(plan)).groupBy("floor").agg(F.min("dist").alias("dist"))
    return rounded(floors.transition(layout.adjacency(plan), near, 5.0), 6, "p")


ELEVATION = f"""z AS (
  SELECT pid, c.x, c.y, c.floor, coalesce(CASE WHEN c.x <= x_max THEN arg_min(low_z + greatest(0, least(1, (entry_y_low - c.y) / (entry_y_low - entry_y_high))) * (high_z - low_z), run_pos) END, elevation) AS z
  FROM c JOIN {V("floors")} ON floors.floor = c.floor LEFT JOIN {V("staircase")} ON staircase.floor = c.floor
  LEFT JOIN {V("runs")} ON runs.floor = c.floor AND c.y BETWEEN least(entry_y_low, entry_y_high) AND greatest(entry_y_low, entry_y_high) GROUP BY pid, c.x, c.y, c.floor, x_max, elevation
)"""


@query(f"WITH {C}, {ELEVATION} SELECT pid, round(z, 6) AS z FROM z")
def particle_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.elevation(_cloud(spark, sf_dir), _plan(spark)).select("pid", F.round("z", 6).alias("z"))


LATEST = "l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY t DESC, event_id DESC) = 1)"
DRIFT = "dr AS (SELECT beacon, floor, sum(pow(10, (rssi + 100) / 10) * ax) / sum(pow(10, (rssi + 100) / 10)) AS tx, sum(pow(10, (rssi + 100) / 10) * ay) / sum(pow(10, (rssi + 100) / 10)) AS ty FROM l GROUP BY ALL)"


@query(f"WITH {R}, {LATEST}, {DRIFT} SELECT beacon, floor, round(tx, 4) AS tx, round(ty, 4) AS ty FROM dr")
def pf_drift_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(particles.drift_targets(history.latest(readings.readings(spark, sf_dir))), 4, "tx", "ty")


CLOUDS = "cb AS (SELECT c.*, r.beacon FROM c JOIN r ON r.event_id = c.pid)"


def _clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud dealt to the beacons: a particle belongs to the beacon of the reading of its number."""
    of = readings.readings(spark, sf_dir).select(F.col("event_id").alias("pid"), "beacon")
    return _cloud(spark, sf_dir).join(of, "pid")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(readings.readings(spark, sf_dir))


U = readings.sql_noise
G = lambda a, b: f"sqrt(-2 * ln(1 - {U('CAST(pid AS VARCHAR)', chr(39) + a + chr(39))})) * cos(2 * 3.141592653589793 * {U('CAST(pid AS VARCHAR)', chr(39) + b + chr(39))})"
PREDICT = f"""mv AS (
  SELECT c.beacon, pid, c.floor, x, y, {K.MOTION_SIGMA} * sqrt({DT}::DOUBLE) * {G("u1", "u2")} + coalesce({K.DRIFT_RATE * DT} * (d.tx - x), 0) AS mx, {K.MOTION_SIGMA} * sqrt({DT}::DOUBLE) * {G("n1", "n2")} + coalesce({K.DRIFT_RATE * DT} * (d.ty - y), 0) AS my
  FROM cb AS c LEFT JOIN dr d ON d.floor = c.floor AND d.beacon = c.beacon
), tg AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my) > {K.MAX_SPEED_FT_S * DT} THEN {K.MAX_SPEED_FT_S * DT} / sqrt(mx * mx + my * my) ELSE 1 END AS sc FROM mv),
tt AS (SELECT beacon, pid, floor, x, y, x + mx * sc AS tx, y + my * sc AS ty FROM tg),
ray_in AS (SELECT pid AS rid, floor, {CELL.format(m=58, v="y")} AS r0, {CELL.format(m=35, v="x")} AS c0, {CELL.format(m=58, v="ty")} AS r1, {CELL.format(m=35, v="tx")} AS c1 FROM tt)"""


@query(f"""WITH RECURSIVE {R}, {C}, {CLOUDS}, {LATEST}, {DRIFT}, {space.SQL_GRID}, {PREDICT}, {space.SQL_RAYS}
SELECT beacon, pid, round(CASE WHEN ok THEN tx ELSE x END, 4) AS x, round(CASE WHEN ok THEN ty ELSE y END, 4) AS y, ok AS accepted FROM (
  SELECT tt.*, clear AND tx >= 0 AND ty >= 0 AND tx <= 17.7 AND ty <= 29.39 AND g.walkable AS ok FROM tt JOIN walked ON rid = pid
  JOIN grid g ON g.floor = tt.floor AND g.row = {CELL.format(m=58, v="ty")} AND g.col = {CELL.format(m=35, v="tx")})""")
def pf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = particles.drift_targets(_newest(spark, sf_dir))
    out = particles.predicted(_clouds(spark, sf_dir), targets, space.grid_arrays(_cells(spark)), DT)
    return out.select("beacon", "pid", F.round("nx", 4).alias("x"), F.round("ny", 4).alias("y"), "accepted")


WEIGHTS = f"""heard AS (SELECT l.beacon, l.anchor_idx, l.floor AS a_floor, l.ax, l.ay, l.az, l.rssi, sx, sy FROM l JOIN snap USING (anchor_idx)), zb AS (SELECT z.*, beacon FROM z JOIN cb USING (pid)),
ray_in AS (SELECT (z.pid, h.anchor_idx) AS rid, z.floor, {CELL.format(m=58, v="z.y")} AS r0, {CELL.format(m=35, v="z.x")} AS c0, {CELL.format(m=58, v="h.sy")} AS r1, {CELL.format(m=35, v="h.sx")} AS c1 FROM zb z JOIN heard h ON h.a_floor = z.floor AND h.beacon = z.beacon)"""
WEIGHED = f"""ll AS (
  SELECT z.beacon, z.pid, z.x, z.y, z.floor, sum(-0.5 * pow((rssi - ({K.TX_POWER_DBM} - {10 * K.PATH_LOSS_N} * log10(greatest(sqrt((z.x - ax) * (z.x - ax) + (z.y - ay) * (z.y - ay) + (z.z - az) * (z.z - az)), 1) * {K.METRES_PER_FOOT}) - 6 * coalesce(n_walls, 0) - 6 * abs(z.floor - a_floor))) / 5, 2)) AS logw
  FROM zb z JOIN heard h ON h.beacon = z.beacon LEFT JOIN walked k ON k.rid = (z.pid, h.anchor_idx) GROUP BY ALL
), ex AS (SELECT *, exp(logw - max(logw) OVER (PARTITION BY beacon)) AS raw FROM ll), pw AS (SELECT beacon, pid, x, y, floor, raw / sum(raw) OVER (PARTITION BY beacon) AS w FROM ex)"""
WBASE = f"WITH RECURSIVE {R}, {C}, {CLOUDS}, {LATEST}, {space.SQL_GRID}, {space.SQL_SNAP}, {ELEVATION}, {WEIGHTS}, {space.SQL_RAYS}, {WEIGHED}"


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.weights(particles.seen_from(_clouds(spark, sf_dir), _newest(spark, sf_dir), _plan(spark), _cells(spark), _walls(spark)))


@query(f"{WBASE} SELECT beacon, pid, round(w, 9) AS w FROM pw")
def pf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).select("beacon", "pid", F.round("w", 9).alias("w"))


@query(f"{WBASE} SELECT beacon, round(1 / sum(w * w), 3) AS n_eff, count(*) AS n, 1 / sum(w * w) < {K.RESAMPLE_RATIO} * count(*) AS resample FROM pw GROUP BY 1")
def pf_neff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = particles.n_eff(_weighed(spark, sf_dir), "beacon")
    return out.select("beacon", F.round("n_eff", 3).alias("n_eff"), "n", (F.col("n_eff") < K.RESAMPLE_RATIO * F.col("n")).alias("resample"))


P = lambda key, tag: U(key, f"'{tag}'")
GAUSS = lambda key, a, b: f"sqrt(-2 * ln(1 - {P(key, a)})) * cos(2 * 3.141592653589793 * {P(key, b)})"
TRY = "pid || '/' || k"


@query(f"""WITH {R}, {C}, {CLOUDS}, {space.SQL_GRID}, tr AS (SELECT beacon, pid, k, 10 + 3 * {GAUSS(TRY, "u1", "u2")} AS x, 10 + 3 * {GAUSS(TRY, "n1", "n2")} AS y FROM cb, range(0, 2) g(k)),
ok AS (SELECT beacon, pid, arg_min((x, y), k) AS s FROM tr JOIN grid g ON g.floor = 2 AND g.walkable AND g.row = {CELL.format(m=58, v="y")} AND g.col = {CELL.format(m=35, v="x")} WHERE x BETWEEN 0 AND 17.7 AND y BETWEEN 0 AND 29.39 GROUP BY ALL),
al AS (SELECT beacon, pid, s, row_number() OVER (PARTITION BY beacon, s IS NOT NULL ORDER BY pid) - 1 AS i, count(s) OVER (PARTITION BY beacon) AS n FROM cb LEFT JOIN ok USING (beacon, pid))
SELECT a.beacon, a.pid, round(coalesce(a.s, b.s)[1], 4) AS x, round(coalesce(a.s, b.s)[2], 4) AS y, 2 AS floor FROM al a LEFT JOIN al b ON a.s IS NULL AND b.s IS NOT NULL AND b.beacon = a.beacon AND b.i = a.i % nullif(a.n, 0)""")
def pf_init_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws each, so that some particles find no place of their own."""
    return rounded(particles.around(_clouds(spark, sf_dir).select("beacon", "pid"), _cells(spark), 10.0, 10.0, 2, 3.0, 2), 4, "x", "y")


STEP = 2.0
WAYS = f"""bl AS (SELECT beacon, floor, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY beacon) AS p FROM r GROUP BY beacon, floor),
ways AS (SELECT s.*, b.ex AS bx, b.ey AS b2 FROM {V("stairs", "s")} JOIN (SELECT from_floor AS bf, to_floor AS bt, arg_min(ex, stair_pos) AS ex, arg_min(ey, stair_pos) AS ey FROM {V("stairs")} GROUP BY ALL) b ON bf = s.to_floor AND bt = s.from_floor),
cc AS (SELECT *, greatest(greatest({P("CAST(pid AS VARCHAR)", "g")} * 10 - 5, 0) - {STEP}, 0) AS cool FROM cb),
nr AS (SELECT cc.beacon, pid, ways.*, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS d FROM cc JOIN ways ON from_floor = cc.floor WHERE cool = 0),
tk AS (SELECT nr.beacon, pid, arg_min((to_floor, bx, b2), stair_pos) AS w FROM nr LEFT JOIN bl ON bl.beacon = nr.beacon AND bl.floor = nr.to_floor
  WHERE d < {K.STAIR_RADIUS_FT} AND {P("pid || '/' || stair_pos", "r")} < least(coalesce(p, 0) * {K.STAIR_RATE} * {STEP}, 0.4) * greatest(0.1, least(1, 1 - d / {K.STAIR_RADIUS_FT})) GROUP BY ALL)"""


@query(f"WITH {R}, {C}, {CLOUDS}, {WAYS} SELECT cc.beacon, pid, round(coalesce(w[2], x), 4) AS x, round(coalesce(w[3], y), 4) AS y, coalesce(w[1], floor) AS floor, round(CASE WHEN w IS NULL THEN cool ELSE {K.STAIR_COOLDOWN_S} END, 6) AS cooldown, w IS NOT NULL AS moved FROM cc LEFT JOIN tk USING (beacon, pid)")
def pf_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of two seconds; the belief in a floor is its share of the beacon's readings."""
    per = readings.readings(spark, sf_dir).groupBy("beacon", "floor").agg(F.count(F.lit(1)).alias("n"))
    belief = per.select("beacon", "floor", (F.col("n") / F.sum("n").over(W.partitionBy("beacon"))).alias("p"))
    cloud = _clouds(spark, sf_dir).withColumn("cooldown", F.greatest(noise("pid", "g") * 10 - 5, F.lit(0.0)))
    return rounded(rounded(particles.changed_floor(cloud, belief, _plan(spark), STEP), 4, "x", "y"), 6, "cooldown")


POWER = "pow(10, (rssi + 100) / 10)"
TELEPORT = f"""sw AS (SELECT *, 0.5 + {P("CAST(pid AS VARCHAR)", "w")} AS v FROM cb), sn AS (SELECT beacon, pid, x, y, floor, v / sum(v) OVER (PARTITION BY beacon) AS w, row_number() OVER (PARTITION BY beacon ORDER BY v, pid) AS i FROM sw),
be AS (SELECT beacon, arg_max(floor, (p, -floor)) AS best, max(p) AS p FROM (SELECT beacon, floor, sum({POWER}) / sum(sum({POWER})) OVER (PARTITION BY beacon) AS p FROM l GROUP BY beacon, floor) GROUP BY 1),
mo AS (SELECT beacon, arg_max(floor, (k, -floor)) AS most, CAST(sum(k) AS BIGINT) AS n FROM (SELECT beacon, floor, count(*) AS k FROM cb GROUP BY ALL) GROUP BY 1),
st AS (SELECT from_floor AS a, to_floor AS b FROM {V("stairs")}), ad AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
du AS (SELECT beacon, best, n, greatest(1, CAST(floor(n * {K.TELEPORT_SHARE}::DOUBLE) AS BIGINT)) AS k FROM mo JOIN be USING (beacon) JOIN ad ON a = most AND b = best WHERE p >= {K.TELEPORT_BELIEF} AND {P("CAST(beacon AS VARCHAR)", "q")} * 4 >= {K.TELEPORT_HOLD_S}),
cl AS (SELECT floor, row, col, row_number() OVER (PARTITION BY floor ORDER BY row, col) - 1 AS j, count(*) OVER (PARTITION BY floor) AS nc FROM grid WHERE walkable), pk AS (
  SELECT sn.*, du.best, du.n, du.k, coalesce(i <= k, false) AS moved, {P("sn.beacon || '/' || pid", "r")} AS u FROM sn LEFT JOIN du USING (beacon))"""


@query(f"WITH {R}, {C}, {CLOUDS}, {LATEST}, {space.SQL_GRID}, {TELEPORT} SELECT beacon, pid, round(CASE WHEN moved THEN (col + 0.5) * 0.5 ELSE x END, 4) AS x, round(CASE WHEN moved THEN (row + 0.5) * 0.5 ELSE y END, 4) AS y, CASE WHEN moved THEN best ELSE pk.floor END AS floor, round(CASE WHEN n IS NULL THEN w ELSE 1 / n END, 9) AS w, moved FROM pk LEFT JOIN cl ON moved AND cl.floor = best AND j = CAST(floor(u * nc) AS BIGINT)")
def pf_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The belief in a floor is its share of the newest readings' power; the disagreement has lasted up to four seconds."""
    own = W.partitionBy("beacon")
    heard = _newest(spark, sf_dir).groupBy("beacon", "floor").agg(F.sum(power("rssi")).alias("s"))
    belief = heard.select("beacon", "floor", (F.col("s") / F.sum("s").over(own)).alias("p"))
    held = belief.select("beacon").distinct().withColumn("seconds", noise("beacon", "q") * 4)
    cloud = _clouds(spark, sf_dir).withColumn("v", 0.5 + noise("pid", "w")).withColumn("w", F.col("v") / F.sum("v").over(own)).drop("v")
    return rounded(rounded(particles.teleported(cloud, belief, held, layout.adjacency(_plan(spark)), _cells(spark)), 4, "x", "y"), 9, "w")


#: A smooth cloud for resampling: weights from hashes, so that no cumulative sum falls on a slot's edge.
SMOOTH = f"sw AS (SELECT pid, x, y, floor, (0.5 + {U('CAST(pid AS VARCHAR)', chr(39) + 'w' + chr(39))}) AS v FROM c), sn AS (SELECT *, v / sum(v) OVER () AS w FROM sw)"


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cloud(spark, sf_dir).withColumn("v", 0.5 + noise("pid", "w"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("v").alias("total")))).withColumn("w", F.col("v") / F.col("total")).drop("v", "total")


@query(f"WITH {C}, {SMOOTH}, q AS (SELECT pid, w, sum(w) OVER (ORDER BY pid) AS cum, max(pid) OVER () AS last FROM sn), s AS (SELECT CAST(i AS BIGINT) AS slot, (i + 0.5) / 500 AS p FROM range(0, 500) g(i)) SELECT slot, min(pid) AS pid FROM s JOIN q ON p <= cum + 1e-12 GROUP BY 1")
def pf_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.resampled(_smooth(spark, sf_dir), K.PARTICLES, 0.5)


ESTIMATED = f"WITH {C}, {SMOOTH}, f AS (SELECT floor, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sqrt(greatest(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 0) + greatest(sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2), 0)) AS sp, sum(w * w) AS w2 FROM sn GROUP BY 1)"


@query(f"{ESTIMATED} SELECT round(arg_max(mx, (s, -floor)), 4) AS x, round(arg_max(my, (s, -floor)), 4) AS y, arg_max(floor, (s, -floor)) AS floor, round(arg_max(s * exp(-sp / 5), (s, -floor)), 3) AS confidence, round(1 / sum(w2), 1) AS n_eff, round(2.5 * (1 - confidence) + 0.4, 4) AS radius FROM f")
def pf_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(particles.estimate(_smooth(spark, sf_dir)), 4, "x", "y").withColumn("radius", F.round(confidence_radius("confidence"), 4))


@query(f"{ESTIMATED}, e AS (SELECT round(arg_max(mx, (s, -floor)), 4) AS ex, round(arg_max(my, (s, -floor)), 4) AS ey, arg_max(floor, (s, -floor)) AS ef FROM f) SELECT pid, round(x, 4) AS x, round(y, 4) AS y, floor, round(w, 9) AS weight, count(*) OVER () AS n_particles, ex AS estimate_x, ey AS estimate_y, ef AS estimate_floor FROM sn, e")
def pf_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with its estimate, as the service shows it."""
    cloud = _smooth(spark, sf_dir)
    e = particles.estimate(cloud).select(F.col("x").alias("estimate_x"), F.col("y").alias("estimate_y"), F.col("floor").alias("estimate_floor"))
    n = cloud.agg(F.count(F.lit(1)).alias("n_particles"))
    rows = cloud.select("pid", "x", "y", "floor", F.round("w", 9).alias("weight")).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(e))
    return rounded(rows, 4, "x", "y", "estimate_x", "estimate_y")


ZONE_P = "(VALUES ('living_kitchen_dog_bed', 0.2::DOUBLE), ('living_kitchen_sofa', 0.5::DOUBLE), ('living_kitchen_table', 0.1::DOUBLE)) AS zp(zone, p)"


ZONED = f"""WITH {C}, {SMOOTH}, zz AS (SELECT floor AS zf, zone_pos, zone, px, py, radius, p FROM {V("pois")} JOIN {ZONE_P} USING (zone) WHERE room = 'living_kitchen' AND p > 0),
hz AS (SELECT pid, sn.floor, w, arg_min((zone, p), zone_pos) AS z FROM sn LEFT JOIN zz ON sn.floor = zf AND sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= radius GROUP BY ALL),
fz AS (SELECT pid, z, w, w * CASE WHEN z IS NOT NULL THEN pow(greatest(z[2], 0.01), {K.ZONE_LIKELIHOOD_STRENGTH}) WHEN floor IN (SELECT zf FROM zz) THEN pow(0.2, {K.ZONE_LIKELIHOOD_STRENGTH}) ELSE 1 END AS v FROM hz)"""


@query(f"""{ZONED} SELECT pid, coalesce(z[1], '') AS zone, round(CASE WHEN count(z) OVER () > 0 THEN v / sum(v) OVER () ELSE w END, 9) AS w FROM fz""")
def pf_zone_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_zone_weights(spark, _smooth(spark, sf_dir)), 9, "w")


def _zone_weights(spark: SparkSession, cloud: DataFrame) -> DataFrame:
    p = spark.createDataFrame([("living_kitchen_dog_bed", 0.2), ("living_kitchen_sofa", 0.5), ("living_kitchen_table", 0.1)], "zone string, p double")
    return particles.zone_reweighted(cloud, layout.pois(_plan(spark)), p, "living_kitchen", 0.2)


@query(f"{ZONED} SELECT count(z) AS particles_in_poi, count(z) AS particles_reweighted, CASE WHEN count(z) = 0 THEN 1 ELSE round(max(v / w) / greatest(min(v / w), 1e-12), 2) END AS max_weight_shift FROM fz")
def pf_zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = _smooth(spark, sf_dir)
    return particles.zone_shift(cloud, _zone_weights(spark, cloud))


@query(f"WITH {C}, b AS (SELECT pid, CAST(trunc(x / 2) AS INTEGER) AS bx, CAST(trunc(y / 2) AS INTEGER) AS b2 FROM c), k AS (SELECT bx, b2, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT a.bx, a.b2, sum(k.n) AS near FROM (SELECT DISTINCT bx, b2 FROM b) a JOIN k ON abs(k.bx - a.bx) <= 1 AND abs(k.b2 - a.b2) <= 1 GROUP BY ALL) SELECT pid, round(CASE WHEN max(near) OVER () > min(near) OVER () THEN (near - min(near) OVER ()) * 1.0 / (max(near) OVER () - min(near) OVER ()) ELSE 0.5 END, 6) AS density FROM b JOIN s USING (bx, b2)")
def particle_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.density(_cloud(spark, sf_dir)), 6, "density")


def pf_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live cycle over the whole table: cannot be expressed in SQL; tested by its invariants."""
    rows = cycle.trajectories(readings.readings(spark, sf_dir), _plan(spark), _cells(spark), walls=_walls(spark))
    return rounded(rows, 4, "x", "y")


QUERIES["pf_trajectory"] = pf_trajectory


@query(f"""WITH {R}, {space.SQL_GRID}, g AS (SELECT f AS floor, 1.5 + i * 3.0 AS x, 1.5 + j * 3.0 AS y, 'grid' AS kind, 0 AS rk FROM range(1, 4) a(f), range(0, 6) b(i), range(0, 10) d(j) WHERE 1.5 + i * 3.0 <= 17.7 AND 1.5 + j * 3.0 <= 29.39),
k AS (SELECT * FROM g UNION ALL SELECT floor, cx, cy, 'doorway', 1 FROM {V("openings")} UNION ALL SELECT from_floor, ex, ey, 'stairs', 2 FROM {V("stairs")} UNION ALL SELECT floor, px, py, 'poi', 3 FROM {V("pois")}),
o AS (SELECT k.* FROM k JOIN grid q ON q.floor = k.floor AND q.row = {CELL.format(m=58, v="k.y")} AND q.col = {CELL.format(m=35, v="k.x")} AND q.walkable WHERE k.x BETWEEN 0 AND 17.7 AND k.y BETWEEN 0 AND 29.39 QUALIFY row_number() OVER (PARTITION BY k.floor, round(k.x), round(k.y) ORDER BY rk, k.x, k.y) = 1),
c AS (SELECT CAST(row_number() OVER (ORDER BY floor, x, y) AS BIGINT) AS pid, CAST(floor AS INTEGER) AS floor, x, y, kind FROM o), {space.SQL_ROOM}, {COUNTS}
SELECT row_number() OVER (PARTITION BY c.floor ORDER BY floor(c.x / 3), CASE WHEN CAST(floor(c.x / 3) AS INTEGER) % 2 = 1 THEN -c.y ELSE c.y END, c.x) AS seq, c.floor, round(c.x, 4) AS x, round(c.y, 4) AS y, room, zone, kind, n AS n_readings FROM c JOIN lab USING (pid) JOIN nf ON nf.floor = c.floor""")
def survey_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey.survey_points(_plan(spark), _cells(spark)).withColumn("seq", F.col("seq").cast("long"))
    return rounded(_by_events(rows, spark, sf_dir), 4, "x", "y")


@query(f"WITH {R}, {COUNTS}, s AS (SELECT from_floor AS a, to_floor AS b FROM {V('stairs')}), e AS (SELECT DISTINCT * FROM (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)), m AS (SELECT a, b, {1 - K.HMM_SELF}::DOUBLE / count(*) OVER (PARTITION BY a) AS p FROM e UNION ALL SELECT DISTINCT a, a, {K.HMM_SELF}::DOUBLE FROM e) SELECT a AS floor_a, b AS floor_b, round(p, 6) AS p, coalesce(n, 0) AS n_readings FROM m LEFT JOIN nf ON nf.floor = a")
def hmm_base_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = floors.base_matrix(layout.adjacency(_plan(spark))).withColumnRenamed("floor_a", "floor")
    return rounded(_by_events(rows, spark, sf_dir).withColumnRenamed("floor", "floor_a"), 6, "p")


@query(f"WITH {C}, {space.SQL_ROOM}, q AS (SELECT floor, count(*) AS n, count(*) FILTER (zone <> room) AS gated FROM lab GROUP BY 1) SELECT floor, n, gated, round(((n - gated) * {K.SURVEY_DWELL_S + 15} + gated * 25) / 60, 4) AS minutes FROM q")
def survey_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to survey every particle's place, gated zones at the shorter dwell of points of interest."""
    rows = space.labelled(_cloud(spark, sf_dir), _plan(spark)).withColumn("kind", F.when(F.col("zone") != F.col("room"), "poi").otherwise("grid"))
    gated = rows.groupBy("floor").agg(F.count_if(F.col("kind") == "poi").alias("gated"))
    return rounded(survey.minutes(rows).join(gated, "floor"), 4, "minutes")
