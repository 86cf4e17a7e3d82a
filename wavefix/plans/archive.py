"""Registered queries over position history, survey samples, calibration and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import noise
from wavefix.operators import floors, history, prefix, space, survey, zones
from wavefix.operators.space import SQL_ROOM
from wavefix.plans import spatial
from wavefix.plans.signals import C, EMISSIONS, H, ORACLES, QUERIES, R, query, rounded
from wavefix.plans.signals import _anchors, _vec
from wavefix.sources import layout, readings

__all__ = ["ORACLES", "QUERIES"]

U = readings.sql_noise


def _h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.positions(spark, sf_dir)


@query(f"WITH {H} SELECT event_id AS id, round(t, 6) AS t, floor, label FROM h ORDER BY h.t DESC, event_id DESC LIMIT 100")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page(_h(spark, sf_dir), 100).select(F.col("event_id").alias("id"), F.round("t", 6).alias("t"), "floor", "label")


@query(f"WITH {H} SELECT beacon, arg_max(event_id, (t, event_id)) AS id, round(max(t), 6) AS t, round(arg_max(x, (t, event_id)), 6) AS x, round(arg_max(y, (t, event_id)), 6) AS y, arg_max(floor, (t, event_id)) AS floor FROM h GROUP BY 1")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.max_by(F.struct("event_id", "t", "x", "y", "floor"), F.struct("t", "event_id")).alias("s")
    return rounded(_h(spark, sf_dir).groupBy("beacon").agg(s).select("beacon", F.col("s.event_id").alias("id"), "s.t", "s.x", "s.y", "s.floor"), 6, "t", "x", "y")


@query(f"WITH {H} SELECT beacon, floor, count(*) AS n FROM h GROUP BY ALL")
def position_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _h(spark, sf_dir).groupBy("beacon", "floor").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM h GROUP BY 1")
def dwell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.dwell_rows(_h(spark, sf_dir)), 6, "fraction")


@query(f"WITH {H}, d AS (SELECT label, coalesce(lead(t) OVER (PARTITION BY beacon ORDER BY t, event_id) - t, 0) AS s FROM h) SELECT label, round(sum(s), 4) AS seconds, round(sum(s) / sum(sum(s)) OVER (), 6) AS fraction FROM d GROUP BY 1")
def dwell_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(history.dwell_time(_h(spark, sf_dir)), 4, "seconds"), 6, "fraction")


@query(f"WITH {H} SELECT coalesce(activity, 'unknown') AS activity, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM h GROUP BY 1")
def activity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.activity_breakdown(_h(spark, sf_dir)), 6, "pct")


TIMELINE = """f1 AS (SELECT *, min(t) OVER (PARTITION BY beacon) AS t0, CASE WHEN floor = lag(floor) OVER (PARTITION BY beacon ORDER BY t, event_id) THEN 0 ELSE 1 END AS new FROM h),
f2 AS (SELECT *, sum(new) OVER (PARTITION BY beacon ORDER BY t, event_id) AS seg FROM f1), f3 AS (SELECT beacon, CAST(seg AS BIGINT) AS seg, min(floor) AS floor, min(t) AS a, max(t) AS z, count(*) AS n, min(t0) AS t0 FROM f2 GROUP BY ALL),
f4 AS (SELECT *, lead(a) OVER (PARTITION BY beacon ORDER BY seg) AS after FROM f3)"""


@query(f"WITH {H}, {TIMELINE} SELECT beacon, seg, floor, round((a - t0) / 60, 6) AS start_min, round((coalesce(after, z) - t0) / 60, 6) AS end_min FROM f4 WHERE after IS NOT NULL OR n > 1")
def floor_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.floor_timeline(_h(spark, sf_dir)), 6, "start_min", "end_min")


@query(f"WITH {H} SELECT beacon, event_id, was AS from_floor, floor AS to_floor FROM (SELECT *, lag(floor) OVER (PARTITION BY beacon ORDER BY t, event_id) AS was FROM h) WHERE was <> floor")
def floor_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.lag("floor").over(W.partitionBy("beacon").orderBy("t", "event_id"))
    return _h(spark, sf_dir).withColumn("from_floor", was).where("from_floor <> floor").select("beacon", "event_id", "from_floor", F.col("floor").alias("to_floor"))


@query(f"""WITH {H}, k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY beacon ORDER BY t DESC, event_id DESC) <= 60), i AS (SELECT *, row_number() OVER (PARTITION BY beacon ORDER BY t, event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY beacon) // 5) AS step FROM k)
SELECT beacon, CAST(seg AS INTEGER) AS seg, count(*) AS n, round(arg_min(x, i), 6) AS x0, round(arg_min(y, i), 6) AS y0, round(arg_max(x, i), 6) AS x1, round(arg_max(y, i), 6) AS y1 FROM i, range(0, 5) g(seg) WHERE i BETWEEN seg * step AND seg * step + step GROUP BY ALL HAVING count(*) > 1""")
def trail_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.trail(_h(spark, sf_dir)), 6, "x0", "y0", "x1", "y1")


@query(f"WITH {H} SELECT floor, CAST(floor(x / 2) AS BIGINT) AS bx, CAST(floor(y / 2) AS BIGINT) AS b2, count(*) AS n FROM h GROUP BY ALL")
def position_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.heatmap(_h(spark, sf_dir)).withColumnRenamed("by", "b2")


#: Zone probabilities of a sample: three zones of its floor, from hashes.
ZONES = ("living_room", "kitchen", "office", "master_bed", "hallway", "bathroom", "guest")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.explode(F.array(*map(F.lit, ZONES))).alias("zone")
    out = _h(spark, sf_dir).select(F.col("event_id").alias("sample_id"), z).withColumn("p", noise(F.concat_ws("/", "sample_id", "zone"), "z"))
    return out.where("p > 0.4")


ZP = f"zp AS (SELECT event_id AS sample_id, zone, {U('event_id || chr(47) || zone', chr(39) + 'z' + chr(39))} AS p FROM h, (VALUES {', '.join(f'({z!r})' for z in ZONES)}) AS v(zone) WHERE p > 0.4)"


@query(f"WITH {H}, {ZP} SELECT zone, round(sum(p) / (SELECT count(*) FROM h), 6) AS mean_p FROM zp GROUP BY 1 ORDER BY round(sum(p) / (SELECT count(*) FROM h), 9) DESC, zone LIMIT 6")
def zone_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.zone_means(_probabilities(spark, sf_dir), _h(spark, sf_dir)), 6, "mean_p")


@query(f"{EMISSIONS}, {H}, bf AS (SELECT event_id, CASE WHEN round(w1 / s, 9) >= round(w2 / s, 9) AND round(w1 / s, 9) >= round(w3 / s, 9) THEN 1 WHEN round(w2 / s, 9) >= round(w3 / s, 9) THEN 2 ELSE 3 END AS f FROM es) SELECT h.floor AS pf_floor, count(*) AS n, count(*) FILTER (bf.f = h.floor) AS agree FROM bf JOIN h USING (event_id) GROUP BY 1")
def floor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = floors.names(readings.plan(spark))
    e = floors.emissions(_vec(spark, sf_dir)[1], _anchors(spark), known)
    likely = e.select("event_id", floors.likeliest("e", known).alias("floor"))
    return history.floor_agreement(likely, _h(spark, sf_dir)).groupBy("pf_floor").agg(F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("agree"))


# --- survey and calibration -------------------------------------------------------

#: A survey point is a run of forty events; its readings are those of the events.
SAMPLES = "sa AS (SELECT event_id // 40 AS point_id, anchor_idx, floor, rssi FROM r)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.readings(spark, sf_dir).select(F.floor(F.col("event_id") / 40).alias("point_id"), "anchor_idx", "floor", "rssi")


@query(f"WITH {R}, {SAMPLES}, g AS (SELECT point_id, anchor_idx, CASE WHEN count(*) < 2 THEN round(avg(rssi) + 1e-9, 1) ELSE round(avg(rssi) + 1e-9, 2) END AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_samp(rssi) + 1e-9, 2) END AS std, count(*) AS n FROM sa GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY point_id) AS anchor_count, CAST(trunc(avg(n) OVER (PARTITION BY point_id)) AS INTEGER) AS n_readings, std > 8 AS high_var, count(*) OVER (PARTITION BY point_id) < 3 AS rejected FROM g")
def survey_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.aggregated(_samples(spark, sf_dir))


@query(f"WITH {R}, {SAMPLES}, p AS (SELECT DISTINCT point_id FROM sa) SELECT point_id FROM p WHERE point_id NOT IN (SELECT point_id FROM sa WHERE rssi > -30.2)")
def remaining_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    return survey.remaining(s.select("point_id").distinct(), s.where("rssi > -30.2").select("point_id").distinct())


@query(f"WITH {C}, {spatial.space.SQL_ROOM} SELECT floor, room, zone, count(*) AS n FROM lab GROUP BY GROUPING SETS ((floor), (room), (zone))")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.label_distribution(spatial.space.labelled(readings.particles(spark, sf_dir), readings.plan(spark)))


#: Calibration points: each supplier at a hashed distance, with the strength the model expects and noise.
CALIBRATION = f"cal AS (SELECT s_suppkey AS k, 1 + {U('CAST(s_suppkey AS VARCHAR)', chr(39) + 'd1' + chr(39))} * 40 AS d, {U('CAST(s_suppkey AS VARCHAR)', chr(39) + 'd2' + chr(39))} AS u, s_suppkey % 4 AS walls, round(-60 - 25 * log10(d * 0.3048) - 6.4 * walls + (u - 0.5) * 6, 3) AS rssi FROM supplier)"


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (1 + noise("s_suppkey", "d1") * 40).alias("distance_ft"), noise("s_suppkey", "d2").alias("u"), (F.col("s_suppkey") % 4).alias("n_walls"))
    return s.withColumn("rssi", F.round(-60 - 25 * F.log10(F.col("distance_ft") * 0.3048) - 6.4 * F.col("n_walls") + (F.col("u") - 0.5) * 6, 3))


@query(f"WITH {CALIBRATION}, f AS (SELECT regr_intercept(rssi, log10(d * 0.3048)) AS a, regr_slope(rssi, log10(d * 0.3048)) AS b, count(*) AS n FROM cal WHERE walls = 0) SELECT round(any_value(a), 1) AS tx_power, round(-any_value(b) / 10, 2) AS path_loss_n, round(sqrt(avg(pow(rssi - a - b * log10(d * 0.3048), 2))), 2) AS rmse, any_value(f.n) AS n FROM cal, f WHERE walls = 0")
def path_loss_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.path_loss(_calibration(spark, sf_dir).where("n_walls = 0"))


FIT = "regr_intercept(rssi, log10(d * 0.3048)) AS a, regr_slope(rssi, log10(d * 0.3048)) AS b"


@query(f"WITH {CALIBRATION}, f AS (SELECT {FIT} FROM cal WHERE walls = 0) SELECT k AS key, round(rssi - a - b * log10(d * 0.3048), 2) AS residual FROM cal, f WHERE walls = 0")
def path_loss_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.residuals(_calibration(spark, sf_dir).where("n_walls = 0").withColumnRenamed("s_suppkey", "key"))


@query(f"WITH {CALIBRATION}, x AS (SELECT *, k % 3 AS file FROM cal), f AS (SELECT file, {FIT}, count(*) AS n FROM x GROUP BY GROUPING SETS ((), (file))), e AS (SELECT f.file, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, sqrt(avg(pow(rssi - a - b * log10(d * 0.3048), 2))) AS e FROM f JOIN x ON f.file IS NULL OR f.file = x.file GROUP BY f.file) SELECT file, round(a, 1) AS tx_power, round(-b / 10, 2) AS path_loss_n, round(e, 2) AS rmse, n FROM e")
def path_loss_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration as three files: fitted together and one by one."""
    return survey.file_fits(_calibration(spark, sf_dir).withColumn("file", F.col("s_suppkey") % 3))


#: A log of the survey: each event is an entry for its point, the last ten of forty in the occluded pass; some are redone.
LOG = f"lg AS (SELECT event_id // 40 AS point_id, CASE WHEN event_id % 40 >= 30 THEN 'occluded' ELSE 'normal' END AS pass, t, event_id AS seq, {U('CAST(event_id AS VARCHAR)', chr(39) + 'd1' + chr(39))} > 0.4 AS done FROM r)"


@query(f"WITH {R}, {LOG}, pt AS (SELECT DISTINCT point_id, CASE WHEN point_id % 3 = 0 THEN 'poi' ELSE 'grid' END AS kind FROM lg), due AS (SELECT point_id, kind, unnest(CASE WHEN kind = 'poi' THEN ['normal', 'occluded'] ELSE ['normal'] END) AS pass FROM pt), nw AS (SELECT point_id, pass, arg_max(done, (t, seq)) AS done FROM lg GROUP BY ALL) SELECT due.point_id, kind, due.pass FROM due LEFT JOIN nw ON nw.point_id = due.point_id AND nw.pass = due.pass WHERE NOT coalesce(done, false)")
def survey_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (forty events each, every third a point of interest) that are due in a pass: never done, or to be redone."""
    which = F.when(F.col("event_id") % 40 >= 30, survey.OCCLUDED).otherwise(survey.NORMAL)
    log = readings.readings(spark, sf_dir).select(F.floor(F.col("event_id") / 40).alias("point_id"), which.alias("pass"), "t", F.col("event_id").alias("seq"), (noise("event_id", "d1") > 0.4).alias("done"))
    points = log.select("point_id").distinct().withColumn("kind", F.when(F.col("point_id") % 3 == 0, "poi").otherwise("grid"))
    return survey.resumed(points, log).select("point_id", "kind", "pass")


@query(f"WITH {CALIBRATION} SELECT round(avg(db), 1) AS db, round(stddev_pop(db), 1) AS std, count(*) AS n FROM (SELECT ({K.TX_POWER_DBM} - {10 * K.PATH_LOSS_N} * log10(greatest(greatest(d * 0.3048, 0.3) / 0.3048, 1) * 0.3048) - rssi) / walls AS db FROM cal WHERE walls > 0)")
def wall_attenuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.wall_attenuation(_calibration(spark, sf_dir))


@query(f"WITH {CALIBRATION} SELECT CAST(floor(d / 10) * 10 AS BIGINT) AS distance_ft, round(avg(rssi), 4) AS mean, round(stddev_pop(rssi), 4) AS std, count(*) AS n FROM cal GROUP BY 1")
def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calibration(spark, sf_dir).withColumn("distance_ft", (F.floor(F.col("distance_ft") / 10) * 10).cast("long"))
    return rounded(survey.calibration_stats(rows), 4, "mean", "std")


@query(f"WITH {C}, {spatial.space.SQL_ROOM}, j AS (SELECT pid, lab.zone AS label, p.zone AS z, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d, radius, zone_pos FROM lab LEFT JOIN {layout.values('pois', 'p')} ON p.floor = lab.floor AND p.room = lab.room) SELECT pid AS sample_id, coalesce(arg_min(z, (round(d, 9), zone_pos)) FILTER (d <= radius), label) AS zone FROM j GROUP BY pid, label")
def poi_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.space.labelled(readings.particles(spark, sf_dir), readings.plan(spark))
    return survey.poi_relabelled(rows.select(F.col("pid").alias("sample_id"), "floor", "room", "x", "y", F.col("zone").alias("label")), layout.pois(readings.plan(spark)))


@query(ORACLES["poi_relabel"].split(" SELECT pid AS sample_id, ")[0] + ", rl AS (SELECT pid, coalesce(arg_min(z, (round(d, 9), zone_pos)) FILTER (d <= radius), label) AS zone, label FROM j GROUP BY pid, label) SELECT label, count(*) FILTER (zone <> label) AS relabelled, count(*) AS n FROM rl GROUP BY 1")
def poi_relabel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.space.labelled(readings.particles(spark, sf_dir), readings.plan(spark)).select(F.col("pid").alias("sample_id"), F.col("zone").alias("label"))
    return survey.relabelled(rows, poi_relabel(spark, sf_dir))


# --- the zone classifier ------------------------------------------------------------

#: A fingerprint is a run of forty events: its strengths by anchor, and the label of its first event.
PRINTS = "fp AS (SELECT event_id // 40 AS sample_id, anchor_idx, avg(rssi) AS rssi FROM r GROUP BY ALL)"


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy(F.col("point_id").alias("sample_id"), "anchor_idx").agg(F.avg("rssi").alias("rssi"))


def _names(spark: SparkSession) -> tuple[list[str], DataFrame]:
    names = survey.feature_names([f"a{i}" for i in range(9)])
    default = lambda n: K.MISSING_RSSI if n.startswith("rssi_a") or n.startswith("rssi_mean") else 0.0
    return names, spark.createDataFrame([(i, n, default(n)) for i, n in enumerate(names)], "idx int, name string, default double")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _prints(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc(F.round("rssi", 9)), "anchor_idx"))
    long = prints.withColumn("rank", rank.cast("double"))
    wide = long.select("sample_id", F.concat(F.lit("RSSI_A"), "anchor_idx").alias("name"), F.col("rssi").alias("value")).union(long.select("sample_id", F.concat(F.lit("rank_a"), "anchor_idx"), "rank"))
    wide = wide.union(prints.groupBy("sample_id").agg(F.lit("n_anchors_reporting").alias("name"), F.count(F.lit(1)).cast("double").alias("value")))
    return survey.feature_vector(prints.select("sample_id").distinct(), wide, _names(spark)[1])


_N = [*survey.feature_names([f"a{i}" for i in range(9)])]


@query(f"""WITH {R}, {PRINTS}, nm(idx, name, d) AS (VALUES {', '.join(f"({i}, '{n}', {-100.0 if n.startswith(('rssi_a', 'rssi_mean')) else 0.0}::DOUBLE)" for i, n in enumerate(_N))}),
v AS (SELECT sample_id, 'rssi_a' || anchor_idx AS name, rssi AS value FROM fp UNION ALL SELECT sample_id, 'rank_a' || anchor_idx, row_number() OVER (PARTITION BY sample_id ORDER BY round(rssi, 9) DESC, anchor_idx) FROM fp UNION ALL SELECT sample_id, 'n_anchors_reporting', count(*) FROM fp GROUP BY 1)
SELECT s.sample_id, idx, round(coalesce(value, d), 6) AS value FROM (SELECT DISTINCT sample_id FROM fp) s CROSS JOIN nm LEFT JOIN v ON v.sample_id = s.sample_id AND v.name = nm.name""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vectors(spark, sf_dir), 6, "value")


ROOM_OF = "(VALUES ('living_room', 'a'), ('kitchen', 'a'), ('office', 'b'), ('master_bed', 'b'), ('hallway', 'c'), ('bathroom', 'c'), ('guest', 'c')) AS zr(zone, room)"


@query(f"WITH {H}, {ZP}, s AS (SELECT zp.sample_id, zp.zone, p FROM zp JOIN {ROOM_OF} USING (zone) WHERE room = chr(CAST(97 + sample_id % 3 AS INTEGER))) SELECT sample_id, zone, round(p / sum(p) OVER (PARTITION BY sample_id), 4) AS p FROM s")
def zone_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = spark.createDataFrame([("living_room", "a"), ("kitchen", "a"), ("office", "b"), ("master_bed", "b"), ("hallway", "c"), ("bathroom", "c"), ("guest", "c")], "zone string, room string")
    mine = _h(spark, sf_dir).select(F.col("event_id").alias("sample_id"), F.char((97 + F.col("event_id") % 3).cast("int")).alias("room"))
    return survey.scoped(_probabilities(spark, sf_dir), rooms, mine)


SCOPED = f"sc AS (SELECT zp.sample_id, zp.zone, p FROM zp JOIN {ROOM_OF} USING (zone) WHERE room = chr(CAST(97 + sample_id % 3 AS INTEGER)) AND sample_id % 5 > 0), sp AS (SELECT sample_id, zone, round(p / sum(p) OVER (PARTITION BY sample_id), 4) AS p FROM sc), bz AS (SELECT event_id, arg_min(zone, (-p, zone)) AS zone, coalesce(max(p), 0) AS confidence FROM h LEFT JOIN sp ON sample_id = event_id GROUP BY 1)"


def _best_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's answer for each position; it has none for a fifth of them."""
    zones_ = spark.createDataFrame([("living_room", "a"), ("kitchen", "a"), ("office", "b"), ("master_bed", "b"), ("hallway", "c"), ("bathroom", "c"), ("guest", "c")], "zone string, room string")
    mine = _h(spark, sf_dir).select(F.col("event_id").alias("sample_id"), F.char((97 + F.col("event_id") % 3).cast("int")).alias("room"))
    return survey.zone_of_room(_probabilities(spark, sf_dir).where("sample_id % 5 > 0"), zones_, mine).withColumnRenamed("sample_id", "event_id")


@query(f"WITH {H}, {ZP}, {SCOPED} SELECT event_id, zone, confidence FROM bz")
def zone_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_zones(spark, sf_dir)


@query(f"WITH {H}, {ZP} SELECT sample_id, zone, round(p, 6) AS p, row_number() OVER (PARTITION BY sample_id ORDER BY round(p, 9) DESC, zone) AS rank FROM zp QUALIFY rank <= 4")
def zone_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.top_zones(_probabilities(spark, sf_dir)), 6, "p").select("sample_id", "zone", "p", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {H}, {ZP}, {SCOPED}, n AS (SELECT event_id, h.t, bz.zone, bz.confidence FROM bz JOIN h USING (event_id) WHERE zone IS NOT NULL ORDER BY h.t DESC, event_id DESC LIMIT 300) SELECT event_id, round(t, 6) AS t, zone, confidence FROM n ORDER BY n.t, event_id")
def zone_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest zone predictions, oldest first: as many as the service keeps."""
    rows = _best_zones(spark, sf_dir).where("zone IS NOT NULL").join(_h(spark, sf_dir).select("event_id", "t"), "event_id")
    return rounded(history.page(rows, 300).orderBy("t", "event_id"), 6, "t").select("event_id", "t", "zone", "confidence")


@query(f"WITH {H}, n AS (SELECT * FROM h WHERE t >= (SELECT max(t) FROM h) - 10800 ORDER BY t DESC, event_id DESC LIMIT 1500) SELECT event_id, beacon, round(t, 6) AS t, floor, label FROM n")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hours of history."""
    return rounded(history.window(_h(spark, sf_dir), 3), 6, "t").select("event_id", "beacon", "t", "floor", "label")


@query(f"WITH {H}, {ZP}, {SCOPED}, c AS (SELECT event_id AS pid, x, y, floor FROM h), {SQL_ROOM} SELECT h.event_id, beacon, round(h.x, 2) AS x, round(h.y, 2) AS y, h.floor, round(h.confidence, 3) AS confidence, coalesce(bz.zone, lab.zone) AS location_label, activity, lab.zone AS polygon_label, bz.zone AS zone_label, round(bz.confidence + 1e-9, 3) AS zone_confidence FROM h JOIN bz USING (event_id) JOIN lab ON pid = h.event_id")
def position_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = space.labelled(_h(spark, sf_dir), spatial._plan(spark))
    return history.records(rows, _best_zones(spark, sf_dir)).drop("ts")


@query(f"WITH {H}, p AS (SELECT label AS zone, event_id // 40 AS point, count(*) FILTER (activity IS NOT NULL) >= 3 AS done FROM h GROUP BY ALL) SELECT zone, count(*) FILTER (done) AS done, count(*) AS total, count(*) FILTER (done) >= 3 AS enough FROM p GROUP BY 1")
def survey_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (forty positions each) of a label are done with three readings that have an activity."""
    points = _h(spark, sf_dir).groupBy(F.col("label").alias("zone"), F.floor(F.col("event_id") / 40).alias("point")).agg((F.count("activity") >= 3).alias("done"))
    return survey.coverage(points)


def _gauss(key: str) -> str:
    return f"sqrt(-2 * ln(1 - {U(key, chr(39) + 'u1' + chr(39))})) * cos(2 * 3.141592653589793 * {U(key, chr(39) + 'u2' + chr(39))})"


KEY = "sample_id || '/' || copy || '/' || anchor_idx"
SHAKEN = lambda key: f"CASE WHEN rssi > -100 THEN rssi + {K.AUGMENT_SIGMA} * {_gauss(key)} ELSE rssi END"
AUGMENTED = f"""cp AS (SELECT fp.*, CAST(i AS INTEGER) AS copy FROM fp, range(0, {K.AUGMENT_FACTOR + 1}) g(i)),
ag AS (SELECT sample_id, copy, anchor_idx, CASE WHEN copy = 0 THEN rssi WHEN {U(KEY, chr(39) + 'drop' + chr(39))} < {K.AUGMENT_DROPOUT} THEN -100 ELSE {SHAKEN(KEY)} END AS rssi FROM cp)"""


@query(f"WITH {R}, {PRINTS}, {AUGMENTED} SELECT sample_id, copy, anchor_idx, round(rssi, 4) AS rssi FROM ag")
def augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.augmented(_prints(spark, sf_dir)), 4, "rssi")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a fingerprint: the floor on which it is heard best."""
    best = _samples(spark, sf_dir).groupBy(F.col("point_id").alias("sample_id"), "floor").agg(F.avg("rssi").alias("m"))
    return best.groupBy("sample_id").agg(F.concat(F.lit("floor_"), F.max_by("floor", F.struct(F.round("m", 9), -F.col("floor"))).cast("string")).alias("label"))


LABELLED = "bl AS (SELECT event_id // 40 AS sample_id, floor, avg(rssi) AS m FROM r GROUP BY ALL), lb AS (SELECT sample_id, 'floor_' || arg_max(floor, (round(m, 9), -floor)) AS label FROM bl GROUP BY 1)"


@query(f"""WITH {R}, {PRINTS}, {LABELLED}, {AUGMENTED}, k AS (SELECT sample_id, count(DISTINCT copy) AS copies FROM ag GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) - 1 AS i, sum(copies) OVER (PARTITION BY label) AS n FROM lb JOIN k USING (sample_id)), m AS (SELECT max(n) AS most FROM i),
e AS (SELECT ag.*, label, unnest(range(1, 1 + CAST(greatest(0, ceil((most - n - i * copies - copy) / n)) AS BIGINT))) AS extra FROM ag JOIN i USING (sample_id), m)
SELECT sample_id, label, copy, extra, anchor_idx, round({SHAKEN(KEY + " || '/' || extra")}, 4) AS rssi FROM e""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.oversampled(survey.augmented(_prints(spark, sf_dir)), _labels(spark, sf_dir)), 4, "rssi")


#: Predictions from the strongest anchor's floor.
PREDICTED = f"pr AS (SELECT sample_id, 'floor_' || floor AS predicted FROM fp JOIN {layout.values('anchors')} USING (anchor_idx) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(rssi, 9) DESC, anchor_idx) = 1), pl AS (SELECT * FROM lb JOIN pr USING (sample_id))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    best: Column = F.max_by("anchor_idx", F.struct(F.round("rssi", 9), -F.col("anchor_idx")))
    p = _prints(spark, sf_dir).groupBy("sample_id").agg(best.alias("anchor_idx")).join(F.broadcast(_anchors(spark).select("anchor_idx", "floor")), "anchor_idx")
    return _labels(spark, sf_dir).join(p.select("sample_id", F.concat(F.lit("floor_"), F.col("floor").cast("string")).alias("predicted")), "sample_id")


@query(f"WITH {R}, {PRINTS}, {LABELLED}, {PREDICTED}, u AS (SELECT label AS l, 1 AS a, 0 AS p, CAST(label = predicted AS INTEGER) AS h FROM pl UNION ALL SELECT predicted, 0, 1, 0 FROM pl) SELECT l AS label, round(coalesce(sum(h) / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(h) / nullif(sum(a), 0), 0), 6) AS recall, round(coalesce(2 * sum(h) / nullif(sum(a) + sum(p), 0), 0), 6) AS f1, CAST(sum(a) AS BIGINT) AS support FROM u GROUP BY 1")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.class_metrics(_predicted(spark, sf_dir)), 6, "precision", "recall", "f1")


@query(f"WITH {R}, {PRINTS}, {LABELLED}, {PREDICTED} SELECT label, predicted, count(*) AS n FROM pl GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.confusion(_predicted(spark, sf_dir))


@query(f"WITH {R}, {PRINTS}, {LABELLED}, {PREDICTED}, u AS (SELECT label AS l, 1 AS a, 0 AS p, CAST(label = predicted AS INTEGER) AS h FROM pl UNION ALL SELECT predicted, 0, 1, 0 FROM pl), f AS (SELECT coalesce(2 * sum(h) / nullif(sum(a) + sum(p), 0), 0) AS f1 FROM u GROUP BY l) SELECT round(avg(CAST(label = predicted AS INTEGER)), 4) AS accuracy, count(*) AS n, (SELECT round(avg(f1), 4) FROM f) AS macro_f1, (SELECT count(*) FROM f) AS n_classes FROM pl")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.summary(_predicted(spark, sf_dir))


ZONE_OF = "zc AS (SELECT event_id // 40 AS sample_id, label, count(*) AS n FROM h GROUP BY ALL), zl AS (SELECT sample_id, arg_min(label, (-n, label)) AS label FROM zc GROUP BY 1)"


def _zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of a fingerprint: the label that most of its positions have. Nothing that the classifier sees tells it."""
    n = _h(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 40).alias("sample_id"), "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sample_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


@query(f"WITH {H}, {ZONE_OF} SELECT sample_id, label, (row_number() OVER (PARTITION BY label ORDER BY {U('CAST(sample_id AS VARCHAR)', chr(39) + 'r' + chr(39))}) - 1) % 5 AS fold FROM zl")
def zone_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds that cross-validation deals samples to, each label by itself."""
    return zones.folds(_zone_labels(spark, sf_dir))


def rf_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (sample_id, label, predicted) of forests by five-fold cross-validation, trained on augmented and balanced samples."""
    return zones.cross_validated(_vectors(spark, sf_dir).persist(), _zone_labels(spark, sf_dir).persist(), 9)


QUERIES["rf_zone"] = rf_zone


@query(f"WITH {R}, s AS (SELECT anchor_id AS stage, -rssi AS ms FROM r) SELECT stage, count(*) AS n, round(min(ms), 6) AS min_ms, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(max(ms), 6) AS max_ms, round(1000 / avg(ms), 6) AS per_s, round(sum(ms) * 100 / sum(sum(ms)) OVER (), 6) AS pct FROM s GROUP BY 1")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings.readings(spark, sf_dir).select(F.col("anchor_id").alias("stage"), (-F.col("rssi")).alias("ms"))
    return rounded(history.stage_percentiles(rows), 6, "min_ms", "mean_ms", "p50", "p95", "p99", "max_ms", "per_s", "pct")


@query(f"WITH {R}, {PRINTS}, {LABELLED} SELECT sample_id, label, count(*) AS n_anchors FROM lb JOIN fp USING (sample_id) WHERE label = 'floor_2' GROUP BY ALL ORDER BY sample_id DESC LIMIT 1000")
def fingerprint_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).where("label = 'floor_2'").join(_prints(spark, sf_dir), "sample_id").groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n_anchors"))
    return rows.orderBy(F.desc("sample_id")).limit(1000)


#: How fast a zone's smoothed probability follows, by activity: fixed values.
FOLLOW = {"moving": 0.3, "stationary": 0.05, "sleeping": 0.01}


def zone_smoothed_rows(positions: DataFrame, block_s: float = prefix.BLOCK_S) -> DataFrame:
    """(event_id, p): exponentially smoothed confidence of a beacon's label: it follows by activity and starts anew when the label changes."""
    follow = F.coalesce(F.create_map(*(F.lit(v) for kv in FOLLOW.items() for v in kv))[F.col("activity")], F.lit(FOLLOW["stationary"]))
    rows = positions.select("beacon", "t", "event_id", F.xxhash64("label").alias("label"), follow.alias("follow"), "confidence")
    return prefix.prefixed(rows, ["beacon"], ["t", "event_id"], zones.Following(), ["event_id"], block_s)


@query(f"""WITH RECURSIVE {H}, n AS (SELECT *, row_number() OVER (PARTITION BY beacon ORDER BY t, event_id) AS i, CASE activity WHEN 'moving' THEN 0.3 WHEN 'sleeping' THEN 0.01 ELSE 0.05 END::DOUBLE AS a FROM h), z(beacon, i, event_id, label, p) AS (
  SELECT beacon, i, event_id, label, confidence FROM n WHERE i = 1
  UNION ALL SELECT n.beacon, n.i, n.event_id, n.label, CASE WHEN n.label <> z.label THEN n.confidence ELSE z.p + n.a * (n.confidence - z.p) END FROM z JOIN n ON n.beacon = z.beacon AND n.i = z.i + 1
) SELECT event_id, round(p, 6) AS p FROM z""")
def zone_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zone_smoothed_rows(_h(spark, sf_dir)), 6, "p")
