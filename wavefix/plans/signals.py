"""Registered queries over readings: parsing, Kalman, features, floor beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import activity as activity_label
from wavefix.functions.signal import activity_score, battery_class, battery_percent, expected_rssi, quality_bucket
from wavefix.operators import features, floors, history, kalman, prefix
from wavefix.sources import layout, readings
from wavefix.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


R, C, H = readings.SQL_READINGS, readings.SQL_PARTICLES, readings.SQL_POSITIONS
#: Cycles, and the newest raw and smoothed strength of each anchor in each cycle.
CYCLES = "y AS (SELECT *, row_number() OVER (PARTITION BY beacon ORDER BY t, event_id) AS cycle FROM r)"
VECTORS = """vec AS (
  SELECT event_id, beacon, cycle, t, anchor_idx, h.raw AS raw, h.x AS x, t - h.at AS age, f AS first_seen FROM (
    SELECT y.event_id, y.beacon, y.cycle, y.t, CAST(ai AS INTEGER) AS anchor_idx,
           last_value(CASE WHEN ai = y.anchor_idx THEN {'raw': y.rssi, 'x': k.x, 'at': y.t} END IGNORE NULLS) OVER w AS h, min(CASE WHEN ai = y.anchor_idx THEN y.cycle END) OVER w AS f
    FROM y JOIN k USING (event_id), range(0, 9) g(ai) WINDOW w AS (PARTITION BY y.beacon, ai ORDER BY y.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  ) WHERE h IS NOT NULL
)"""
BASE = f"WITH RECURSIVE {R}, {kalman.SQL}, {CYCLES}, {VECTORS}"
RANKS = f"ranks AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(x, 9) DESC, first_seen, anchor_idx) AS rank FROM vec WHERE age <= {K.STALE_S})"
ANCHORS = layout.values("anchors")


def _vec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = readings.readings(spark, sf_dir)
    return features.cycles(r), features.vectors(features.cycles(r), kalman.smoothed(r))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw strengths alone: no filter runs for them."""
    return features.vectors(features.cycles(readings.readings(spark, sf_dir)))


def _anchors(spark: SparkSession) -> DataFrame:
    return layout.anchors(readings.plan(spark))


@query(f"WITH {R}, {readings.SQL_MESSAGES} SELECT event_id, CAST(device AS BIGINT) AS beacon, anchor_id, round(t, 6) AS t, coalesce(CAST(j ->> '$.rssi' AS DOUBLE), -100) AS rssi, coalesce(CAST(j ->> '$.distance' AS DOUBLE), 0) AS distance FROM p")
def reading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings.parsed(readings.messages(spark, sf_dir))
    return rounded(rows, 6, "t").select("event_id", F.col("device").cast("long").alias("beacon"), "anchor_id", "t", "rssi", "distance")


@query(f"""WITH {R}, {readings.SQL_MESSAGES}, v AS (SELECT *, CAST(j ->> '$.mV' AS INTEGER) AS mv, CAST(j ->> '$.temp' AS DOUBLE) AS temp FROM p), a AS (
  SELECT CAST(device AS BIGINT) AS beacon, arg_max(mv, (t, event_id)) FILTER (mv IS NOT NULL) AS battery_mv, round(max(t) FILTER (mv IS NOT NULL), 6) AS updated, arg_max(temp, (t, event_id)) FILTER (temp IS NOT NULL) AS temp_c FROM v WHERE mv IS NOT NULL OR temp IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN battery_mv IS NOT NULL THEN CAST(greatest(0, least(100, floor((battery_mv - 2000) / 10.0 + 0.5))) AS INTEGER) END AS percent, CASE WHEN battery_mv IS NULL THEN NULL WHEN percent > 40 THEN 'good' WHEN percent > 15 THEN 'warn' ELSE 'bad' END AS class FROM a""")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each beacon's newest battery voltage and temperature; a message may tell of either."""
    rows = readings.parsed(readings.messages(spark, sf_dir)).where("mv IS NOT NULL OR temp IS NOT NULL")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t", "event_id")))
    out = rows.groupBy(F.col("device").cast("long").alias("beacon")).agg(newest("mv").alias("battery_mv"), F.round(F.max(F.when(F.col("mv").isNotNull(), F.col("t"))), 6).alias("updated"), newest("temp").alias("temp_c"))
    known = F.col("battery_mv").isNotNull()
    return out.withColumn("percent", F.when(known, battery_percent("battery_mv"))).withColumn("class", F.when(known, battery_class("percent")))


@query(f"WITH {R} SELECT beacon, anchor_id, round(t, 6) AS t, round(rssi, 6) AS rssi, CASE WHEN rssi > -60 THEN 'good' WHEN rssi > -75 THEN 'warn' ELSE 'bad' END AS quality FROM r QUALIFY row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY t DESC, event_id DESC) = 1")
def reading_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.latest(readings.readings(spark, sf_dir)).withColumn("quality", quality_bucket("rssi"))
    return rounded(rows, 6, "t", "rssi").select("beacon", "anchor_id", "t", "rssi", "quality")


@query(f"{BASE} SELECT beacon, event_id, anchor_idx, round(raw, 6) AS rssi, round(age, 6) AS age_s FROM vec")
def reading_asof_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("beacon", "event_id", "anchor_idx", F.round("raw", 6).alias("rssi"), F.round("age", 6).alias("age_s"))


@query(f"WITH {R}, l AS (SELECT beacon, rssi FROM r QUALIFY row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY t DESC, event_id DESC) = 1) SELECT beacon, count(*) AS anchor_count, round(min(rssi), 6) AS min_rssi, round(max(rssi), 6) AS max_rssi FROM l GROUP BY 1")
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.devices(history.latest(readings.readings(spark, sf_dir)))


@query(f"WITH {R} SELECT DISTINCT beacon, anchor_id FROM r")
def device_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.readings(spark, sf_dir).select("beacon", "anchor_id").distinct()


def throttle(rows: DataFrame, least: float = K.MIN_INTERVAL_S, block_s: float = prefix.BLOCK_S) -> DataFrame:
    """Rows (beacon, event_id, t) at least ``least`` seconds after the last one kept."""
    return prefix.throttled(rows, "beacon", "t", "event_id", least, block_s)


@query(f"""WITH RECURSIVE {R}, {CYCLES}, z(beacon, cycle, event_id, t, kept, keep) AS (
  SELECT beacon, cycle, event_id, t, t, true FROM y WHERE cycle = 1
  UNION ALL SELECT y.beacon, y.cycle, y.event_id, y.t, CASE WHEN y.t - z.kept >= {K.MIN_INTERVAL_S} THEN y.t ELSE z.kept END, y.t - z.kept >= {K.MIN_INTERVAL_S} FROM z JOIN y ON y.beacon = z.beacon AND y.cycle = z.cycle + 1
) SELECT beacon, event_id, round(t, 6) AS t FROM z WHERE keep""")
def throttle_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(throttle(readings.readings(spark, sf_dir)), 6, "t")


@query(f"WITH {R} SELECT beacon, event_id, round(coalesce(least(t - lag(t) OVER (PARTITION BY beacon ORDER BY t, event_id), {K.MAX_DT}), {K.DEFAULT_DT}), 6) AS dt FROM r")
def cycle_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings.readings(spark, sf_dir)
    return rows.select("beacon", "event_id", F.round(features.dt(rows), 6).alias("dt"))


@query(f"WITH {R}, g AS (SELECT beacon, t, t - lag(t) OVER (PARTITION BY beacon ORDER BY t, event_id) AS gap FROM r) SELECT beacon, count(*) AS n, round(min(gap), 6) AS min_gap, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS max_gap, round((count(*) - 1) / nullif(max(t) - min(t), 0), 6) AS rate FROM g GROUP BY 1")
def message_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.gaps(readings.readings(spark, sf_dir)), 6, "min_gap", "mean_gap", "median_gap", "max_gap", "rate")


@query(f"WITH RECURSIVE {R}, {kalman.SQL} SELECT event_id, round(x, 6) AS x, round(v, 6) AS v, round(a, 6) AS p00 FROM k")
def kalman_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kalman.smoothed(readings.readings(spark, sf_dir)), 6, "x", "v", "p00").select("event_id", "x", "v", "p00")


@query(f"WITH RECURSIVE {R}, {kalman.SQL}, l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY n DESC) = 1) SELECT beacon, anchor_idx, round(v, 6) AS velocity, round(a, 6) AS variance, count(*) OVER (PARTITION BY beacon) AS n_active FROM l")
def kalman_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kalman.accessors(kalman.smoothed(readings.readings(spark, sf_dir))), 6, "velocity", "variance")


@query(f"WITH {R}, {readings.SQL_MESSAGES} SELECT event_id, anchor_id, coalesce(CAST(j ->> '$.rssi' AS DOUBLE), -100) AS rssi FROM p WHERE CAST(device AS BIGINT) IN (3, 5)")
def tracked_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the beacons that are tracked; others only pass by."""
    return live.readings(readings.messages(spark, sf_dir), [3, 5]).select("event_id", "anchor_id", "rssi")


@query(f"WITH RECURSIVE {R}, {kalman.SQL} SELECT beacon, anchor_idx, round(x, 6) AS x FROM k QUALIFY row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY n DESC) = 1 AND max(t) OVER (PARTITION BY beacon) - t <= {K.STALE_S}")
def kalman_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman.snapshot(kalman.smoothed(readings.readings(spark, sf_dir))).select("beacon", "anchor_idx", F.round("x", 6).alias("x"))


@query(f"{BASE}, d AS (SELECT event_id, cycle, beacon, abs(raw - lag(raw) OVER (PARTITION BY beacon, anchor_idx ORDER BY cycle)) AS d FROM vec) SELECT event_id, beacon, cycle, coalesce(round(avg(d) + 1e-9, 3), 0) AS delta_mean, coalesce(round(max(d) + 1e-9, 3), 0) AS delta_max FROM d GROUP BY ALL")
def delta_rssi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.delta_features(_raw(spark, sf_dir))


VARIANCE = f"""ch AS (SELECT *, coalesce(rssi <> lag(rssi) OVER (PARTITION BY beacon, anchor_idx ORDER BY t, event_id), true) AS new FROM r), vw AS (
  SELECT event_id, beacon, anchor_idx, t, last_value(CASE WHEN new THEN v END IGNORE NULLS) OVER w AS variance, last_value(CASE WHEN new THEN n END IGNORE NULLS) OVER w AS n_window FROM (
    SELECT *, coalesce(round(var_samp(rssi) OVER u + 1e-9, 3), 0) AS v, count(*) OVER u AS n FROM ch WINDOW u AS (PARTITION BY beacon, anchor_idx, new ORDER BY t, event_id ROWS BETWEEN {K.FEATURE_WINDOW - 1} PRECEDING AND CURRENT ROW)
  ) WINDOW w AS (PARTITION BY beacon, anchor_idx ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@query(f"WITH {R}, {VARIANCE} SELECT event_id, round(variance, 3) AS var20 FROM vw")
def rolling_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.variances(readings.readings(spark, sf_dir)).select("event_id", F.col("variance").alias("var20"))


@query(f"{BASE}, {RANKS} SELECT event_id, anchor_idx, rank FROM ranks")
def anchor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ranks(_vec(spark, sf_dir)[1]).select("event_id", "anchor_idx", "rank")


@query(f"{BASE}, {RANKS} SELECT event_id, beacon, cycle, max(CASE WHEN rank = 1 THEN anchor_idx END) AS strongest, coalesce(round(max(CASE WHEN rank = 1 THEN x END) - max(CASE WHEN rank = 2 THEN x END), 3), 0) AS gap, count(*) AS n_reporting FROM ranks GROUP BY ALL")
def strongest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strongest(features.ranks(_vec(spark, sf_dir)[1]))


@query(f"{BASE}, {RANKS} SELECT a.event_id, a.beacon, a.cycle, count(*) FILTER (b.rank <> a.rank) AS rank_changes FROM ranks a LEFT JOIN ranks b ON b.beacon = a.beacon AND b.anchor_idx = a.anchor_idx AND b.cycle = a.cycle - 1 GROUP BY ALL")
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rank_changes(features.ranks(_vec(spark, sf_dir)[1]))


FLOORS = f"fl AS (SELECT event_id, beacon, cycle, t, a.floor, count(*) AS n, avg(x) AS mean, max(x) AS best FROM vec JOIN {ANCHORS} AS a USING (anchor_idx) WHERE age <= {K.STALE_S} GROUP BY ALL)"
FLOORS = FLOORS.replace(f"{ANCHORS} AS a", ANCHORS).replace("a.floor", "anchors.floor")


@query(f"{BASE}, {FLOORS} SELECT event_id, beacon, cycle, floor, n, round(mean + 1e-9, 2) AS mean FROM fl")
def floor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.fresh(_vec(spark, sf_dir)[1]).join(F.broadcast(_anchors(spark).select("anchor_idx", "floor")), "anchor_idx")
    return rows.groupBy("event_id", "beacon", "cycle", "floor").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x") + features.TIE, 2).alias("mean"))


@query(f"{BASE}, {FLOORS} SELECT event_id, beacon, cycle, arg_max(floor, (round(mean, 9), -floor)) AS best_floor, CASE WHEN count(*) > 1 THEN round(max(mean) - (sum(mean) - max(mean)) / (count(*) - 1) + 1e-9, 2) ELSE 0 END AS ratio, count(*) AS n_floors FROM fl GROUP BY ALL")
def floor_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.floor_signal(_vec(spark, sf_dir)[1], _anchors(spark))


DISPLACED = f"dp AS (SELECT event_id, beacon, round(CASE WHEN count(*) OVER w < 2 THEN 0 WHEN first_value(floor) OVER w <> floor THEN 1 ELSE sqrt((x - first_value(x) OVER w) * (x - first_value(x) OVER w) + (y - first_value(y) OVER w) * (y - first_value(y) OVER w)) END, 3) AS displacement_ft FROM h WINDOW w AS (PARTITION BY beacon ORDER BY t, event_id ROWS BETWEEN {K.POSITION_WINDOW - 1} PRECEDING AND CURRENT ROW))"


@query(f"WITH {H}, {DISPLACED} SELECT * FROM dp")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.displacement(readings.positions(spark, sf_dir))


ACTIVITY = f"""{BASE}, {H}, {DISPLACED}, {VARIANCE}, d AS (SELECT event_id, beacon, cycle, anchor_idx, age, abs(raw - lag(raw) OVER (PARTITION BY beacon, anchor_idx ORDER BY cycle)) AS d FROM vec),
dm AS (SELECT event_id, coalesce(round(avg(d) + 1e-9, 3), 0) AS delta_mean FROM d GROUP BY ALL),
va AS (SELECT y.event_id, CAST(a AS INTEGER) AS anchor_idx, last_value(CASE WHEN a = y.anchor_idx THEN {{'v': vw.variance, 'n': n_window}} END IGNORE NULLS) OVER (PARTITION BY y.beacon, a ORDER BY y.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM y JOIN vw USING (event_id), range(0, 9) g(a)),
vm AS (SELECT event_id, round(avg(s.v) + 1e-9, 3) AS var_mean, round(max(s.v), 3) AS var_max FROM vec JOIN va USING (event_id, anchor_idx) WHERE age <= {K.STALE_S} AND s.n >= 2 GROUP BY 1),
sc AS (SELECT dm.event_id, coalesce(var_mean, 0) AS var_mean, coalesce(var_max, 0) AS var_max, round(0.25 * least(coalesce(var_mean, 0) / 8, 1) + 0.25 * least(delta_mean / 3, 1) + 0.5 * least(displacement_ft / 4, 1) + 1e-9, 3) AS activity_score FROM dm JOIN dp USING (event_id) LEFT JOIN vm USING (event_id))
SELECT *, CASE WHEN activity_score < {K.SLEEPING_BELOW} THEN 'sleeping' WHEN activity_score < {K.STATIONARY_BELOW} THEN 'stationary' ELSE 'moving' END AS activity FROM sc"""


@query(ACTIVITY)
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.readings(spark, sf_dir)
    rows = features.cycles(r).join(features.variances(r).select("event_id", "variance", "n_window"), "event_id")
    vec = features.as_of(rows, "rssi", "variance", "n_window").withColumnRenamed("rssi", "raw")
    delta = features.delta_features(vec).select("event_id", "delta_mean")
    var = features.fresh(vec).where("n_window >= 2").groupBy("event_id").agg(F.round(F.avg("variance") + 1e-9, 3).alias("var_mean"), F.round(F.max("variance"), 3).alias("var_max"))
    out = delta.join(features.displacement(readings.positions(spark, sf_dir)).drop("beacon"), "event_id").join(var, "event_id", "left").fillna(0.0, ["var_mean", "var_max"])
    out = out.withColumn("activity_score", activity_score("var_mean", "delta_mean", "displacement_ft"))
    return out.select("event_id", "var_mean", "var_max", "activity_score", activity_label("activity_score").alias("activity"))


@query(f"WITH {C} SELECT anchor_id, pid, round(-66 - 24 * log10(greatest(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), 1) * 0.3048) - 6 * abs(c.floor - anchors.floor), 4) AS expected FROM c, {ANCHORS}")
def expected_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavefix.functions.signal import distance

    a = _anchors(spark).select("anchor_id", F.col("floor").alias("a_floor"), "ax", "ay")
    both = readings.particles(spark, sf_dir).crossJoin(F.broadcast(a))
    return both.select("anchor_id", "pid", F.round(expected_rssi(distance("x", "y", "ax", "ay"), F.abs(F.col("floor") - F.col("a_floor"))), 4).alias("expected"))


EMISSIONS = f"""{BASE}, {FLOORS}, em AS (
  SELECT event_id, beacon, cycle, t, g, CASE WHEN count(*) < 2 THEN 0 ELSE -0.5 * count(*) * var_pop(best + abs(floor - g) * 6) / 64 END AS ll FROM fl, range(1, 4) q(g) GROUP BY ALL
), ep AS (SELECT event_id, beacon, cycle, t, max(CASE WHEN g = 1 THEN ll END) AS l1, max(CASE WHEN g = 2 THEN ll END) AS l2, max(CASE WHEN g = 3 THEN ll END) AS l3, greatest(l1, l2, l3) AS m FROM em GROUP BY ALL),
es AS (SELECT event_id, beacon, cycle, t, exp(l1 - m) AS w1, exp(l2 - m) AS w2, exp(l3 - m) AS w3, w1 + w2 + w3 AS s FROM ep)"""


@query(f"{EMISSIONS} SELECT event_id, beacon, cycle, round(w1 / s, 6) AS e1, round(w2 / s, 6) AS e2, round(w3 / s, 6) AS e3 FROM es")
def hmm_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = floors.emissions(_vec(spark, sf_dir)[1], _anchors(spark), floors.names(readings.plan(spark)))
    return rounded(rows, 6, "e1", "e2", "e3").select("event_id", "beacon", "cycle", "e1", "e2", "e3")


@query(f"""{EMISSIONS}, b(event_id, beacon, cycle, t, b1, b2, b3) AS (
  SELECT event_id, beacon, cycle, t, w1 / s, w2 / s, w3 / s FROM es WHERE cycle = 1
  UNION ALL
  SELECT event_id, beacon, cycle, t, q1 / (q1 + q2 + q3), q2 / (q1 + q2 + q3), q3 / (q1 + q2 + q3) FROM (
    SELECT es.event_id, es.beacon, es.cycle, es.t, least(0.01 * least(es.t - b.t, {K.MAX_DT}), 0.3) AS o, (b1 * (1 - o) + b2 * o) * w1 / s AS q1, (b1 * o + b2 * (1 - 2 * o) + b3 * o) * w2 / s AS q2, (b2 * o + b3 * (1 - o)) * w3 / s AS q3
    FROM b JOIN es ON es.beacon = b.beacon AND es.cycle = b.cycle + 1)
) SELECT event_id, beacon, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, CASE WHEN round(b1, 9) >= round(b2, 9) AND round(b1, 9) >= round(b3, 9) THEN 1 WHEN round(b2, 9) >= round(b3, 9) THEN 2 ELSE 3 END AS floor FROM b""")
def hmm_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = readings.plan(spark)
    rows = floors.beliefs(floors.emissions(_vec(spark, sf_dir)[1], _anchors(spark), floors.names(plan)), plan)
    return rounded(rows, 6, "b1", "b2", "b3")


@query(f"WITH {R} SELECT beacon, anchor_idx, row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY t, event_id) - 1 AS i, round(rssi, 6) AS rssi FROM r")
def anchor_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sparkline(readings.readings(spark, sf_dir)).select("beacon", "anchor_idx", F.col("i").cast("long").alias("i"), F.round("rssi", 6).alias("rssi"))


@query(f"WITH {R} SELECT count(*) AS readings, count(DISTINCT beacon) AS devices, count(DISTINCT anchor_idx) AS anchors, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t FROM r")
def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.readings(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("beacon").alias("devices"), F.count_distinct("anchor_idx").alias("anchors"), F.round(F.min("t"), 6).alias("first_t"), F.round(F.max("t"), 6).alias("last_t"))


@query(f"WITH {R}, {readings.SQL_MESSAGES} SELECT p.event_id, p.anchor_id, CAST(j ->> '$.rssi' AS DOUBLE) AS rssi FROM p JOIN {ANCHORS} ON anchors.anchor_id = replace(p.anchor_id, '-', '_') WHERE j ->> '$.rssi' IS NOT NULL")
def calibration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.calibration_readings(readings.messages(spark, sf_dir), _anchors(spark))


@query(f"WITH {R} SELECT event_id, beacon, anchor_id, round(t, 6) AS t, round(rssi, 6) AS rssi FROM (SELECT * FROM r ORDER BY r.t DESC, event_id DESC LIMIT 100) ORDER BY t, event_id")
def rssi_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.page(readings.readings(spark, sf_dir), 100).orderBy("t", "event_id")
    return rounded(rows, 6, "t", "rssi").select("event_id", "beacon", "anchor_id", "t", "rssi")


@query(f"WITH {R}, {readings.SQL_MESSAGES}, s AS (SELECT m.event_id, split_part(topic, '/', 4) AS raw, CASE WHEN json_valid(payload) AND trim(payload) LIKE '{{%' THEN payload::JSON END AS j FROM m WHERE length(topic) - length(replace(topic, '/', '')) >= 3) SELECT event_id, coalesce(anchors.anchor_id, raw) AS anchor_id, CAST(j ->> '$.rssi' AS DOUBLE) AS rssi FROM s LEFT JOIN {ANCHORS} ON anchors.anchor_id = lower(raw) WHERE j ->> '$.rssi' IS NOT NULL")
def survey_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parsing for surveys: ids of the plan in its spelling, others as they come."""
    return readings.survey_readings(readings.messages(spark, sf_dir), _anchors(spark))


@query(f"WITH {R} SELECT DISTINCT anchor_id FROM r")
def anchor_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.anchor_universe(readings.readings(spark, sf_dir))
