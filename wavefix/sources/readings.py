"""Readings from raw messages, and the driver's tables seen as readings, particles and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.functions.signal import noise
from wavefix.sources import layout

#: 2024-01-01 in microseconds, and how many seconds of ``events`` make one second of readings.
EPOCH_US, SCALE = 1704067200000000, 10000
PAYLOAD = "rssi double, distance double, mV int, temp double"


def plan(spark: SparkSession) -> DataFrame:
    return layout.read(spark)


def seconds(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - EPOCH_US) / 1e6 / SCALE


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as readings joined to their anchors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("user_id").alias("beacon"), (F.col("event_id") % 9).cast("int").alias("anchor_idx"), seconds(F.col("ts")).alias("t"), (-30 - F.least("value", F.lit(70.0))).alias("rssi")
    )
    return e.join(F.broadcast(layout.anchors(plan(spark))), "anchor_idx")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a particle cloud: (pid, x, y, floor, w)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pid"))
    return p.select("pid", (noise("pid", "x") * 17.7).alias("x"), (noise("pid", "y") * 29.39).alias("y"), (F.pmod("pid", F.lit(3)) + 1).cast("int").alias("floor"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as position history: (event_id, beacon, t, ts, x, y, floor, label, activity, confidence)."""
    labels, acts = ("living_room", "kitchen", "office", "master_bed", "hallway"), ("sleeping", "stationary", "moving")
    pick = lambda names, col: F.element_at(F.array(*map(F.lit, names)), (col + 1).cast("int"))
    act = F.when(F.col("event_id") % 7 == 6, F.lit(None)).otherwise(pick(acts, F.floor(noise("event_id", "act") * 3)))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("user_id").alias("beacon"), seconds(F.col("ts")).alias("t"), F.col("ts").cast("timestamp").alias("ts"),
        (noise("event_id", "x") * 17.7).alias("x"), (noise("event_id", "y") * 29.39).alias("y"),
        (F.floor(noise(F.floor(F.col("event_id") / 400), "user_id", "fl") * 3) + 1).cast("int").alias("floor"),
        pick(labels, F.floor(noise("event_id", "lab") * 5)).alias("label"), act.alias("activity"), noise("event_id", "conf").alias("confidence"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as broker messages (event_id, topic, payload), some malformed."""
    rest = lambda n, k: F.col("event_id") % n == k
    body = F.concat(F.lit('{"rssi": '), F.floor("rssi").cast("string"), F.lit(', "distance": '), (F.col("event_id") % 17).cast("string"), F.when(rest(11, 3), F.concat(F.lit(', "mV": '), (2000 + F.col("event_id") % 1100).cast("string"))).otherwise(""), F.when(rest(13, 4), F.concat(F.lit(', "temp": '), (F.col("event_id") % 29).cast("string"), F.lit(".5"))).otherwise(""), F.lit("}"))
    return readings(spark, sf_dir).select(
        "event_id",
        "t",
        F.when(rest(50, 7), "bad/topic").when(rest(53, 5), "espresense/rooms/attic/x").otherwise(F.concat(F.lit("espresense/devices/"), F.col("beacon").cast("string"), F.lit("/"), F.upper("anchor_id"))).alias("topic"),
        F.when(rest(47, 3), "not json").when(rest(43, 2), "[1]").when(rest(41, 1), '{"id": "x"}').when(rest(37, 9), "  ").otherwise(body).alias("payload"),
    )


def parsed(msgs: DataFrame) -> DataFrame:
    """Device readings of messages (topic, payload): rejects short topics, other roots, and payloads that aren't objects.

    Only ``devices`` topics count, anchor ids are lower-cased, and a missing strength or distance gets its default.
    """
    parts = F.split("topic", "/")
    out = msgs.withColumn("_p", parts).where((F.size("_p") >= 4) & (F.get("_p", F.lit(0)) == "espresense") & (F.get("_p", F.lit(1)) == "devices"))
    body = F.trim("payload")
    out = out.where(body.startswith("{")).withColumn("_j", F.from_json(body, PAYLOAD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).where("_j IS NOT NULL AND _j._corrupt IS NULL")
    return out.select(*(c for c in msgs.columns if c not in ("topic", "payload")), F.get("_p", F.lit(2)).alias("device"), F.lower(F.get("_p", F.lit(3))).alias("anchor_id"), F.coalesce("_j.rssi", F.lit(-100.0)).alias("rssi"), F.coalesce("_j.distance", F.lit(0.0)).alias("distance"), F.col("_j.mV").alias("mv"), F.col("_j.temp").alias("temp"))


def calibration_readings(msgs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(event_id, anchor_id, rssi) of messages from known anchors: ids match in any case and with - for _; rows without a strength are dropped."""
    body = F.from_json(F.trim("payload"), "rssi double")
    name = F.lower(F.replace(F.get(F.split("topic", "/"), F.lit(3)), F.lit("-"), F.lit("_")))
    rows = msgs.where(F.col("topic").startswith("espresense/devices/")).select("event_id", name.alias("anchor_id"), body["rssi"].alias("rssi")).where("rssi IS NOT NULL")
    return rows.join(F.broadcast(anchors.select("anchor_id")), "anchor_id").select("event_id", "anchor_id", "rssi")


def survey_readings(msgs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(event_id, anchor_id, rssi) of messages with a strength: ids of the plan in any case get its spelling, unknown ones stay as they are."""
    body = F.trim("payload")
    rows = msgs.where((F.size(F.split("topic", "/")) >= 4) & body.startswith("{"))
    rows = rows.select("event_id", F.get(F.split("topic", "/"), F.lit(3)).alias("raw"), F.from_json(body, "rssi double")["rssi"].alias("rssi")).where("rssi IS NOT NULL")
    known = F.broadcast(anchors.select("anchor_id", F.lower("anchor_id").alias("name")))  # of the plan's size
    return rows.join(known, F.lower("raw") == F.col("name"), "left").select("event_id", F.coalesce("anchor_id", "raw").alias("anchor_id"), "rssi")


def anchor_universe(samples: DataFrame) -> DataFrame:
    """Every anchor that any sample heard, in order."""
    return samples.select("anchor_id").distinct().orderBy("anchor_id")


def survey_csv(spark: SparkSession, path: str) -> DataFrame:
    """Survey rows in long form (row, floor, x, y, room, zone, point_type, duration_s, n_readings, anchor_id, rssi, std).

    Columns are found by prefix; blanks are absent, and so are columns that a file lacks.
    """
    wide = spark.read.csv(path, header=True)
    names = [c[5:] for c in wide.columns if c.startswith("rssi_")]
    base = wide.withColumn("row", F.monotonically_increasing_id())
    zone = F.coalesce("zone", "location_label" if "location_label" in wide.columns else F.lit(None), F.lit("unknown"))
    has = lambda name, kind: (F.col(name) if name in wide.columns else F.lit(None)).cast(kind)
    more = F.coalesce(has("point_type", "string"), F.lit("grid")).alias("point_type"), has("duration_seconds", "double").alias("duration_s"), has("n_readings", "int").alias("n_readings")
    pairs = F.explode(F.array(*(F.struct(F.lit(n.lower()).alias("anchor_id"), F.col(f"rssi_{n}").cast("double").alias("rssi"), (F.col(f"std_{n}") if f"std_{n}" in wide.columns else F.lit(None)).cast("double").alias("std")) for n in names)))
    out = base.select("row", F.col("floor").cast("int").alias("floor"), F.col("grid_x").cast("double").alias("x"), F.col("grid_y").cast("double").alias("y"), F.coalesce("room" if "room" in wide.columns else F.lit(None), zone).alias("room"), zone.alias("zone"), *more, pairs.alias("p"))
    return out.select("row", "floor", "x", "y", "room", "zone", "point_type", "duration_s", "n_readings", "p.*").where("rssi IS NOT NULL")


def calibration_files(spark: SparkSession, glob: str) -> DataFrame:
    """Saved calibration documents, one row for each measurement."""
    schema = "measurements array<struct<distance_ft: double, rssi_mean: double, rssi_std: double, n_samples: int, n_walls: int>>"
    return spark.read.schema(schema).json(glob, multiLine=True).select(F.explode("measurements").alias("m")).select("m.*")


# --- the same tables in SQL -------------------------------------------------------


def sql_noise(*parts: str) -> str:
    joined = " || ':' || ".join(parts if len(parts) > 1 else [*parts])
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0)"


def _id(col: str, tag: str) -> str:
    return sql_noise(f"CAST({col} AS VARCHAR)", f"'{tag}'")


SQL_READINGS = f"""r AS (
  SELECT event_id, user_id AS beacon, CAST(event_id % 9 AS INTEGER) AS anchor_idx, anchor_id, floor, ax, ay, height, az,
         (epoch_us(ts) - {EPOCH_US}) / 1e6 / {SCALE} AS t, -30 - least(value, 70) AS rssi
  FROM events JOIN {layout.values("anchors")} ON anchors.anchor_idx = event_id % 9
)"""
SQL_PARTICLES = f"""c AS (
  SELECT p_partkey AS pid, {_id("p_partkey", "x")} * 17.7 AS x, {_id("p_partkey", "y")} * 29.39 AS y, CAST(p_partkey % 3 + 1 AS INTEGER) AS floor FROM part
)"""
SQL_POSITIONS = f"""h AS (
  SELECT event_id, user_id AS beacon, (epoch_us(ts) - {EPOCH_US}) / 1e6 / {SCALE} AS t, {_id("event_id", "x")} * 17.7 AS x, {_id("event_id", "y")} * 29.39 AS y,
         CAST(floor({sql_noise("CAST(event_id // 400 AS VARCHAR)", "CAST(user_id AS VARCHAR)", "'fl'")} * 3) + 1 AS INTEGER) AS floor,
         ['living_room', 'kitchen', 'office', 'master_bed', 'hallway'][CAST(floor({_id("event_id", "lab")} * 5) AS INTEGER) + 1] AS label,
         CASE WHEN event_id % 7 = 6 THEN NULL ELSE ['sleeping', 'stationary', 'moving'][CAST(floor({_id("event_id", "act")} * 3) AS INTEGER) + 1] END AS activity,
         {_id("event_id", "conf")} AS confidence
  FROM events
)"""
SQL_MESSAGES = """m AS (
  SELECT event_id, t,
    CASE WHEN event_id % 50 = 7 THEN 'bad/topic' WHEN event_id % 53 = 5 THEN 'espresense/rooms/attic/x' ELSE 'espresense/devices/' || beacon || '/' || upper(anchor_id) END AS topic,
    CASE WHEN event_id % 47 = 3 THEN 'not json' WHEN event_id % 43 = 2 THEN '[1]' WHEN event_id % 41 = 1 THEN '{"id": "x"}' WHEN event_id % 37 = 9 THEN '  '
         ELSE '{"rssi": ' || CAST(floor(rssi) AS BIGINT) || ', "distance": ' || (event_id % 17) || CASE WHEN event_id % 11 = 3 THEN ', "mV": ' || (2000 + event_id % 1100) ELSE '' END || CASE WHEN event_id % 13 = 4 THEN ', "temp": ' || (event_id % 29) || '.5' ELSE '' END || '}' END AS payload
  FROM r
), p AS (
  SELECT event_id, t, split_part(topic, '/', 3) AS device, lower(split_part(topic, '/', 4)) AS anchor_id, payload::JSON AS j
  FROM m WHERE topic LIKE 'espresense/devices/%/%' AND trim(payload) LIKE '{%' AND json_valid(payload)
)"""
