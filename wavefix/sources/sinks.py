"""Tables that the engine writes: positions, fingerprints, survey files, models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.operators import zones
from wavefix.sources import readings


def append_positions(rows: DataFrame, path: str) -> None:
    """Position history, a folder for each day; ``ts`` is the time of the estimate."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_fingerprints(rows: DataFrame, path: str, notes: str | Column = "") -> int:
    """Append survey fingerprints and return how many; ``import_id`` tells them from those of other calls."""
    own = f"i{uuid.uuid4().hex}"
    noted = rows.withColumns({"notes": F.lit(notes) if isinstance(notes, str) else notes, "import_id": F.lit(own)})
    noted.write.mode("append").partitionBy("import_id").parquet(path)
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/import_id={own}")
    if not at.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(at):
        return 0
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/import_id={own}").count()  # this import's files alone


def import_csv(spark: SparkSession, csv: str, path: str) -> int:
    """Append the points of survey files as fingerprints, with maps of strengths and deviations by anchor; returns how many."""
    rows = readings.survey_csv(spark, csv)
    key = ["row", "floor", "x", "y", "room", "zone", "point_type", "duration_s", "n_readings"]
    by_anchor = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("anchor_id", c)))))
    points = rows.groupBy(*key).agg(by_anchor("rssi").alias("rssi"), by_anchor("std").alias("std")).withColumn("location", F.col("zone")).drop("row")
    return append_fingerprints(points, path, F.concat(F.lit("imported from CSV; point_type="), "point_type"))


def survey_csv(points: DataFrame, samples: DataFrame, path: str) -> None:
    """Survey points with a column rssi_<anchor> and std_<anchor> for each anchor heard anywhere; absent ones are blank."""
    names = [r[0] for r in readings.anchor_universe(samples).collect()]  # the file's header
    wide = samples.groupBy("point_id").pivot("anchor_id", names).agg(F.first("mean").alias("rssi"), F.first("std").alias("std"))
    wide = wide.select("point_id", *(F.col(f"{n}_{k}").alias(f"{k}_{n}") for k in ("rssi", "std") for n in names))
    points.join(wide, "point_id").write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def counts(spark: SparkSession, path: str, beacon: int | None = None) -> int:
    rows = spark.read.parquet(path)
    return (rows if beacon is None else rows.where(F.col("beacon") == beacon)).count()


def save_model(spark: SparkSession, model: PipelineModel, path: str, zone_to_room: dict[str, str] | None = None) -> None:
    """The fitted pipeline, and beside it the zones' rooms as JSON."""
    model.write().overwrite().save(f"{path}/model")
    rows = sorted((zone_to_room or {}).items())
    spark.createDataFrame(rows, "zone string, room string").coalesce(1).write.mode("overwrite").json(f"{path}/zones")


def load_model(spark: SparkSession, path: str, labels: list[str]) -> tuple[PipelineModel, dict[str, str]]:
    """A saved model and its zones' rooms; a model saved without them maps each label to itself."""
    rooms = {r["zone"]: r["room"] for r in spark.read.schema("zone string, room string").json(f"{path}/zones").collect()}
    return PipelineModel.load(f"{path}/model"), rooms or {x: x for x in labels}


VERSIONS = "model_type string, version string, artifact_path string, active boolean, trained_at timestamp, metrics map<string, double>"


def register_model(spark: SparkSession, path: str, artifact: str, metrics: dict[str, float] | None = None, active: bool = True) -> str:
    """Add a saved model to the registry beside the models; returns its version, the time of training."""
    row = spark.createDataFrame([("random_forest", artifact, active, metrics or {})], "model_type string, artifact_path string, active boolean, metrics map<string, double>")
    row = row.withColumn("trained_at", F.current_timestamp()).withColumn("version", zones.version(F.col("trained_at")))
    own = row.select("model_type", "version", "artifact_path", "active", "trained_at", "metrics").collect()
    spark.createDataFrame(own, VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return own[0]["version"]


def resolve_model(spark: SparkSession, path: str) -> str | None:
    """The artifact to load: the newest active registered one that exists, else the last ``random_forest_v*`` by name, else none."""
    there = spark._jvm.org.apache.hadoop.fs.Path
    files = there(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(there(f"{path}/versions")):
        rows = spark.read.schema(VERSIONS).parquet(f"{path}/versions").where("active AND model_type = 'random_forest'")
        for r in rows.orderBy(F.desc("version")).collect():  # one row for each model trained
            if r["artifact_path"] and files.exists(there(r["artifact_path"])):
                return r["artifact_path"]
    found = sorted(f.getPath().toString() for f in files.globStatus(there(f"{path}/random_forest_v*")) or [])
    return found[-1] if found else None
