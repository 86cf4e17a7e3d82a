"""Sinks and file sources by round trip, and the filter's steps by their rules."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wavefix.operators import history, particles, space, survey, zones
from wavefix.sources import layout, readings, sinks


def test_positions_and_counts(spark, tmp_path):
    rows = readings.positions(spark, DATA)
    sinks.append_positions(rows, str(tmp_path / "p"))
    assert sinks.counts(spark, str(tmp_path / "p")) == rows.count()
    assert sinks.counts(spark, str(tmp_path / "p"), 3) == rows.where("beacon = 3").count()


def test_survey_csv_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1, 1, 2.0, 3.0, "den", "den_sofa"), (2, 2, 4.0, 5.0, None, "hall")], "point_id int, floor int, grid_x double, grid_y double, room string, zone string")
    samples = spark.createDataFrame([(1, "a_one", -60.5, 1.5), (1, "b_two", -70.0, 0.0), (2, "b_two", -55.25, 2.0)], "point_id int, anchor_id string, mean double, std double")
    sinks.survey_csv(points, samples, str(tmp_path / "s"))
    got = {(r["floor"], r["x"], r["room"], r["zone"], r["anchor_id"], r["rssi"], r["std"]) for r in readings.survey_csv(spark, str(tmp_path / "s")).collect()}
    assert got == {(1, 2.0, "den", "den_sofa", "a_one", -60.5, 1.5), (1, 2.0, "den", "den_sofa", "b_two", -70.0, 0.0), (2, 4.0, "hall", "hall", "b_two", -55.25, 2.0)}
    assert sinks.append_fingerprints(readings.survey_csv(spark, str(tmp_path / "s")), str(tmp_path / "f"), "imported") == 3
    assert {r["notes"] for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {"imported"}


def test_calibration_files(spark, tmp_path):
    for i, mean in enumerate((-66.0, -73.2)):
        doc = {"measurements": [{"distance_ft": 10.0 * (i + 1), "rssi_mean": mean, "rssi_std": 1.0, "n_samples": 5, "n_walls": i}]}
        (tmp_path / f"calibration_{i}.json").write_text(json.dumps(doc, indent=1))
    rows = readings.calibration_files(spark, str(tmp_path / "calibration_*.json"))
    assert {(r["distance_ft"], r["rssi_mean"], r["n_walls"]) for r in rows.collect()} == {(10.0, -66.0, 0), (20.0, -73.2, 1)}
    fit = survey.path_loss(rows.select("distance_ft", F.col("rssi_mean").alias("rssi"))).first()
    assert (fit["n"], fit["path_loss_n"]) == (2, 2.39)


def test_model_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(i, j, float(i % 2 * 10 + j)) for i in range(40) for j in range(3)], "sample_id int, idx int, value double")
    labels = spark.createDataFrame([(i, f"z{i % 2}") for i in range(40)], "sample_id int, label string")
    rows = zones.assembled(vectors, labels)
    model = zones.fitted(rows, trees=5, depth=3)
    sinks.save_model(spark, model, str(tmp_path / "m"), {"z0": "den"})
    again, rooms = sinks.load_model(spark, str(tmp_path / "m"), ["z0", "z1"])
    assert rooms == {"z0": "den"}
    want = {r["sample_id"]: r["predicted"] for r in zones.predicted(model, rows).collect()}
    assert {r["sample_id"]: r["predicted"] for r in zones.predicted(again, rows).collect()} == want == {i: f"z{i % 2}" for i in range(40)}
    versions = spark.createDataFrame([("random_forest", "20240101_000000", True), ("random_forest", "20250101_000000", False)], "model_type string, version string, active boolean")
    assert zones.resolve(versions).first()["version"] == "20240101_000000"


def test_augmentation_sizes(spark):
    """(1 + factor) x N rows; the originals are kept, absent strengths stay absent, labels end up equal."""
    rows = [(i, a, -100.0 if a == 2 else -60.0 - i) for i in range(10) for a in range(3)]
    samples = spark.createDataFrame(rows, "sample_id int, anchor_idx int, rssi double")
    out = survey.augmented(samples, 3)
    assert out.count() == 30 * 4
    assert {tuple(r) for r in out.where("copy = 0").select("sample_id", "anchor_idx", "rssi").collect()} == set(rows)
    assert {r["rssi"] for r in out.where("anchor_idx = 2").collect()} == {-100.0}
    labels = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "sample_id int, label string")
    extra = survey.oversampled(out, labels)
    got = {r["label"]: r["n"] for r in extra.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"b": 3 * 4 * (7 - 3)}
    assert {r["rssi"] for r in extra.where("anchor_idx = 2").collect()} == {-100.0}


def test_particles_around_a_point_are_walkable(spark):
    cells = space.grid(layout.read(spark)).coalesce(1).cache()
    ids = spark.range(200).select(F.lit(1).alias("beacon"), F.col("id").alias("pid"))
    out = particles.around(ids, cells, 10.0, 10.0, 2, 3.0)
    a = space.grid_arrays(cells)
    good = out.join(a, "floor").where(space.is_walkable(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max"))).agg(F.count(F.lit(1)), F.avg("x"), F.avg("y")).first()
    assert good[0] == 200 and abs(good[1] - 10) < 5 and abs(good[2] - 10) < 5


def test_history_windows(spark):
    rows = spark.createDataFrame([(i, float(i * 60)) for i in range(1000)], "event_id int, t double")
    assert history.window(rows, 1).count() == 61 and history.window(rows, 24).count() == 1000


def test_csv_import(spark, tmp_path):
    points = spark.createDataFrame([(1, 1, 2.0, 3.0, "den", "den_sofa", "poi"), (2, 2, 4.0, 5.0, None, "hall", None)], "point_id int, floor int, grid_x double, grid_y double, room string, zone string, point_type string")
    samples = spark.createDataFrame([(1, "a_one", -60.5, 1.5), (1, "b_two", -70.0, 0.0), (2, "b_two", -55.25, 2.0)], "point_id int, anchor_id string, mean double, std double")
    sinks.survey_csv(points, samples, str(tmp_path / "s"))
    assert sinks.import_csv(spark, str(tmp_path / "s"), str(tmp_path / "f")) == 2
    got = {r["location"]: (r["room"], r["rssi"], r["std"], r["notes"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert got == {"den_sofa": ("den", {"a_one": -60.5, "b_two": -70.0}, {"a_one": 1.5, "b_two": 0.0}, "imported from CSV; point_type=poi"), "hall": ("hall", {"b_two": -55.25}, {"b_two": 2.0}, "imported from CSV; point_type=grid")}


def test_model_registry(spark, tmp_path):
    """The active model that exists, else the last by name, else none."""
    at = str(tmp_path)
    assert sinks.resolve_model(spark, at) is None
    for name in ("random_forest_v20240101_000000", "random_forest_v20250101_000000"):
        (tmp_path / name).mkdir()
    assert sinks.resolve_model(spark, at).endswith("random_forest_v20250101_000000")
    sinks.register_model(spark, at, f"{at}/gone")
    assert sinks.resolve_model(spark, at).endswith("random_forest_v20250101_000000")
    version = sinks.register_model(spark, at, f"{at}/random_forest_v20240101_000000", {"accuracy": 0.9})
    assert len(version) == 15 and sinks.resolve_model(spark, at) == f"{at}/random_forest_v20240101_000000"


def test_forest_on_enlarged_samples(spark):
    """Training samples are (1 + factor) times as many and balanced; folds are as many as the rarest label allows."""
    vectors = spark.createDataFrame([(i, j, float(-60 - 20 * (i % 3 == 0) if j < 2 else j)) for i in range(12) for j in range(4)], "sample_id int, idx int, value double").cache()
    labels = spark.createDataFrame([(i, f"z{int(i % 3 == 0)}") for i in range(12)], "sample_id int, label string").cache()
    rows = zones.enlarged(vectors, labels, 2, 3).cache()
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {"z0": 32, "z1": 32}
    assert {(len(r["features"]), r["features"][2], r["features"][3]) for r in rows.collect()} == {(4, 2.0, 3.0)}
    fold = zones.folds(labels, 4).groupBy("fold", "label").count().collect()
    assert sorted((r["label"], r["count"]) for r in fold) == [("z0", 2)] * 4 + [("z1", 1)] * 4
    out = zones.cross_validated(vectors, labels, 2, 5, trees=10, depth=4).collect()
    assert len(out) == 12 and sum(r["label"] == r["predicted"] for r in out) >= 10
    names = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "idx int, name string")
    top = zones.importances(zones.fitted(rows, trees=10, depth=4), names, 2).collect()
    assert {r["name"] for r in top} == {"f0", "f1"}
    alone = spark.createDataFrame([(0, "z1"), (1, "z0"), (2, "z0")], "sample_id int, label string")
    assert len(zones.cross_validated(vectors, alone, 2, trees=5, depth=3).collect()) == 3


def test_trees_split_as_plain_search_does():
    """The first split is the best of the chosen features, leaves keep their least rows, and deep trees know what can be known."""
    import numpy as np

    from wavefix.operators import forest

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, (300, 4)).astype(np.uint8), rng.integers(0, 3, 300)
    y[x[:, 2] > 3] = 1
    count = rng.poisson(1.0, 300).astype(float)
    total = np.bincount(y, count, 3)[None]

    def gain(f, b):
        left, right = (np.bincount(y[m], count[m], 3) for m in (x[:, f] <= b, x[:, f] > b))
        return -1.0 if min(left.sum(), right.sum()) < 3 else (left**2).sum() / left.sum() + (right**2).sum() / right.sum()

    for chosen in ([0, 1, 2, 3], [0, 1], [3]):
        (f,), (b,) = forest._split(x, y, count, np.zeros(300, int), total, np.isin(np.arange(4), chosen)[None], 3)
        assert gain(f, b) == pytest.approx(max(gain(i, j) for i in chosen for j in range(6)))
    one, two = (forest.grown(x, y, 3, np.random.default_rng(1), 30, 3) for _ in range(2))
    assert all((getattr(one, n) == getattr(two, n)).all() for n in ("feature", "bin", "left", "share"))
    assert (one.answers(x).argmax(1) == y)[x[:, 2] > 3].mean() > 0.9 and np.allclose(one.share.sum(1), 1)
    assert len(forest.grown(x, y, 3, np.random.default_rng(1), 0, 3).left) == 1


def test_cross_validation_grows_trees_in_tasks(spark, monkeypatch):
    """Training sets that fit a task need no forest of Spark's, and give the same twice; larger ones still get it."""
    vectors = spark.createDataFrame([(i, j, float(-60 - 20 * (i % 3 == 0) - i % 5 if j < 2 else j)) for i in range(30) for j in range(4)], "sample_id int, idx int, value double").repartition(3).cache()
    labels = spark.createDataFrame([(i, f"z{int(i % 3 == 0)}") for i in range(30)], "sample_id int, label string").cache()
    run = lambda: sorted(map(tuple, zones.cross_validated(vectors, labels, 2, 3, 2, trees=12, depth=4).collect()))
    spark_s = zones.fitted

    def refused(*a, **b):
        raise AssertionError("Spark's forest was fitted")

    monkeypatch.setattr(zones, "fitted", refused)
    got = run()
    assert got == run() and len(got) == 30 and sum(r[1] == r[2] for r in got) >= 27
    monkeypatch.setattr(zones, "fitted", spark_s)
    monkeypatch.setattr(zones, "LOCAL", 0)
    assert sum(r[1] == r[2] for r in run()) >= 27
