"""Quantiles without a group in one task, as-of rows of heard anchors only, polygons found by cells, fits of several files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefix.operators import features, history, space, survey
from wavefix.sources import layout


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(history, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    groups = {
        "skewed": np.exp(rng.normal(0, 6, 700)), "tied": np.repeat([1.0, 2.0, 2.0, 9.0], 60), "one": np.array([3.5]), "two": np.array([-1.0, 4.0]), "same": np.full(50, -7.25),
        "far": np.concatenate((np.full(400, 1e-9), [1e300, -1e300], rng.random(99))), None: rng.normal(0, 1, 90),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("nulls", None)]
    at = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: [r[f"q{i}"] for i in range(len(at))] for r in history.quantiles(df, ["g"], "v", at).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, at).tolist(), rel=1e-12, abs=1e-12), k


def test_quantiles_of_no_rows(spark):
    assert history.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0


def test_cycles_meet_only_anchors_heard_so_far(spark):
    """Two beacons in a plan of many anchors: rows are those of the anchors each has heard, and the plan of the query makes no others."""
    rows = [(1, 1, 900, 0.0, -50.0), (2, 1, 7, 1.0, -51.0), (3, 1, 900, 2.0, -52.0), (4, 2, 123456, 5.0, -60.0)]
    r = spark.createDataFrame(rows, "event_id long, beacon long, anchor_idx int, t double, rssi double")
    got = {(x["event_id"], x["anchor_idx"]): (x["raw"], x["age"], x["first_seen"]) for x in features.vectors(features.cycles(r)).collect()}
    assert got == {(1, 900): (-50.0, 0.0, 1), (2, 900): (-50.0, 1.0, 1), (2, 7): (-51.0, 0.0, 2), (3, 900): (-52.0, 0.0, 1), (3, 7): (-51.0, 1.0, 2), (4, 123456): (-60.0, 0.0, 1)}


@pytest.mark.parametrize("size", [0.7, 2.0, 500.0])
def test_polygons_are_found_by_cells(spark, size):
    """Rooms by any size of cell equal those by a test of all polygons in order."""
    plan = layout.read(spark)
    rng = np.random.default_rng(2)
    corners = [(r["floor"], p[0], p[1]) for r in layout.rooms(plan).collect() for p in r["poly"]]
    spots = corners + [(int(f), float(x), float(y)) for f, x, y in zip(rng.integers(1, 5, 400), rng.uniform(-2, 20, 400), rng.uniform(-2, 32, 400), strict=True)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "pid long, floor int, x double, y double")
    rooms = layout.rooms(plan).select(F.col("floor").alias("f"), "room_pos", F.col("room").alias("r"), "poly")
    tested = points.join(rooms, (F.col("floor") == F.col("f")) & space.in_polygon(F.col("poly"), F.col("x"), F.col("y"))).groupBy("pid").agg(F.min_by("r", "room_pos").alias("r"))
    want = {r["pid"]: r["r"] or "unknown" for r in points.join(tested, "pid", "left").collect()}
    assert {r["pid"]: r["room"] for r in space.labelled(points, plan, size).collect()} == want and len(set(want.values())) > 5


def test_unknown_floors_are_not_walkable(spark):
    plan = layout.read(spark)
    points = spark.createDataFrame([(1, 1, 8.0, 12.0), (2, 9, 8.0, 12.0), (3, None, 8.0, 12.0), (4, 1, -1.0, 12.0)], "pid long, floor int, x double, y double")
    got = {r["pid"]: r["walkable"] for r in space.walkable_at(points, space.grid(plan)).collect()}
    assert got.keys() == {1, 2, 3, 4} and not got[2] and not got[3] and not got[4]


def test_fits_of_files_and_residuals(spark):
    d = np.array([1.0, 2.0, 5.0, 9.0, 20.0, 33.0])
    rows = [(i, f, float(x), float(-60 - 25 * np.log10(x * 0.3048) + f + (i % 3 - 1))) for f in (0, 1) for i, x in enumerate(d)] + [(9, 2, 5.0, -70.0)]
    s = spark.createDataFrame(rows, "key long, file long, distance_ft double, rssi double")
    fits = {r["file"]: r for r in survey.file_fits(s).collect()}
    for file, rows_ in ((0, rows[:6]), (1, rows[6:12]), (None, rows)):
        u, y = np.log10(np.array([r[2] for r in rows_]) * 0.3048), np.array([r[3] for r in rows_])
        b, a = np.polyfit(u, y, 1)
        assert (fits[file]["tx_power"], fits[file]["path_loss_n"], fits[file]["rmse"]) == (round(a, 1), round(-b / 10, 2), pytest.approx(np.sqrt(np.mean((y - a - b * u) ** 2)), abs=0.0051))
    assert (fits[2]["tx_power"], fits[2]["path_loss_n"], fits[2]["n"]) == (-66.0, 2.4, 1)
    left = {r["key"]: r["residual"] for r in survey.residuals(s.where("file = 0")).collect()}
    u, y = np.log10(d * 0.3048), np.array([r[3] for r in rows[:6]])
    b, a = np.polyfit(u, y, 1)
    assert all(left[i] == pytest.approx(y[i] - a - b * u[i], abs=0.0051) for i in range(6))
    assert survey.residuals(s.where("file = 2")).count() == 0
