"""Kalman, features and floor model on small series with known results."""

import pytest
from pyspark.sql import functions as F

from wavefix.functions import signal
from wavefix.operators import features, floors, kalman
from wavefix.sources import layout

READING = "event_id long, beacon long, anchor_idx int, t double, rssi double"


def rows(spark, series, anchor=0):
    return spark.createDataFrame([(i, 1, anchor, float(t), float(v)) for i, (t, v) in enumerate(series)], READING)


def test_kalman_follows_a_still_beacon(spark):
    series = [(0, -64.18), (5, -63.84), (12.8, -63.52), (15, -64.0), (21.8, -64.31), (26, -63.7), (31, -64.1), (36, -63.9), (41, -64.05), (46, -63.75)]
    out = kalman.smoothed(rows(spark, series), r=1.0).orderBy("event_id").collect()
    assert abs(out[-1]["x"] - sum(v for _, v in series) / len(series)) < 1


def test_kalman_follows_movement(spark):
    v = [-50, -52, -55, -60, -67, -75, -82, -83, -84, -80, -72, -63, -55, -50]
    out = kalman.smoothed(rows(spark, [(3 * i, x) for i, x in enumerate(v)]), q=1.0, r=1.0).orderBy("event_id").collect()
    assert out[7]["x"] < -70 and out[-1]["x"] > -60
    assert any(r["v"] < 0 for r in out[3:7]) and any(r["v"] > 0 for r in out[9:13])


def test_kalman_starts_anew_after_a_gap(spark):
    out = kalman.smoothed(rows(spark, [(0, -65), (100, -80)]), stale=10).orderBy("event_id").collect()
    assert [r["x"] for r in out] == [-65, -80]


def test_snapshot_leaves_out_silent_anchors(spark):
    r = spark.createDataFrame([(0, 1, 0, 0.0, -65.0), (1, 1, 1, 0.0, -70.0), (2, 1, 1, 15.0, -71.0)], READING)
    assert [x["anchor_idx"] for x in kalman.snapshot(kalman.smoothed(r), stale=10).collect()] == [1]


@pytest.mark.parametrize(("values", "window", "expected"), [([-60, -70, -60, -70, -60], 5, 30.0), ([-65, -65, -65, -60, -70, -60], 3, 33.333), ([-65], 5, 0.0)])
def test_rolling_variance_counts_changes_only(spark, values, window, expected):
    out = features.variances(rows(spark, list(enumerate(values))), window).orderBy(F.desc("event_id")).first()
    assert out["variance"] == pytest.approx(expected, abs=1e-3)


def test_repeated_values_add_nothing_to_the_window(spark):
    out = features.variances(rows(spark, list(enumerate([-65, -65, -65, -70, -70, -70]))), 10).orderBy(F.desc("event_id")).first()
    assert out["n_window"] == 2


def test_best_floor_and_ratio(spark):
    vec = spark.createDataFrame([(1, 1, 1, 0.0, i, v, v, 0.0, 1) for i, v in enumerate([-80.0, -55.0, -60.0, -90.0])], "event_id long, beacon long, cycle long, t double, anchor_idx int, raw double, x double, age double, first_seen long")
    anchors = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 3)], "anchor_idx int, floor int")
    r = features.floor_signal(vec, anchors).first()
    assert (r["best_floor"], r["ratio"]) == (2, 27.5)


@pytest.mark.parametrize(("points", "expected"), [([(0, 0, 2), (3, 4, 2)], 5.0), ([(0, 0, 1), (0, 0, 2)], 1.0), ([(0, 0, 1)], 0.0)])
def test_displacement(spark, points, expected):
    p = spark.createDataFrame([(i, 1, float(i), float(x), float(y), f) for i, (x, y, f) in enumerate(points)], "event_id long, beacon long, t double, x double, y double, floor int")
    assert features.displacement(p).orderBy(F.desc("event_id")).first()["displacement_ft"] == expected


def test_belief_settles_on_the_heard_floor(spark):
    anchors = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, 3)], "anchor_idx int, floor int")
    vec = spark.createDataFrame([(c * 4 + i, 1, c, float(c), i, v, v, 0.0, 1) for c in range(1, 21) for i, v in enumerate([-50.0, -52.0, -68.0, -70.0])], "event_id long, beacon long, cycle long, t double, anchor_idx int, raw double, x double, age double, first_seen long")
    e = floors.emissions(vec.withColumn("event_id", F.col("cycle")), anchors, [1, 2, 3])
    last = floors.beliefs(e, layout.read(spark), first=1).orderBy(F.desc("event_id")).first()
    assert last["b2"] > 0.9 and last["floor"] == 2
    assert last["b1"] + last["b2"] + last["b3"] == pytest.approx(1)


def test_path_loss_and_labels(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "d double")
    out = [r[0] for r in d.select(signal.expected_rssi("d")).collect()]
    assert out[0] == out[1] > out[2]
    same, above = d.where("d = 10").select(signal.expected_rssi("d", F.lit(0)), signal.expected_rssi("d", F.lit(1))).first()
    assert same - above == pytest.approx(6)
    assert d.select(signal.battery_percent(F.lit(2555))).first()[0] == 56
