"""Prefix products against plain folds, whatever the blocks; one key's series runs in several tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.operators import floors, kalman, prefix, zones
from wavefix.plans import archive, signals
from wavefix.sources import layout

BLOCKS = [0.5, 7.0, 60.0, 1e9]


def series(seed=1, n=900):
    """(event_id, beacon, anchor_idx, t, rssi): bursts, ties in time, gaps beyond staleness, one long series."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0.0, 0.05, 0.24, 0.25, 0.3, 1.0, 31.0, 200.0], n, p=[0.1, 0.2, 0.15, 0.15, 0.2, 0.15, 0.04, 0.01]))
    beacon = rng.choice([1, 2, 3, 9], n, p=[0.7, 0.2, 0.09, 0.01])
    return pd.DataFrame({"event_id": np.arange(n) + (1 << 60), "beacon": beacon, "anchor_idx": rng.integers(0, 3, n).astype("int32"), "t": t, "rssi": rng.normal(-70, 8, n)})


@pytest.mark.parametrize("block_s", BLOCKS)
def test_filter_equals_live_steps(spark, block_s):
    rows = series()
    want, state = {}, {}
    for r in rows.itertuples():
        s = state[r.beacon, r.anchor_idx] = kalman.step(state.get((r.beacon, r.anchor_idx)), r.t, r.rssi)
        want[r.event_id] = s
    got = kalman.smoothed(spark.createDataFrame(rows).repartition(3), block_s).collect()
    assert len(got) == len(rows)
    assert all(np.allclose([r["t"], r["x"], r["v"], r["p00"], r["p01"], r["p11"]], want[r["event_id"]], rtol=1e-9, atol=1e-9) for r in got)


@pytest.mark.parametrize("block_s", BLOCKS)
def test_throttle_equals_a_fold(spark, block_s):
    rows = series(2)
    want, last = set(), {}
    for r in rows.sort_values(["t", "event_id"]).itertuples():
        if r.beacon not in last or r.t - last[r.beacon] >= K.MIN_INTERVAL_S:
            last[r.beacon] = r.t
            want.add((r.beacon, r.event_id, r.t))
    assert {tuple(r) for r in signals.throttle(spark.createDataFrame(rows).repartition(3), block_s=block_s).collect()} == want and len(want) < len(rows)


@pytest.mark.parametrize("block_s", BLOCKS)
def test_smoothing_equals_a_fold(spark, block_s):
    rng = np.random.default_rng(5)
    rows = series(3)[["event_id", "beacon", "t"]].assign(label=rng.choice(["a", "b"], 900, p=[0.9, 0.1]), activity=rng.choice(["moving", "sleeping", None], 900), confidence=rng.random(900))
    want, state = {}, {}
    for r in rows.sort_values(["t", "event_id"]).itertuples():
        label, p = state.get(r.beacon, (None, 0.0))
        p = r.confidence if label != r.label else p + archive.FOLLOW.get(r.activity, 0.05) * (r.confidence - p)
        state[r.beacon], want[r.event_id] = (r.label, p), p
    got = {r["event_id"]: r["p"] for r in archive.zone_smoothed_rows(spark.createDataFrame(rows), block_s).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def fold(rows, names, ways, first=None):
    """Beliefs by one step after another."""
    want, state = {}, {}
    for r in rows.sort_values(["t", "event_id"]).itertuples():
        then, b = state.get(r.beacon, (None, {g: 1 / len(names) if first is None else float(g == first) for g in names}))
        off = min(K.HMM_RATE * (K.DEFAULT_DT if then is None else min(r.t - then, K.MAX_DT)), K.HMM_MAX_OFF)
        p = dict.fromkeys(names, 0.0)
        for f in names:
            to = [y for x, y in ways if x == f]
            p[f] += b[f] * (1 - off * len(to))
            for g in to:
                p[g] += b[f] * off
        q = {g: p[g] * getattr(r, f"e{g}") for g in names}
        total = sum(q.values())
        state[r.beacon] = r.t, {g: v / total for g, v in q.items()}
        want[r.event_id] = state[r.beacon][1]
    return want


@pytest.mark.parametrize("names, ways", [([1, 2, 3], [(1, 2), (2, 1), (2, 3), (3, 2)]), ([0, 4, 5, 9], [(0, 4), (4, 0), (4, 5), (5, 4), (4, 9), (9, 4)]), ([7], [])])
def test_beliefs_of_any_floors_equal_a_fold(spark, names, ways):
    rng = np.random.default_rng(8)
    rows = series(4)[["event_id", "beacon", "t"]]
    e = rng.dirichlet(np.full(len(names), 0.5), len(rows))
    rows = rows.assign(**{f"e{g}": e[:, i] for i, g in enumerate(names)})
    for first in (None, names[0]):
        want = fold(rows, names, ways, first)
        for block_s in (3.0, 1e9):
            out = prefix.prefixed(spark.createDataFrame(rows), ["beacon"], ["t", "event_id"], floors.Steps(names, ways, first), ["event_id"], block_s).collect()
            assert len(out) == len(want)
            assert all(r[f"b{g}"] == pytest.approx(want[r["event_id"]][g], abs=1e-9) for r in out for g in names)


def test_certain_first_floor(spark):
    """A beacon that starts on a known floor, by the plan's own floors and ways."""
    plan = layout.read(spark)
    rows = pd.DataFrame([(1, 1, 0.0, 0.4, 0.3, 0.3), (2, 1, 5.0, 0.3, 0.4, 0.3)], columns=["event_id", "beacon", "t", "e1", "e2", "e3"])
    want = fold(rows, [1, 2, 3], [(1, 2), (2, 1), (2, 3), (3, 2)], 2)
    for r in floors.beliefs(spark.createDataFrame(rows), plan, first=2).collect():
        assert [r["b1"], r["b2"], r["b3"]] == pytest.approx([want[r["event_id"]][g] for g in (1, 2, 3)]) and r["floor"] == 2


def test_one_series_runs_in_several_tasks(spark):
    rows = pd.DataFrame({"event_id": range(4000), "beacon": 1, "anchor_idx": np.int32(0), "t": np.arange(4000) * 0.5, "rssi": -60.0})
    out = kalman.smoothed(spark.createDataFrame(rows), 50.0).withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select("part").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_of_odd_lengths():
    rng = np.random.default_rng(0)
    use = zones.Following()
    for n in (1, 2, 3, 4, 5, 17, 64):
        steps, first = rng.random((n, 2)), rng.random(n) < 0.3
        want, at = [], use.identity()[None]
        for i in range(n):
            at = steps[i : i + 1] if first[i] else use.combine(at, steps[i : i + 1])
            want.append(at[0])
        assert np.allclose(prefix.scan(steps, first, use.combine), want)


def test_empty_tables(spark):
    assert kalman.smoothed(spark.createDataFrame(series()).limit(0)).count() == 0
    assert signals.throttle(spark.createDataFrame(series()).limit(0)).count() == 0
