"""The floor plan: known open and blocked points, rays, labels, elevation."""

import pytest
from pyspark.sql import functions as F

from wavefix.operators import particles, space
from wavefix.sources import layout


@pytest.fixture(scope="module")
def plan(spark):
    return layout.read(spark)


@pytest.fixture(scope="module")
def cells(spark, plan):
    return space.grid(plan).coalesce(1).cache()


def _points(spark, points):
    return spark.createDataFrame([(i, f, float(x), float(y)) for i, (f, x, y) in enumerate(points)], "pid long, floor int, x double, y double")


def test_grid_has_the_expected_cells(cells):
    assert cells.where("floor = 1").agg(F.max("col"), F.max("row")).first()[:] == (35, 58)


OPEN = [(1, 3.75, 6.5), (2, 10, 14), (2, 2.37, 26.86), (3, 12, 8), (1, 5.7, 11.31), (1, 1.47, 20.1), (2, 1.48, 10.27), (2, 1.48, 20.8), (2, 3.51, 24.32), (3, 5.51, 24.04), (3, 6.89, 21.34), (3, 6.89, 12.7)]
BLOCKED = [(1, 12, 13), (1, -1, 15), (1, 20, 15), (2, 10, 28.5), (2, 12, 22), (2, 17, 4), (3, 13, 15.5), (3, 1.5, 22.5)]


def test_known_points(spark, cells):
    a = space.grid_arrays(cells)
    p = _points(spark, OPEN + BLOCKED).join(a, "floor")
    got = {r["pid"]: r["ok"] for r in p.select("pid", space.is_walkable(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max")).alias("ok")).collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(OPEN) + [False] * len(BLOCKED)


def test_known_rays(spark, cells):
    rays = [(3, 4, 27, 12, 27, False), (1, 1.5, 10, 1.5, 12, False), (1, 3.5, 6, 12, 6, False), (2, 14, 5, 17.5, 3, False), (1, 5.7, 10, 5.7, 12, True), (2, 6, 5, 14, 12, True)]
    df = spark.createDataFrame([(i, f, *map(float, r)) for i, (f, *r, _) in enumerate(rays)], "pid long, floor int, x double, y double, tx double, ty double")
    got = {r["pid"]: r["clear"] for r in space.rays(df, space.grid_arrays(cells)).collect()}
    assert [got[i] for i in range(len(rays))] == [r[-1] for r in rays]


def test_gate_splits_the_large_room(spark, plan):
    got = {r["pid"]: (r["room"], r["zone"]) for r in space.labelled(_points(spark, [(2, 8, 20.73), (2, 8, 20.72), (2, -3, 0)]), plan).collect()}
    assert got == {0: ("living_kitchen", "kitchen"), 1: ("living_kitchen", "living_room"), 2: ("unknown", "unknown")}


def test_elevation_along_the_stairs(spark, plan):
    got = {r["pid"]: r["z"] for r in particles.elevation(_points(spark, [(1, 1.5, 12), (1, 1.5, 20), (1, 1.5, 11.31), (1, 5, 12)]), plan).collect()}
    assert [round(got[i], 2) for i in range(4)] == [7.21, 0.09, 7.82, 0.0]


def test_polygons_from_both_forms(spark):
    df = spark.createDataFrame([('{"x1": 0, "y1": 10, "x2": 3, "y2": 20}',), ("[[0,0],[1,0],[1,1],[0,1],[0,0]]",)], "b string")
    got = [r[0] for r in df.select(layout.polygon(F.col("b"))).collect()]
    assert got[0] == [[0, 10], [3, 10], [3, 20], [0, 20]] and len(got[1]) == 4


def test_floors_join_by_stairs_only(plan):
    assert sorted((r[0], r[1]) for r in layout.adjacency(plan).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_resampling_keeps_the_likely_ones(spark):
    c = spark.createDataFrame([(0, 0.01), (1, 0.01), (2, 0.01), (3, 0.97)], "pid long, w double")
    got = particles.resampled(c, 100, 0.5).collect()
    assert sorted(r["slot"] for r in got) == list(range(100))
    assert sum(r["pid"] == 3 for r in got) == 97
    assert particles.n_eff(c.withColumn("w", F.lit(0.25))).first()[0] == pytest.approx(4)


def test_tracker_finds_a_still_beacon(spark, plan, cells):
    """A beacon at a known place on the second floor is found there."""
    import numpy as np

    from wavefix.functions import constants as K
    from wavefix.streaming import cycle

    rng, anchors = np.random.default_rng(7), layout.anchors(plan).collect()
    rows = []
    for i in range(300):
        a = anchors[i % 9]
        d = max(1.0, ((7 - a["ax"]) ** 2 + (10 - a["ay"]) ** 2 + (8.75 - a["az"]) ** 2) ** 0.5)
        rows.append((i, 1, a["anchor_idx"], i * 0.3, float(K.TX_POWER_DBM - 24 * np.log10(d * 0.3048) - 6 * abs(a["floor"] - 2) + rng.normal(0, 2))))
    out = cycle.trajectories(spark.createDataFrame(rows, "event_id long, beacon long, anchor_idx int, t double, rssi double"), plan, cells).orderBy(F.desc("event_id")).first()
    assert out["floor"] == 2 and ((out["x"] - 7) ** 2 + (out["y"] - 10) ** 2) ** 0.5 < 8


def test_tracker_sees_the_house_as_the_steps_do(spark, plan, cells):
    """Ways, walls towards anchors and heights of the fold equal those of the step operators."""
    import numpy as np

    from wavefix.operators import beacon

    rng = np.random.default_rng(3)
    n = 400
    x, y, f = rng.uniform(0, 17.7, n), rng.uniform(0, 29.39, n), rng.integers(1, 4, n)
    x[:120] = rng.uniform(0, 3, 120)
    tx, ty = np.clip(x + rng.normal(0, 4, n), 0, 17.7), np.clip(y + rng.normal(0, 4, n), 0, 29.39)
    points = spark.createDataFrame([(i, int(f[i]), *(float(v[i]) for v in (x, y, tx, ty))) for i in range(n)], "pid long, floor int, x double, y double, tx double, ty double")
    house = beacon.House.of(plan, cells)
    ways = {r["pid"]: r["clear"] for r in space.rays(points, space.grid_arrays(cells)).collect()}
    assert house.way_open(x, y, tx, ty, f).tolist() == [ways[i] for i in range(n)] and len(set(ways.values())) == 2
    z = {r["pid"]: r["z"] for r in particles.elevation(points, plan).collect()}
    assert np.allclose(house.height(x, y, f), [z[i] for i in range(n)]) and len(set(z.values())) > 3
    snapped = space.nearest_walkable(layout.anchors(plan).select(F.col("anchor_idx").alias("key"), "floor", F.col("ax").alias("x"), F.col("ay").alias("y")), cells)
    walls = space.in_cells(points, cells).join(space.anchor_rays(cells, snapped), ["floor", "row", "col"]).collect()
    row, col = house.cell(x, y, f)
    assert len(walls) > n and all(house.walls[r["anchor_idx"]][row[r["pid"]], col[r["pid"]]] == r["n_walls"] for r in walls)


def test_tracker_waits_on_a_floor_without_a_way_back(spark, plan, cells):
    """Particles beside a stairway change floor by the belief alone, and only where the other floor has an entry back."""
    import dataclasses

    import numpy as np

    from wavefix.operators import beacon

    house = beacon.House.of(plan, cells)
    a, b, ex, ey = house.stairs[0]
    for stairs, can in ((house.stairs, True), (house.stairs[:1], False)):
        f = beacon.Beacon(dataclasses.replace(house, stairs=stairs), 1)
        f.start()
        f.x, f.y, f.floor = np.full(f.n, ex), np.full(f.n, ey), np.full(f.n, a)
        f.belief = {g: float(g == b) for g in f.floors}
        f._move({}, 0.5)
        assert (f.floor == b).any() == can and ((f.floor == b) == (f.cooldown > 0)).all()
        f.belief = {g: 0.0 for g in f.floors}
        f.floor, f.cooldown = np.full(f.n, a), np.zeros(f.n)
        f._move({}, 0.5)
        assert (f.floor == a).all()
