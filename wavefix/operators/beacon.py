"""One beacon's cycle: what a beacon holds between readings, and what a reading does to it.

The particle filter, the floor model and the smoothed strengths depend on each other's last step, so a beacon's
cycles follow one another; beacons are independent. A beacon's state has a fixed size, and the draws
of a cycle are seeded by the beacon and the number of its cycle, so that a reading that is played again does the
same. ``streaming.cycle`` keeps the state in Spark's state store and deals beacons to tasks.

A step's rules are a ``Fleet``'s: it moves the clouds of several beacons on side by side, whole arrays at a time. A live
beacon is a fleet of one; over a table as many go together as a task has. Which others go along changes no beacon's results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.operators import features, kalman, space
from wavefix.sources import layout


#: The most pairs of cells that a house remembers the ways between.
WAYS = 1 << 26


@dataclass(frozen=True)
class House:
    """The floor plan as arrays, filled from the tables the step operators use; its size does not depend on the data.

    ``free`` and ``walls`` (from each cell to each snapped anchor of its floor) have one layer for each of ``floors``.
    """

    floors: np.ndarray
    size: np.ndarray
    box: np.ndarray
    free: np.ndarray
    walls: dict[int, np.ndarray]
    anchors: dict[int, tuple[int, float, float, float]]
    stairs: list[tuple[int, int, float, float]]
    elevation: np.ndarray
    runs: dict[int, list[tuple[float, float, float, float]]]
    beside: np.ndarray

    @classmethod
    def of(cls, plan: DataFrame, cells: DataFrame, walls: DataFrame | None = None) -> House:
        if walls is None:
            at = layout.anchors(plan).select(F.col("anchor_idx").alias("key"), "floor", F.col("ax").alias("x"), F.col("ay").alias("y"))
            walls = space.anchor_rays(cells, space.nearest_walkable(at, cells))
        dims = layout.floors(plan).join(layout.staircase_bounds(plan).withColumnRenamed("x_max", "beside"), "floor", "left").orderBy("floor").collect()
        floors = np.array([r["floor"] for r in dims])
        grids = {r["floor"]: np.array(r["free"], bool).reshape(r["h"], r["w"]) for r in space.grid_arrays(cells).collect()}
        size = np.array([grids[f].shape for f in floors])
        free = np.zeros((len(floors), *size.max(axis=0)), bool)
        for i, f in enumerate(floors):
            free[i, : size[i, 0], : size[i, 1]] = grids[f]
        anchors = {r["anchor_idx"]: (r["floor"], r["ax"], r["ay"], r["az"]) for r in layout.anchors(plan).collect()}
        counts = {a: np.zeros(free.shape[1:], np.int16) for a in anchors}
        for r in walls.collect():
            counts[r["anchor_idx"]][r["row"], r["col"]] = r["n_walls"]
        stairs = [(r["from_floor"], r["to_floor"], r["ex"], r["ey"]) for r in layout.stairs(plan).orderBy("stair_pos").collect()]
        runs: dict[int, list[tuple[float, float, float, float]]] = {}
        for r in layout.runs(plan).orderBy("run_pos").collect():
            runs.setdefault(r["floor"], []).append((r["low_z"], r["high_z"], r["entry_y_low"], r["entry_y_high"]))
        beside = np.array([np.nan if r["beside"] is None else r["beside"] for r in dims], float)
        return cls(floors, size, np.array([(r["x_max"], r["y_max"]) for r in dims]), free, counts, anchors, stairs, np.array([r["elevation"] or 0.0 for r in dims]), runs, beside)

    def __getstate__(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}  # tables made of these are made anew where they are needed

    @cached_property
    def adjacent(self) -> np.ndarray:
        """Which layers a stairway joins."""
        out = np.zeros((len(self.floors),) * 2, bool)
        for a, b, *_ in self.stairs:
            i, j = self.layer(np.array([a, b]))
            out[i, j] = out[j, i] = True
        return out

    @cached_property
    def losses(self) -> dict[int, np.ndarray]:
        """By anchor, what floors and walls take from its strength in each cell."""
        out = {}
        for a, (f, *_) in self.anchors.items():
            loss = np.zeros(self.free.shape) + (K.FLOOR_ATTENUATION_DB * abs(self.floors - f))[:, None, None]
            loss[self.floors == f] += K.WALL_ATTENUATION_DB * self.walls[a]
            out[a] = loss.ravel()
        return out

    @cached_property
    def _known(self) -> np.ndarray | None:
        """For each two cells of a floor whether the way is open, -1 where nobody has asked; None if that were too large."""
        layers, rows, cols = self.free.shape
        return np.full(layers * (rows * cols) ** 2, -1, np.int8) if layers * (rows * cols) ** 2 <= WAYS else None

    def layer(self, floor: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.floors, floor)

    def cell(self, x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column: truncated, then clamped to the floor's grid."""
        return self.cell_in(x, y, self.layer(floor))

    def cell_in(self, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.clip((y / K.GRID_FT).astype(int), 0, self.size[:, 0][i] - 1), np.clip((x / K.GRID_FT).astype(int), 0, self.size[:, 1][i] - 1)

    def way_open(self, x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Are all of Bresenham's cells from one point to another walkable?"""
        return self.cells_open(self.layer(floor), *self.cell(x, y, floor), *self.cell(tx, ty, floor))

    def cells_open(self, i: np.ndarray, r: np.ndarray, c: np.ndarray, r1: np.ndarray, c1: np.ndarray) -> np.ndarray:
        """The same of cells of layers; a way between two cells is walked once."""
        if self._known is None:
            return self._walked(i, r, c, r1, c1)
        _, rows, cols = self.free.shape
        at = ((i * rows + r) * cols + c) * (rows * cols) + r1 * cols + c1
        out = self._known[at]
        if (new := np.flatnonzero(out < 0)).size:
            out[new] = self._known[at[new]] = self._walked(*(v[new] for v in (i, r, c, r1, c1)))
        return out > 0

    def _walked(self, i: np.ndarray, r: np.ndarray, c: np.ndarray, r1: np.ndarray, c1: np.ndarray) -> np.ndarray:
        dr, dc, sr, sc = abs(r1 - r), abs(c1 - c), np.where(r < r1, 1, -1), np.where(c < c1, 1, -1)
        err, length, good = dc - dr, np.maximum(dr, dc), np.ones(len(r), bool)
        for n in range(int(length.max(initial=0)) + 1):
            good &= (n > length) | self.free[i, r, c]
            go_c, go_r = (2 * err > -dr) & (n < length), (2 * err < dc) & (n < length)
            err = err - np.where(go_c, dr, 0) + np.where(go_r, dc, 0)
            r, c = r + np.where(go_r, sr, 0), c + np.where(go_c, sc, 0)
        return good

    def height(self, x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The floor's height, or along the first stair run that spans y when beside the staircase."""
        return self.height_in(x, y, self.layer(floor))

    def height_in(self, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> np.ndarray:
        out, beside = self.elevation[i], np.nonzero(x <= self.beside[i])
        y, floor, z = y[beside], self.floors[i[beside]], out[beside]
        todo = np.ones(len(y), bool)
        for f, parts in self.runs.items():
            for low, high, y_low, y_high in parts:
                on = todo & (floor == f) & (y >= min(y_low, y_high)) & (y <= max(y_low, y_high))
                if y_low != y_high:
                    z[on] = low + np.clip((y_low - y[on]) / (y_low - y_high), 0, 1) * (high - low)
                todo &= ~on
        out[beside] = z
        return out

    def near_stairs(self, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How much likelier leaving the floor is at places of layers: by the nearest stair entry."""
        d = np.full(len(x), np.inf)
        for a, _, ex, ey in self.stairs:
            d = np.where(self.floors[i] == a, np.minimum(d, np.hypot(x - ex, y - ey)), d)
        return 1 + (K.HMM_STAIR_BOOST - 1) / (1 + (d / K.HMM_STAIR_RADIUS_FT) ** 2)

    def draw(self, n: int, floors: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        layers, rows, cols = np.nonzero(self.free & np.isin(self.floors, floors)[:, None, None])
        pick = rng.integers(0, len(rows), n)
        return (cols[pick] + 0.5) * K.GRID_FT, (rows[pick] + 0.5) * K.GRID_FT, self.floors[layers[pick]]


@dataclass
class Heard:
    """What is known of one anchor: its newest reading, the filter's state after it, the strength at the last cycle, and its last changed strengths."""

    event_id: int
    t: float
    raw: float
    state: tuple[float, ...]
    was: float | None = None
    past: list[float] = field(default_factory=list)

    @property
    def x(self) -> float:
        return self.state[1]


class Beacon:
    """State of one beacon: strengths by anchor, particles, floor belief, and the clock of its cycles."""

    def __init__(self, house: House, number: int, n: int = K.PARTICLES):
        self.house, self.number, self.n = house, number, n
        self.floors = [int(f) for f in house.floors]
        self.heard: dict[int, Heard] = {}
        self.last: float | None = None
        self.cycles, self.late, self.hold = 0, 0, 0.0
        self.recent: list[tuple[float, float, int]] = []
        self.belief = dict.fromkeys(self.floors, 1 / len(self.floors))
        self.w = np.empty(0)
        self.rng = np.random.default_rng(0)

    def start(self) -> None:
        """Particles at walkable cells of all floors."""
        self.rng = np.random.default_rng([abs(self.number), 0])
        self.x, self.y, self.floor = self.house.draw(self.n, self.house.floors, self.rng)
        self.w, self.cooldown = np.full(self.n, 1 / self.n), np.zeros(self.n)

    def taken(self, event_id: int, anchor: int, t: float, raw: float) -> tuple[float, dict[int, Heard]] | None:
        """Take in a reading; if a cycle is due its seconds and the anchors it hears. A reading older than its anchor's newest only counts as late."""
        known = self.heard.get(anchor)
        if known is not None and (known.t, known.event_id) >= (t, event_id):
            self.late += 1
            return None
        if known is None:
            known = self.heard[anchor] = Heard(event_id, t, raw, kalman.step(None, t, raw))
        else:
            known.event_id, known.t, known.raw, known.state = event_id, t, raw, kalman.step(known.state, t, raw)
        if not known.past or known.past[-1] != raw:
            known.past = [*known.past[1 - K.FEATURE_WINDOW :], raw]
        if self.last is not None and t - self.last < K.MIN_INTERVAL_S:
            return None
        dt = K.DEFAULT_DT if self.last is None else min(t - self.last, K.MAX_DT)
        self.last, self.cycles = t, self.cycles + 1
        return dt, {a: h for a, h in self.heard.items() if t - h.t <= K.STALE_S}

    def reading(self, event_id: int, anchor: int, t: float, raw: float) -> dict[str, Any] | None:
        """Take in a reading; the record of the cycle that it starts, if one is due."""
        due = self.taken(event_id, anchor, t, raw)
        if due is None:
            return None
        dt, live = due
        n_eff, x, y, floor, confidence = self.step({a: h.x for a, h in live.items()}, dt)
        self.recent = [*self.recent[1 - K.POSITION_WINDOW :], (x, y, floor)]
        ox, oy, of = self.recent[0]
        far = 0.0 if len(self.recent) < 2 else 1.0 if of != floor else round(float(np.hypot(x - ox, y - oy)), 3)
        deltas = [abs(h.raw - h.was) for h in self.heard.values() if h.was is not None]
        spreads = [round(float(np.var(h.past, ddof=1)) + features.TIE, 3) for h in live.values() if len(h.past) > 1]
        for h in self.heard.values():
            h.was = h.raw
        late, self.late = self.late, 0
        return {
            "event_id": event_id, "t": t, "x": x, "y": y, "floor": floor, "confidence": confidence, "n_eff": round(n_eff, 1), "belief": [self.belief[f] for f in self.floors],
            "delta_mean": round(float(np.mean(deltas)) + features.TIE, 3) if deltas else 0.0, "var_mean": round(float(np.mean(spreads)) + features.TIE, 3) if spreads else 0.0, "displacement_ft": far, "n_late": late,
        }

    def step(self, heard: dict[int, float], dt: float) -> tuple[float, float, float, int, float]:
        """Move belief and particles on by ``dt`` seconds; returns the effective number of particles, and the estimate: x, y, floor, confidence."""
        fleet = Fleet(self.house, [self])
        n_eff, x, y, floor, confidence = fleet.step([self.cycles], *fleet.heard([heard]), np.array([dt]))
        fleet.back()
        return float(n_eff[0]), float(x[0]), float(y[0]), int(floor[0]), confidence[0]

    def _move(self, heard: dict[int, float], dt: float) -> None:
        fleet = Fleet(self.house, [self])
        fleet._move([self.rng], *fleet.heard([heard]), np.array([dt]))
        fleet.back()


class Fleet:
    """The clouds of several beacons, a row each; the first rows of all move on together.

    ``at`` are the layers of the floors that particles are on. Each beacon's draws are its own, in the order of its cycle's steps.
    """

    def __init__(self, house: House, beacons: list[Beacon]):
        self.house, self.beacons, self.n = house, beacons, beacons[0].n
        for b in beacons:
            if not len(b.w):
                b.start()
        self.x, self.y, self.w, self.cooldown = (np.array([getattr(b, c) for b in beacons], float) for c in ("x", "y", "w", "cooldown"))
        self.at = house.layer(np.array([b.floor for b in beacons]))
        self.belief, self.hold = np.array([[b.belief[f] for f in b.floors] for b in beacons]), np.array([b.hold for b in beacons], float)
        self.anchors = list(house.anchors)
        self.on = [[k for k, a in enumerate(self.anchors) if house.anchors[a][0] == f] for f in house.floors]
        self.place: tuple[np.ndarray, ...] | None = None

    def back(self) -> None:
        """Give the beacons their state."""
        for i, b in enumerate(self.beacons):
            b.x, b.y, b.w, b.cooldown, b.floor = self.x[i].copy(), self.y[i].copy(), self.w[i].copy(), self.cooldown[i].copy(), self.house.floors[self.at[i]]
            b.belief, b.hold = dict(zip(b.floors, self.belief[i].tolist(), strict=True)), float(self.hold[i])

    def heard(self, rows: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Strengths of all anchors for some rows, and which anchors are heard."""
        live = np.array([[a in r for a in self.anchors] for r in rows], bool)
        return np.array([[r.get(a, 0.0) for a in self.anchors] for r in rows], float), live

    def step(self, cycles: list[int], heard: np.ndarray, live: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """A cycle of the first rows: the effective number of particles, x, y, floor and confidence of each."""
        m = len(dt)
        rngs = [np.random.default_rng([abs(b.number), k]) for b, k in zip(self.beacons, cycles, strict=False)]
        for b, rng in zip(self.beacons, rngs, strict=False):
            b.rng = rng
        dt = np.maximum(dt, K.MIN_DT)
        self._believe(heard, live, dt)
        self._teleport(rngs, dt)
        self._move(rngs, heard, live, dt)
        self._weigh(heard, live)
        w = self.w[:m]
        n_eff = 1 / (w * w).sum(1)
        for i in np.flatnonzero(n_eff < K.RESAMPLE_RATIO * self.n):
            of = np.minimum(np.searchsorted(np.cumsum(w[i]), (np.arange(self.n) + rngs[i].random()) / self.n), self.n - 1)
            self.x[i], self.y[i], self.at[i] = self.x[i][of], self.y[i][of], self.at[i][of]
            w[i] = 1 / self.n
        self.place = x, y, at, confidence = self._estimate(m)
        return n_eff, x, y, self.house.floors[at], [round(c, 3) for c in confidence.tolist()]

    def _estimate(self, m: int) -> tuple[np.ndarray, ...]:
        """Mean place on the floor of most weight, its layer, and how sure that is."""
        x, y, w, at, rows = self.x[:m], self.y[:m], self.w[:m], self.at[:m], np.arange(m)
        weight = np.stack([(w * (at == f)).sum(1) for f in range(len(self.house.floors))], axis=1)
        best = weight.argmax(1)
        most = weight[rows, best]
        w = w * (at == best[:, None]) / np.maximum(most, 1e-300)[:, None]
        mx, my = (w * x).sum(1), (w * y).sum(1)
        spread = np.sqrt((w * ((x - mx[:, None]) ** 2 + (y - my[:, None]) ** 2)).sum(1))
        return mx, my, best, most * np.exp(-spread / 5)

    def _believe(self, heard: np.ndarray, live: np.ndarray, dt: np.ndarray) -> None:
        m, layers = len(dt), len(self.house.floors)
        x, y, at = (v[:m] for v in (self.place or self._estimate(m))[:3])
        belief, ways = self.belief[:m], self.house.adjacent
        off, to = np.repeat(dt[:, None], layers, 1), ways.sum(1)
        off[np.arange(m), at] *= self.house.near_stairs(x, y, at)
        off = np.minimum(K.HMM_RATE * off, K.HMM_MAX_OFF)
        p = belief * np.maximum(1 - off * to, 0.0)
        go = belief * off / np.maximum(1.0, off * to)
        for a, b in np.argwhere(ways):
            p[:, b] += go[:, a]
        there = np.stack([live[:, k].any(1) for k in self.on], axis=1)
        best = np.stack([np.where(live[:, k], heard[:, k], -1e9).max(1, initial=-1e9) for k in self.on], axis=1)
        n, ll = there.sum(1), np.zeros((m, layers))
        for g, f in enumerate(self.house.floors):
            adjusted = best + abs(self.house.floors - f) * K.FLOOR_ATTENUATION_DB
            mean = (adjusted * there).sum(1) / np.maximum(n, 1)
            ll[:, g] = np.where(n > 1, -0.5 * ((adjusted - mean[:, None]) ** 2 * there).sum(1) / K.HMM_SIGMA**2, 0.0)
        p *= np.exp(ll - ll.max(1)[:, None])
        total = p.sum(1)[:, None]
        self.belief[:m] = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / layers)

    def _teleport(self, rngs: list[np.random.Generator], dt: np.ndarray) -> None:
        m = len(dt)
        belief, at, rows = self.belief[:m], self.at[:m], np.arange(m)
        best, most = belief.argmax(1), np.stack([(at == f).sum(1) for f in range(belief.shape[1])], axis=1).argmax(1)
        apart = (best != most) & (belief[rows, best] >= K.TELEPORT_BELIEF) & self.house.adjacent[best, most]
        self.hold[:m] = np.where(apart, self.hold[:m] + dt, 0.0)
        for i in np.flatnonzero(apart & (self.hold[:m] >= K.TELEPORT_HOLD_S)):
            low = np.argsort(self.w[i], kind="stable")[: max(1, int(K.TELEPORT_SHARE * self.n))]
            self.x[i, low], self.y[i, low], floor = self.house.draw(len(low), self.house.floors[best[i : i + 1]], rngs[i])
            self.at[i, low], self.w[i], self.hold[i] = self.house.layer(floor), 1 / self.n, 0.0

    def _move(self, rngs: list[np.random.Generator], heard: np.ndarray, live: np.ndarray, dt: np.ndarray) -> None:
        m, house = len(dt), self.house
        x, y, at, cooldown, rows = self.x[:m], self.y[:m], self.at[:m], self.cooldown[:m], np.arange(m)[:, None]
        move = np.stack([r.normal(0, K.MOTION_SIGMA * t**0.5, (2, self.n)) for r, t in zip(rngs, dt.tolist(), strict=True)], axis=1)
        power = np.where(live, 10 ** ((heard + 100) / 10), 0.0)
        place = np.array([house.anchors[a][1:3] for a in self.anchors])
        pulled = np.stack([live[:, k].any(1) for k in self.on], axis=1)
        total = np.stack([power[:, k].sum(1) for k in self.on], axis=1)
        for axis, v in enumerate((x, y)):
            towards = np.stack([(power[:, k] * place[k, axis]).sum(1) for k in self.on], axis=1) / np.where(pulled, total, 1)
            move[axis] += np.where(pulled[rows, at], K.DRIFT_RATE * dt[:, None] * (towards[rows, at] - v), 0.0)
        far, cap = np.sqrt(move[0] * move[0] + move[1] * move[1]), (K.MAX_SPEED_FT_S * dt)[:, None]
        move *= np.where(far > cap, cap / np.maximum(far, 1e-12), 1)
        tx, ty = x + move[0], y + move[1]
        (r, c), (r1, c1) = house.cell_in(x, y, at), house.cell_in(tx, ty, at)
        good = (tx >= 0) & (ty >= 0) & (tx <= house.box[:, 0][at]) & (ty <= house.box[:, 1][at]) & house.free[at, r1, c1]
        asked = np.flatnonzero(good)
        good.flat[asked] = house.cells_open(*(v.ravel()[asked] for v in (at, r, c, r1, c1)))
        x[:], y[:] = np.where(good, tx, x), np.where(good, ty, y)
        np.maximum(cooldown - dt[:, None], 0, out=cooldown)
        free = cooldown == 0
        for a, b, ex, ey in house.stairs:
            back = next(((u, v) for c, e, u, v in house.stairs if (c, e) == (b, a)), None)
            if back is None:
                continue
            up, down = house.layer(np.array([a, b]))
            i, k = np.nonzero(free & (at == up))
            d = np.hypot(x[i, k] - ex, y[i, k] - ey)
            near = d < K.STAIR_RADIUS_FT
            i, k, d = i[near], k[near], d[near]
            u = np.concatenate([rngs[j].random(self.n)[k[i == j]] for j in np.unique(i)]) if len(i) else np.empty(0)
            go = u < np.minimum(self.belief[i, down] * K.STAIR_RATE * dt[i], 0.4) * np.clip(1 - d / K.STAIR_RADIUS_FT, 0.1, 1)
            i, k = i[go], k[go]
            x[i, k], y[i, k], at[i, k], cooldown[i, k], free[i, k] = *back, down, K.STAIR_COOLDOWN_S, False

    def _weigh(self, heard: np.ndarray, live: np.ndarray) -> None:
        m, house = len(heard), self.house
        x, y, at = self.x[:m], self.y[:m], self.at[:m]
        (r, c), (_, rows, cols) = house.cell_in(x, y, at), house.free.shape
        cell, z = (at * rows + r) * cols + c, house.height_in(x, y, at)
        log, d, e = np.zeros_like(x), np.empty_like(x), np.empty_like(x)
        for k, a in enumerate(self.anchors):
            if not live[:, k].any():
                continue
            _, ax, ay, az = house.anchors[a]
            np.square(np.subtract(x, ax, out=d), out=d)
            for v, at_ in ((y, ay), (z, az)):
                d += np.square(np.subtract(v, at_, out=e), out=e)
            # Ten times the logarithm of a distance is five times that of its square.
            np.log(np.maximum(d, K.MIN_DISTANCE_FT**2, out=d), out=d)
            d *= 5 * K.PATH_LOSS_N / np.log(10)
            d += np.take(house.losses[a], cell, out=e)
            d += (heard[:, k] - K.TX_POWER_DBM + 10 * K.PATH_LOSS_N * np.log10(K.METRES_PER_FOOT))[:, None]
            d /= K.RSSI_SIGMA
            np.square(d, out=d)
            log -= 0.5 * d if live[:, k].all() else np.where(live[:, k][:, None], 0.5 * d, 0.0)
        w = self.w[:m] * np.exp(log - log.max(1)[:, None])
        total = w.sum(1)[:, None]
        self.w[:m] = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / self.n)
