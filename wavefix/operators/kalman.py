"""Constant-velocity Kalman smoothing of each (beacon, anchor) series.

Over tables the filter is a prefix product: each reading is an element (A, b, C, eta, J) that maps any state before it to the state after it, and
elements compose associatively, so that a series is cut into blocks and filtered in parallel (see ``prefix``).
Live, it goes reading by reading (``step``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.operators import prefix


def step(state: tuple[float, ...] | None, t: float, z: float, q: float = K.KALMAN_Q, r: float = K.KALMAN_R, stale: float = K.STALE_S) -> tuple[float, ...]:
    """One reading of a live filter: (t, x, v, p00, p01, p11) after it; a gap of more than ``stale`` seconds starts it anew at the reading."""
    if state is None or t - state[0] > stale:
        x, v, a, b, c = z, 0.0, K.KALMAN_P_RSSI, 0.0, K.KALMAN_P_VELOCITY
    else:
        then, x, v, a, b, c = state
        dt = t - then
        x = x + v * dt
        a, b, c = a + 2 * dt * b + dt * dt * c + q * dt * dt * dt / 3, b + dt * c + q * dt * dt / 2, c + q * dt
    total, y = a + r, z - x
    return t, x + a / total * y, v + b / total * y, (1 - a / total) * a, (1 - a / total) * b, c - b * b / total


def _cut(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """A (n, 2, 2), b (n, 2, 1), C (n, 2, 2), eta (n, 2, 1), J (n, 2, 2) of rows of 16 numbers."""
    n = len(e)
    return e[:, :4].reshape(n, 2, 2), e[:, 4:6].reshape(n, 2, 1), e[:, 6:10].reshape(n, 2, 2), e[:, 10:12].reshape(n, 2, 1), e[:, 12:].reshape(n, 2, 2)


@dataclass(frozen=True)
class Readings:
    """Readings of a series as elements of the filter; a gap of more than ``stale`` seconds starts it anew at the reading."""

    q: float = K.KALMAN_Q
    r: float = K.KALMAN_R
    stale: float = K.STALE_S
    values: dict[str, str] = field(default_factory=lambda: {"t": "double", "rssi": "double"})
    out: dict[str, str] = field(default_factory=lambda: {"x": "double", "v": "double", "p00": "double", "p01": "double", "p11": "double"})

    def lift(self, now: prefix.Columns, before: prefix.Columns, fresh: np.ndarray) -> np.ndarray:
        dt, y = now["t"] - before["t"], now["rssi"]
        q0, q1, q2 = self.q * dt**3 / 3, self.q * dt * dt / 2, self.q * dt
        s = q0 + self.r
        k0, k1 = q0 / s, q1 / s
        a0 = 1 - k0
        e = np.stack((a0, a0 * dt, -k1, 1 - k1 * dt, k0 * y, k1 * y, a0 * q0, a0 * q1, a0 * q1, q2 - k1 * q1, y / s, dt * y / s, 1 / s, dt / s, dt / s, dt * dt / s), axis=1)
        anew = fresh | (dt > self.stale)
        e[anew] = 0.0
        e[anew, 4] = y[anew]
        e[anew, 6] = (1 - K.KALMAN_P_RSSI / (K.KALMAN_P_RSSI + self.r)) * K.KALMAN_P_RSSI
        e[anew, 9] = K.KALMAN_P_VELOCITY
        return e

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (a1, b1, c1, n1, j1), (a2, b2, c2, n2, j2) = _cut(a), _cut(b)
        m = np.eye(2) + c1 @ j2
        d = m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0]
        inverse = np.stack((m[:, 1, 1], -m[:, 0, 1], -m[:, 1, 0], m[:, 0, 0]), axis=1).reshape(-1, 2, 2) / d[:, None, None]
        left = a2 @ inverse
        right = np.swapaxes(inverse @ a1, 1, 2)
        parts = a2 @ inverse @ a1, left @ (b1 + c1 @ n2) + b2, left @ c1 @ np.swapaxes(a2, 1, 2) + c2, right @ (n2 - j2 @ b1) + n1, right @ j2 @ a1 + j1
        return np.concatenate([p.reshape(len(a), -1) for p in parts], axis=1)

    def identity(self) -> np.ndarray:
        return np.array([1.0, 0, 0, 1, *[0.0] * 12])

    def read(self, products: np.ndarray) -> prefix.Columns:
        return {"x": products[:, 4], "v": products[:, 5], "p00": products[:, 6], "p01": products[:, 7], "p11": products[:, 9]}


def smoothed(readings: DataFrame, block_s: float = prefix.BLOCK_S, **params: float) -> DataFrame:
    """The filter's state after each reading."""
    return prefix.prefixed(readings.withColumn("rssi", F.col("rssi").cast("double")), ["beacon", "anchor_idx"], ["t", "event_id"], Readings(**params), ["event_id", "beacon", "anchor_idx", "t"], block_s)


def snapshot(states: DataFrame, stale: float = K.STALE_S) -> DataFrame:
    """Each filter's last state, but those silent for more than ``stale`` seconds at the beacon's last reading."""
    last = states.groupBy("beacon", "anchor_idx").agg(F.max_by(F.struct("t", "x", "v", "p00"), F.struct("t", "event_id")).alias("s")).select("beacon", "anchor_idx", "s.*")
    now = states.groupBy("beacon").agg(F.max("t").alias("now"))
    return last.join(now, "beacon").where(F.col("now") - F.col("t") <= stale).drop("now")


def accessors(states: DataFrame) -> DataFrame:
    """Velocity and variance of each filter however old, and how many of its beacon's are active."""
    last = states.groupBy("beacon", "anchor_idx").agg(F.max_by(F.struct("v", "p00"), F.struct("t", "event_id")).alias("s"))
    n = last.groupBy("beacon").agg(F.count(F.lit(1)).alias("n_active"))
    return last.join(n, "beacon").select("beacon", "anchor_idx", F.col("s.v").alias("velocity"), F.col("s.p00").alias("variance"), "n_active")


SQL = f"""s AS (SELECT *, row_number() OVER (PARTITION BY beacon, anchor_idx ORDER BY t, event_id) AS n FROM r), k AS (
  SELECT event_id, beacon, anchor_idx, n, t, rssi AS x, 0.0::DOUBLE AS v, (1 - {K.KALMAN_P_RSSI} / ({K.KALMAN_P_RSSI} + {K.KALMAN_R}::DOUBLE)) * {K.KALMAN_P_RSSI} AS a, 0.0::DOUBLE AS b, {K.KALMAN_P_VELOCITY}::DOUBLE AS c FROM s WHERE n = 1
  UNION ALL
  SELECT event_id, beacon, anchor_idx, n, t, px + pa / (pa + {K.KALMAN_R}) * (z - px), pv + pb / (pa + {K.KALMAN_R}) * (z - px), (1 - pa / (pa + {K.KALMAN_R})) * pa, (1 - pa / (pa + {K.KALMAN_R})) * pb, pc - pb * pb / (pa + {K.KALMAN_R})
  FROM (
    SELECT event_id, beacon, anchor_idx, n, t, z, CASE WHEN d > {K.STALE_S} THEN z ELSE x + v * d END AS px, CASE WHEN d > {K.STALE_S} THEN 0 ELSE v END AS pv,
           CASE WHEN d > {K.STALE_S} THEN {K.KALMAN_P_RSSI} ELSE a + 2 * d * b + d * d * c + {K.KALMAN_Q} * d * d * d / 3 END AS pa,
           CASE WHEN d > {K.STALE_S} THEN 0 ELSE b + d * c + {K.KALMAN_Q} * d * d / 2 END AS pb, CASE WHEN d > {K.STALE_S} THEN {K.KALMAN_P_VELOCITY} ELSE c + {K.KALMAN_Q} * d END AS pc
    FROM (SELECT s.event_id, s.beacon, s.anchor_idx, s.n, s.t, s.rssi AS z, s.t - k.t AS d, k.x, k.v, k.a, k.b, k.c FROM k JOIN s ON s.beacon = k.beacon AND s.anchor_idx = k.anchor_idx AND s.n = k.n + 1)
  )
)"""
