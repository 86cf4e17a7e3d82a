"""Scalar expressions of the signal model, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavefix.functions import constants as K

type Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def noise(*parts: Col) -> Column:
    """A uniform number in [0, 1) that depends only on its parts; the last may be a plain tag."""
    cols = [(_c(p) if not isinstance(p, str) or p not in _TAGS else F.lit(p)).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Tags that set independent draws apart.
_TAGS = {"x", "y", "fl", "lab", "act", "conf", "n1", "n2", "r", "g", "q", "z", "w", "u1", "u2", "d1", "d2", "drop"}


def gaussian(key: Col, a: str, b: str) -> Column:
    """A standard normal number by Box and Muller from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - noise(key, a))) * F.cos(2 * F.lit(3.141592653589793) * noise(key, b))


def expected_rssi(distance_ft: Col, floors: Col | None = None, walls: Col | None = None) -> Column:
    out = F.lit(K.TX_POWER_DBM) - 10 * K.PATH_LOSS_N * F.log10(F.greatest(_c(distance_ft), F.lit(K.MIN_DISTANCE_FT)) * K.METRES_PER_FOOT)
    if walls is not None:
        out = out - K.WALL_ATTENUATION_DB * _c(walls)
    return out if floors is None else out - K.FLOOR_ATTENUATION_DB * _c(floors)


def log_likelihood(seen: Col, expected: Col) -> Column:
    z = (_c(seen) - _c(expected)) / K.RSSI_SIGMA
    return -0.5 * z * z


def distance(x1: Col, y1: Col, x2: Col, y2: Col, z1: Col | None = None, z2: Col | None = None) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    s = dx * dx + dy * dy
    return F.sqrt(s if z1 is None else s + (_c(z1) - _c(z2)) * (_c(z1) - _c(z2)))


def power(rssi: Col) -> Column:
    """Linear weight of a signal strength."""
    return F.pow(F.lit(10.0), (_c(rssi) + 100) / 10)


def stair_boost(d: Col) -> Column:
    return F.when(_c(d).isNull(), 1.0).otherwise(1 + (K.HMM_STAIR_BOOST - 1) / (1 + (_c(d) / K.HMM_STAIR_RADIUS_FT) * (_c(d) / K.HMM_STAIR_RADIUS_FT)))


def activity_score(variance: Col, delta: Col, displacement: Col) -> Column:
    part = lambda x, norm, weight: weight * F.least(_c(x) / norm, F.lit(1.0))
    return F.round(part(variance, K.VARIANCE_NORM, K.VARIANCE_WEIGHT) + part(delta, K.DELTA_NORM, K.DELTA_WEIGHT) + part(displacement, K.DISPLACEMENT_NORM, K.DISPLACEMENT_WEIGHT) + 1e-9, 3)


def activity(score: Col) -> Column:
    return F.when(_c(score) < K.SLEEPING_BELOW, "sleeping").when(_c(score) < K.STATIONARY_BELOW, "stationary").otherwise("moving")


def quality_bucket(rssi: Col) -> Column:
    return F.when(_c(rssi) > -60, "good").when(_c(rssi) > -75, "warn").otherwise("bad")


def battery_percent(mv: Col) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor((_c(mv) - 2000) / 10 + 0.5))).cast("int")


def battery_class(percent: Col) -> Column:
    return F.when(_c(percent) > 40, "good").when(_c(percent) > 15, "warn").otherwise("bad")


def confidence_radius(confidence: Col) -> Column:
    return 2.5 * (1 - _c(confidence)) + 0.4


def cell_centre(i: Col, low: Col) -> Column:
    return _c(low) + (_c(i) + 0.5) * K.GRID_FT


def inside(px: Col, py: Col, crossing: str = "crossings") -> Column:
    """Does the ray from a point cross one edge (xi, yi)-(xj, yj)? Sum over edges; odd is inside."""
    yi, yj = F.col("yi"), F.col("yj")
    cross = (yi > _c(py)) != (yj > _c(py))
    at = (F.col("xj") - F.col("xi")) * (_c(py) - yi) / F.when(yj != yi, yj - yi) + F.col("xi")
    return F.when(cross & (_c(px) < at), 1).otherwise(0)
