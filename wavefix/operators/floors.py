"""Hidden Markov model of the floor: emissions by aggregation, beliefs as prefix products of one matrix for each cycle."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import distance, stair_boost
from wavefix.operators import prefix
from wavefix.sources import layout


def names(plan: DataFrame) -> list[int]:
    """The plan's floors."""
    return [r["floor"] for r in layout.floors(plan).select("floor").orderBy("floor").collect()]


def emissions(vec: DataFrame, anchors: DataFrame, floors: list[int]) -> DataFrame:
    """Per cycle and floor how well the best strengths fit being there: each floor away costs the attenuation. Columns e<floor>."""
    best = vec.where(F.col("age") <= K.STALE_S).join(F.broadcast(anchors.select("anchor_idx", "floor")), "anchor_idx").groupBy("event_id", "beacon", "cycle", "t", "floor").agg(F.max("x").alias("best"))
    per = best.withColumn("g", F.explode(F.array(*map(F.lit, floors)))).withColumn("adjusted", F.col("best") + F.abs(F.col("floor") - F.col("g")) * K.FLOOR_ATTENUATION_DB)
    # Sum of -1/2 ((adjusted - mean) / sigma)^2 is the population variance times the count.
    ll = per.groupBy("event_id", "beacon", "cycle", "t", "g").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(-0.5 * F.count(F.lit(1)) * F.var_pop("adjusted") / K.HMM_SIGMA**2).alias("ll"))
    one = ll.groupBy("event_id", "beacon", "cycle", "t").agg(*(F.max(F.when(F.col("g") == g, F.col("ll"))).alias(f"l{g}") for g in floors))
    top = F.greatest(*(f"l{g}" for g in floors)) if len(floors) > 1 else F.col(f"l{floors[0]}")
    one = one.select("event_id", "beacon", "cycle", "t", *(F.exp(F.col(f"l{g}") - top).alias(f"w{g}") for g in floors))
    total = sum((F.col(f"w{g}") for g in floors[1:]), F.col(f"w{floors[0]}"))
    return one.select("event_id", "beacon", "cycle", "t", *((F.col(f"w{g}") / total).alias(f"e{g}") for g in floors))


@dataclass(frozen=True)
class Steps:
    """A cycle's step as a matrix that takes the belief before it to the belief after it, but for its scale.

    The first cycle starts from equal beliefs, or from certainty of ``first``. ``boost`` says how much likelier leaving is (a column, near stairs).
    """

    floors: list[int]
    ways: list[tuple[int, int]]
    first: int | None = None
    boost: str | None = None
    values: dict[str, str] = field(init=False)
    out: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        more = {} if self.boost is None else {self.boost: "double"}
        object.__setattr__(self, "values", {"t": "double", **{f"e{g}": "double" for g in self.floors}, **more})
        object.__setattr__(self, "out", {f"b{g}": "double" for g in self.floors})

    def lift(self, now: prefix.Columns, before: prefix.Columns, fresh: np.ndarray) -> np.ndarray:
        n, k = len(fresh), len(self.floors)
        dt = np.where(fresh, K.DEFAULT_DT, np.minimum(now["t"] - before["t"], K.MAX_DT))
        off = np.minimum(K.HMM_RATE * dt * (1.0 if self.boost is None else now[self.boost]), K.HMM_MAX_OFF)
        move = np.zeros((n, k, k))  # [to, from]
        for i, f in enumerate(self.floors):
            to = [self.floors.index(b) for a, b in self.ways if a == f]
            all_off = off * len(to)
            move[:, i, i] = np.maximum(1 - all_off, 0.0)
            for j in to:
                move[:, j, i] = off / np.maximum(1.0, all_off)
        step = np.stack([now[f"e{g}"] for g in self.floors], axis=1)[:, :, None] * move
        start = np.full(k, 1 / k) if self.first is None else (np.array(self.floors) == self.first).astype(float)
        step[fresh] = np.repeat(step[fresh] @ start[:, None], k, axis=2)  # whatever was before
        return self._scaled(step)

    def _scaled(self, m: np.ndarray) -> np.ndarray:
        top = m.max(axis=(1, 2), keepdims=True)
        return np.where(top > 0, m / np.where(top > 0, top, 1.0), 1.0).reshape(len(m), -1)

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = len(self.floors)
        return self._scaled(b.reshape(-1, k, k) @ a.reshape(-1, k, k))

    def identity(self) -> np.ndarray:
        return np.eye(len(self.floors)).ravel()

    def read(self, products: np.ndarray) -> prefix.Columns:
        k = len(self.floors)
        p = products.reshape(-1, k, k)[:, :, 0]
        p = p / p.sum(axis=1, keepdims=True)
        return {f"b{g}": p[:, i] for i, g in enumerate(self.floors)}


def beliefs(emitted: DataFrame, plan: DataFrame, first: int | None = None, boost: str | None = None, block_s: float = prefix.BLOCK_S) -> DataFrame:
    """(event_id, beacon, b<floor>, floor) after each cycle; of equal beliefs the lowest floor."""
    floors = names(plan)
    ways = sorted((r["floor_a"], r["floor_b"]) for r in layout.adjacency(plan).collect())  # as small as the plan
    out = prefix.prefixed(emitted, ["beacon"], ["t", "event_id"], Steps(floors, ways, first, boost), ["event_id", "beacon"], block_s)
    return out.withColumn("floor", likeliest("b", floors))


def likeliest(prefix_: str, floors: list[int]) -> Column:
    """The floor of the largest column ``prefix_``<floor>, the lowest of equals."""
    return F.array_max(F.array(*(F.struct(F.round(f"{prefix_}{g}", 9).alias("p"), F.lit(-g).alias("g")) for g in floors)))["g"] * -1


def base_matrix(adjacency: DataFrame) -> DataFrame:
    """(floor_a, floor_b, p) of the transition matrix for inspection: the self weight, the rest shared by the neighbours."""
    n = adjacency.groupBy("floor_a").agg(F.count(F.lit(1)).alias("n"))
    off = adjacency.join(n, "floor_a").select("floor_a", "floor_b", ((1 - K.HMM_SELF) / F.col("n")).alias("p"))
    return off.unionByName(n.select("floor_a", F.col("floor_a").alias("floor_b"), F.lit(K.HMM_SELF).alias("p")))


def transition(adjacency: DataFrame, proximity: DataFrame, dt: float) -> DataFrame:
    """(floor_a, floor_b, p) over ``dt`` seconds; near stairs (floor, dist) leaving is likelier."""
    off = adjacency.join(F.broadcast(proximity.select(F.col("floor").alias("floor_a"), "dist")), "floor_a", "left").select("floor_a", "floor_b", F.least(F.lit(K.HMM_RATE * dt) * stair_boost("dist"), F.lit(K.HMM_MAX_OFF)).alias("p"))
    total = off.groupBy("floor_a").agg(F.sum("p").alias("s"))
    scale = F.greatest("s", F.lit(1.0))
    stay = total.select("floor_a", F.col("floor_a").alias("floor_b"), F.greatest(1 - F.col("s"), F.lit(0.0)).alias("p"))
    return off.join(total, "floor_a").select("floor_a", "floor_b", (F.col("p") / scale).alias("p")).unionByName(stay)


def stair_proximity(points: DataFrame, stairs: DataFrame) -> DataFrame:
    """Distance from points (pid, floor, x, y) to the nearest stair entry on their floor, and the boost it gives."""
    s = stairs.select(F.col("from_floor").alias("floor"), "ex", "ey")
    out = points.join(F.broadcast(s), "floor", "left").groupBy("pid", "floor").agg(F.min(distance("x", "y", "ex", "ey")).alias("dist"))
    return out.withColumn("boost", stair_boost("dist"))
