"""Embedding whitening by weighted multiplicity covariance.

Entries become integers, x = floor(256 * c). Rows of equal x are one distinct vector
with a multiplicity; the covariance is fitted on the distinct vectors, each weighted by its
multiplicity or by one: every task centres its vectors and multiplies them in blocks, and the tasks' sums of
products are added sixteen at a time. Each distinct vector is whitened once, and rows
get the result by a join on the digest of x. The driver gets the sums of each dimension and one
matrix of dimensions by dimensions.

Defined results: a row whose vector is null, or holds a null or non-finite entry, is dropped; vectors of each
length are fitted on their own (the number of lengths is to be small, as a model is held for each); an
empty vector has no components and gives no rows; components of no variance (at most 1e-12 of the
trace), such as those of a single vector, give no rows; entries beyond a long count as the nearest long; a deviation
that no long holds is null; repeated and null ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import saved

SCALE = 256
COMPONENTS = 4
#: Sums of products that one task adds up.
FAN_IN = 16
#: Vectors that are centred and multiplied at once.
BLOCK = 4096
#: Share of the trace below which a component has no variance.
NOTHING = 1e-12


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: their weight, exact sums, and the components of falling variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(vector: str | Column, scale: int = SCALE) -> Column:
    """The entries as whole numbers of 1 / ``scale``; null where an entry is null or not finite."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return F.when(good, F.transform(v, lambda c: F.floor(c * float(scale)).cast("long")))


def digest(x: str = "x") -> Column:
    return F.unhex(F.sha2(F.array_join(x, ","), 256))


def distinct(rows: DataFrame) -> DataFrame:
    """(x, copies, digest) of rows (x); equal vectors of a task are counted before they are shuffled."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest())


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Matrix of the vectors of one length, their weights and their rows, BLOCK at most at a time."""
    for batch in batches:
        sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            of = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
            for at in range(0, of.num_rows, BLOCK):
                part = of.slice(at, BLOCK)
                yield part.column(column).flatten().to_numpy().reshape(part.num_rows, int(d)), part.column("weight").to_numpy(), part


def _sums(weighted: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length of x: the weight and the exact sum of each dimension, from halves of 32 bits that no task's sum overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for x, w, _ in _blocks(batches, "x"):
            parts = np.vstack((np.full(x.shape[1], w.sum()), w @ (x >> 32), w @ (x & 0xFFFFFFFF)))
            held[x.shape[1]] = held.get(x.shape[1], np.zeros_like(parts)) + parts
        for d, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d, d, np.int32), "i": np.arange(d, dtype=np.int32), "n": n, "high": high, "low": low})

    parts = weighted.where("size(x) > 0").mapInArrow(add, "d int, i int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string").alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(exact("n"), exact("high"), exact("low")).orderBy("d", "i").collect():
        out.setdefault(r["d"], (int(r["n"]), []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


def covariances(weighted: DataFrame, column: str, means: dict[int, np.ndarray], total: dict[int, int]) -> dict[int, np.ndarray]:
    """Covariance of the vectors in ``column`` for each length, by weighted products of centred blocks."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x, w, _ in _blocks(batches, column):
            d = x.shape[1]
            y = x - means[d]
            held[d] = held.get(d, np.zeros((d, d))) + y.T @ (y * w[:, None])
        for d, m in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    def add(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("part")["m"]
        return pd.DataFrame({"d": [key[0]], "part": [key[1]], "m": [reduce(np.add, (np.frombuffer(m, np.float64) for m in ordered)).tobytes()]})

    schema = "d int, part int, m binary"
    parts, sums = weighted.rdd.getNumPartitions(), weighted.where(F.size(column) > 0).mapInArrow(multiply, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.groupBy("d", F.floor(F.col("part") / FAN_IN).cast("int").alias("to")).applyInPandas(add, schema)
    return {r["d"]: np.frombuffer(r["m"], np.float64).reshape(r["d"], r["d"]) / total[r["d"]] for r in sums.collect()}


def fitted(weighted: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors in (x, weight)."""
    sums = _sums(weighted)
    means = {d: np.array([s / n for s in of]) for d, (n, of) in sums.items()}
    out = {}
    for d, v in covariances(weighted, "x", means, {d: n for d, (n, _) in sums.items()}).items():
        e, u = np.linalg.eigh(v)
        kept = [i for i in range(d - 1, -1, -1) if e[i] > NOTHING * np.trace(v)][:components]
        out[d] = Model(*sums[d], u[:, kept], e[kept], float(np.trace(v)))
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exactly; null where it doesn't fit a long."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    if most * most * len(sums) < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whitened(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weight: str = "one", scale: int = SCALE) -> DataFrame:
    """For each row: (``id_col``, dims, n, deviation, whitened, explained, identity_error), the arrays by component.

    ``weight`` is "one" (each distinct vector once) or "count" (by its multiplicity).
    """
    if weight not in ("one", "count"):
        raise ValueError(f"unknown weight: {weight}")
    rows = table.select(F.col(id_col).alias("id"), integers(vector_col, scale).alias("x")).where("x IS NOT NULL")
    vectors = saved(spark, distinct(rows.select("x")), "distinct", compression="zstd")
    weighted = vectors.withColumn("weight", F.lit(1).cast("long") if weight == "one" else F.col("copies"))
    models = fitted(weighted, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, w, part in _blocks(batches, "x"):
            m = models[x.shape[1]]
            y = (x - m.mean) @ m.vectors / np.sqrt(m.variances)
            yield pa.RecordBatch.from_pydict({
                "digest": part.column("digest"), "dims": np.full(len(x), x.shape[1], np.int32), "weight": w, "white": pa.array(list(y), pa.list_(pa.float64())), "deviation": pa.array(_deviation(x, m.n, m.sums), pa.int64()),
            })

    white = saved(spark, weighted.where("size(x) > 0").mapInArrow(project, "digest binary, dims int, weight long, white array<double>, deviation long"), "whitened", compression="zstd")
    facts = spark.createDataFrame([(d, m.n, (m.variances / m.trace).tolist(), e) for d, m, e in ((d, m, identity_error(white, d, m)) for d, m in models.items())], "dims int, n long, explained array<double>, identity_error double")
    out = rows.select("id", digest().alias("digest")).join(white.drop("weight"), "digest").join(F.broadcast(facts), "dims")  # a row for each length
    return out.select(F.col("id").alias(id_col), "dims", "n", "deviation", F.col("white").alias("whitened"), "explained", "identity_error")


def identity_error(white: DataFrame, dims: int, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.variances)
    if not k:
        return 0.0
    own = white.where(F.col("dims") == dims)
    mean = own.agg(*((F.sum(F.col("weight") * F.col("white")[i]) / model.n).alias(f"m{i}") for i in range(k))).first()
    return float(np.abs(covariances(own.select("white", "weight"), "white", {k: np.array(mean)}, {k: model.n})[k] - np.eye(k)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_whitening: four components of every embedding."""
    out = whitened(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("i")).alias("explained"), "identity_error")
