"""What the text operators share: the shared folder, routing by key, word and gram hashing.

Packed rows. Operators that move many small fixed-width records (fingerprints,
positions) put the records of one (input batch, target) pair into binary columns
of a single row, so that Spark shuffles a few large rows where it would
otherwise handle hundreds of millions of small ones.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators: it sorts after every other id.
NULL_ID = (1 << 63) - 1
#: Bytes of text that one vectorised step takes at once.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset in a local session (tests), a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='wavefix-')}"
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wavefix/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` to a path of ``shared_dir`` and read it back."""
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of ``shared_dir``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors don't matter."""
    return written(spark, df, shared_dir(spark, name), **options)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[..., DataFrame]]:
    """``saved`` for tables that nothing needs after the block: their folder is deleted at its end."""
    root, number = shared_dir(spark, name), count()
    try:
        yield lambda df, **options: written(spark, df, f"{root}/{next(number)}", **options)
    finally:
        removed(spark, root)


@contextmanager
def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """While it holds, what is executed gets Arrow batches of about ``size`` bytes, or one longer row; else rows of megabytes come by the thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: they set how many shards and blocks the operators use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text): null ids become NULL_ID and null texts empty; no other column is kept."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def unkeyed(col: str | Column = "key") -> Column:
    """Undo ``keyed`` for the id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != NULL_ID, col)


def block_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The block (0 to n - 1) of each id."""
    return (mix(keys.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def routed(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Deal rows to partition ``target`` (0 to n - 1), sorted there by ``target`` and ``order``."""
    return df.repartitionById(n, F.col("target")).sortWithinPartitions("target", *order)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_A = 0x5851F42D4C957F2D
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POW: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """A ** 0 to A ** (n - 1), modulo 2 ** 64."""
    if len(_POW[0]) < n:
        table = np.full(max(n, 256), _A, np.uint64)
        table[0] = 1
        _POW[0] = np.multiply.accumulate(table)
    return _POW[0][:n]


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive unit hashes, by doubling the span; len(units) - k + 1 of them."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    span, have, done, out = 1, units, 0, None
    while True:
        if k & span:
            piece = have[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(_A, span, 1 << 64)) + piece
            done += span
        if span * 2 > k:
            return mix(out)
        have = have[:-span] * np.uint64(pow(_A, span, 1 << 64)) + have[span:]
        span *= 2


def byte_units(data: bytes | np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte."""
    return _BYTE[np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in an array of bytes."""
    edge = np.diff(np.concatenate(([1], _SPACE[data], [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    base = np.cumsum(size) - size
    inside = np.arange(total) - np.repeat(base, size)
    at = inside + np.repeat(starts, size)
    parts = _BYTE[data[at]] * powers(int(size.max()))[inside]
    return mix(np.add.reduceat(parts, base) + size.astype(np.uint64))


def chunks(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Consecutive documents of about CHUNK bytes together; a longer document comes alone."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield keys[first:i], texts[first:i]
            first, size = i, 0
        size += len(x)
    if first < len(texts):
        yield keys[first:], texts[first:]


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes the position of the least (by its upper 40 bits, the leftmost of equals)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: n], x[w - span : w - span + n])
    return (x[:n] & low).astype(np.int64)


def anchors(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Content-chosen anchors of one document's windows of ``window`` units.

    Each window is assigned to the gram of least hash inside it, so that equal
    windows in any documents are assigned to equal grams at equal offsets.
    Returns for each anchor its hash, position, and how far before it the first
    and the last window assigned to it start.
    """
    empty = np.empty(0, np.int64)
    if len(units) < window:
        return np.empty(0, np.uint64), empty, empty, empty
    out = []
    step = 1 << 23
    for at in range(0, len(units) - window + 1, step):
        h = gram_hashes(units[at : at + step + window - 1], gram)
        best = window_minima(h, window - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        last = np.concatenate((first[1:], [len(best)])) - 1
        pos = best[first]
        out.append((h[pos], pos + at, pos - first, pos - last))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: bytes that rarely change cost next to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blobs: Iterable[bytes], kind: str) -> np.ndarray:
    """The arrays of several ``squeezed`` blobs, joined."""
    size = np.dtype(kind).itemsize
    open_ = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(open_(x), np.uint8).reshape(size, -1).T.ravel().view(kind) for x in blobs if x]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def packed(targets: np.ndarray, columns: dict[str, np.ndarray], pack: Callable[[np.ndarray], bytes] = squeezed) -> Iterator[dict[str, object]]:
    """One row for each target: its records' columns, each packed into bytes."""
    if not len(targets):
        return
    order = np.argsort(targets, kind="stable")
    targets = targets[order]
    columns = {k: v[order] for k, v in columns.items()}
    cuts = np.flatnonzero(np.concatenate(([True], targets[1:] != targets[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield {"target": int(targets[a]), **{k: pack(v[a:b]) for k, v in columns.items()}}


def unpacked(blobs: Iterable[bytes], kind: str) -> np.ndarray:
    """Arrays kept as plain bytes, joined."""
    return np.frombuffer(b"".join(blobs), np.dtype(kind))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal runs, sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((new[1:], [True]))]
