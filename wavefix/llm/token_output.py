"""Token output: one wavelet matrix for each shard of documents.

Documents are encoded, dealt by ranges of their id and cut into shards of about
``shard_tokens`` ids. A shard's file is a header, its documents' ids and lengths,
and a wavelet matrix of all its token ids: one bit-plane for each bit of an id,
highest first, each followed by the count of ones before every 512th bit. With
these ranks the file answers access, count, rank, select and occurrences without
being decoded; decoding whole shards is vectorised.

Executors reach shared storage only through Spark's writers, so a file's bytes are
the ``file`` value of one row of a Parquet table (zstd), beside the columns that
find the shard without opening it.

Defined results: a null or empty text is the end id alone; an empty table gives no
shards and no rows; rows that repeat an id follow one another, each a document
of its own; a null id comes last; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.llm.common import keyed, partitions, saved, unkeyed
from wavefix.llm.tokens import encoder, vocabulary

END = 1
MAGIC = b"WVM1"
#: Bits between two stored ranks.
STEP = 512


class WaveletMatrix:
    """Bit-planes with ranks over a sequence of small integers."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros
        self.levels = len(planes)

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        kind = np.uint16 if levels <= 16 else np.uint32
        values = values.astype(kind)
        size = -(-max(len(values), 1) // STEP) * STEP
        for level in reversed(range(levels)):
            bits = (values & kind(1 << level)) != 0
            full = np.zeros(size, bool)
            full[: len(bits)] = bits
            plane = np.packbits(full, bitorder="little")
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate(([0], np.cumsum(ones, dtype=np.uint32)[:-1])).astype(np.uint32))
            zeros.append(len(bits) - int(np.count_nonzero(bits)))
            if level:  # nothing is below the last plane
                values = np.concatenate((np.compress(~bits, values), np.compress(bits, values)))
        return cls(len(values), planes, ranks, zeros)

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)

    def values(self) -> np.ndarray:
        """All integers in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in reversed(range(self.levels)):
            bits = self._bits(k)
            below = out
            below[self.zeros[k] :] |= kind(1 << (self.levels - 1 - k))
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bits)] = below[: self.zeros[k]]
            out[np.flatnonzero(bits)] = below[self.zeros[k] :]
        return out

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if i <= 0:
            return 0
        block = min(i // STEP, len(self.ranks[k]) - 1)
        part = self.planes[k][block * STEP // 8 : -(-i // 8)].copy()
        if i % 8:
            part[-1] &= (1 << (i % 8)) - 1
        return int(self.ranks[k][block]) + int(np.bitwise_count(part).sum())

    def _find(self, k: int, j: int, bit: int) -> int:
        """Position of the j-th (from 0) bit of that value in plane k."""
        before = self.ranks[k].astype(np.int64) if bit else np.arange(len(self.ranks[k])) * STEP - self.ranks[k]
        block = int(np.searchsorted(before, j, "right")) - 1
        inside = np.unpackbits(self.planes[k][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(inside == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        """The i-th integer."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.levels):
            ones = self._ones(k, i)
            bit = self.planes[k][i >> 3] >> (i & 7) & 1
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | int(bit)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``end`` lie below the last plane."""
        lo, hi = 0, end
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of ``value`` among the first ``end`` integers."""
        if value >> self.levels:
            return 0
        lo, hi = self._range(value, min(max(end, 0), self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``value``."""
        if value >> self.levels or not 0 <= j < self.count(value):
            raise IndexError(j)
        i = self._range(value, self.n)[0] + j
        for k in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - k) & 1
            i = self._find(k, i - self.zeros[k] if bit else i, bit)
        return i

    def occurrences(self, value: int) -> list[int]:
        """All positions of ``value``, in order."""
        return [self.select(value, j) for j in range(self.count(value))]


def to_file(keys: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    head = struct.pack("<4sIQB", MAGIC, len(keys), matrix.n, matrix.levels)
    body = [head, keys.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), np.array(matrix.zeros, "<u8").tobytes()]
    for plane, rank in zip(matrix.planes, matrix.ranks, strict=True):
        body += [plane.tobytes(), rank.astype("<u4").tobytes()]
    return b"".join(body)


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(document ids, lengths, matrix) of a shard's file; nothing is decoded."""
    magic, docs, n, levels = struct.unpack_from("<4sIQB", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    at = struct.calcsize("<4sIQB")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    keys, lengths, zeros = take("<i8", docs), take("<u8", docs), take("<u8", levels)
    blocks = -(-max(n, 1) // STEP)
    planes, ranks = [], []
    for _ in range(levels):
        planes.append(take("u1", blocks * STEP // 8))
        ranks.append(take("<u4", blocks))
    return keys, lengths, WaveletMatrix(n, planes, ranks, [int(x) for x in zeros])


def written(spark: SparkSession, docs: DataFrame, path: str, shard_tokens: int = 1 << 20) -> DataFrame:
    """Write all documents (doc_id, text) and return the table of shards: part, seq, first_key, n_docs, n_tokens, file."""

    kinds = {"part": pa.int32(), "seq": pa.int32(), "first_key": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "file": pa.binary()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path)
        levels = max(1, (use.tokenizer.get_vocab_size() - 1).bit_length())
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        end = np.array([END], "<u4")

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in parts])
            file = to_file(np.array(keys), lengths, WaveletMatrix.build(np.concatenate(parts), levels))
            row = (part, seq, keys[0], len(keys), held, file)
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            texts = (x.as_py() for x in batch.column("text"))  # a megabyte of them at a time
            for key, ids in zip(batch.column("key").to_pylist(), use.all_ids(texts), strict=True):
                ids = np.concatenate((ids, end))
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= shard_tokens:
                    yield shard()
                    keys, parts, held, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    dealt = keyed(docs).repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "text")
    shards = dealt.mapInArrow(encode, "part int, seq int, first_key long, n_docs long, n_tokens long, file binary")
    return saved(spark, shards, "tokens", compression="zstd")


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, ahead): ids in all shards before each shard; sums by part first, so no window sees all shards."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    return rows.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("ahead"))


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, seq, file in zip(pdf["part"], pdf["seq"], pdf["file"], strict=True):
                keys, lengths, matrix = from_file(file)
                data = memoryview(matrix.values().astype("<u4").tobytes())
                ends = np.cumsum(lengths).astype(np.int64)
                begins = ends - lengths.astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame({"part": part, "seq": seq, "key": keys, "inside": begins, "n_tokens": lengths.astype(np.int64), "ids_crc32": crc})

    rows = shards.select("part", "seq", "file").mapInPandas(decode, "part int, seq int, key long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "seq"]).select(unkeyed().alias("doc_id"), (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """(part, seq, n): occurrences of one id in each shard, by ranks alone."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "n": [from_file(x)[2].count(token) for x in pdf["file"]]})

    return shards.select("part", "seq", "file").mapInPandas(count, "part int, seq int, n long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(written(spark, docs, vocabulary("word_bpe_49k.json")))
