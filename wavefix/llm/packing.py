"""Sequence packing: shortest-pack-first over the length histogram.

A document's ids (with the end id) are cut into full sequences and a rest. Only
the histogram of the rests' lengths, at most ``size`` numbers, reaches the
driver. Lengths are placed longest first; each goes to the shortest pack that
has room, and packs of equal content are kept as one pattern with a count. The
patterns' slots are then joined to the documents by their rank within their
length.

Ranks are taken within (length, block of ids) and shifted by the counts of the blocks
before, so a length that many documents share is not gathered in one task.

Defined results: a null or empty text is the end id alone; an empty table gives
no rows; rows that repeat an id are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.llm.common import keyed, partitions, saved, unkeyed
from wavefix.llm.tokens import encoder, vocabulary

END = 1


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns ([lengths], how many packs) that hold counts[n] items of each length n."""
    #: For each used length a stack of (lengths, count); the heap orders used lengths, shortest first.
    at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    heap: list[int] = []

    def put(used: int, lengths: tuple[int, ...], n: int) -> None:
        if used not in at:
            at[used] = []
            heapq.heappush(heap, used)
        at[used].append((lengths, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not heap or heap[0] + length > size:
                put(length, (length,), left)
                break
            used = heap[0]
            lengths, n = at[used].pop()
            take = min(n, left)
            if n > take:
                at[used].append((lengths, n - take))
            if not at[used]:
                del at[used]
                heapq.heappop(heap)
            put(used + length, (*lengths, length), take)
            left -= take
    return [(list(lengths), n) for used in sorted(at) for lengths, n in at[used]]


def slots(patterns: list[tuple[list[int], int]]) -> tuple[pd.DataFrame, int]:
    """For each (pattern, place) the ranks of the documents of its length that it takes; and the number of packs."""
    rows, taken, base = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            first = taken.get(x, 0)
            rows.append((x, first, first + n, base, offset))
            taken[x] = first + n
            offset += x
        base += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "base", "offset"]).sort_values(["length", "rank_from"]), base


def pieces(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32, doc_tokens): each document's ids cut at multiples of ``size``."""

    names = ["key", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids = encoder(path).all_ids
        end = np.array([END], "<u4")
        for batch in batches:
            out: list[tuple] = []
            texts = (x.as_py() for x in batch.column("text"))  # a megabyte of them at a time
            for key, ids in zip(batch.column("key").to_pylist(), all_ids(texts), strict=True):
                ids = np.concatenate((ids, end))
                data = memoryview(ids.tobytes())
                out += [(key, at, min(size, len(ids) - at), zlib.crc32(data[4 * at : 4 * (at + size)]), len(ids)) for at in range(0, len(ids), size)]
            columns = np.array(out, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names)

    return docs.mapInArrow(cut, ", ".join(f"{x} long" for x in names))


def ranked(df: DataFrame, by: str, key: str, blocks: int) -> DataFrame:
    """Add ``rank`` from 0 within ``by``, in blocks of ids: no task holds all rows of one value."""
    df = df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    sizes = df.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(by, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = W.partitionBy(by, "block").orderBy(key, "start")
    out = df.withColumn("rank", F.row_number().over(within) - 1).join(sizes, [by, "block"])
    return out.withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "block")


def packed(spark: SparkSession, docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Pieces of all documents (doc_id, text) with sequence_id and offset."""
    rows = saved(spark, pieces(keyed(docs), path, size), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = pack_histogram(counts, size)
    table, _ = slots(patterns)
    schema = "length long, rank_from long, rank_to long, base long, offset long"
    if not len(table):
        return rows.select(unkeyed().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    by_length = {int(k): (g["rank_from"].to_numpy(), g["base"].to_numpy(), g["offset"].to_numpy()) for k, g in table.groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, g in pdf.groupby("length").indices.items():
                first, base, offset = by_length[int(length)]
                rank = pdf["rank"].to_numpy()[g]
                i = np.searchsorted(first, rank, "right") - 1
                seq[g], off[g] = base[i] + rank - first[i], offset[i]
            yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off)

    out = ranked(rows, "length", "key", partitions(spark)).select("key", "start", "length", "ids_crc32", "doc_tokens", "rank")
    out = out.mapInPandas(place, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(unkeyed().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(spark, docs, vocabulary("byte_bpe_50k.json"))
