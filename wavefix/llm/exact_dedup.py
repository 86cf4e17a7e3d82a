"""Exact deduplication by a log-structured merge index of text digests.

Each task is a memtable: it hashes the normalised texts of its rows and flushes them as a run sorted
by digest (level 0), whose Parquet files carry a Bloom filter on the digest. Levels are compacted by
size: ``FANOUT`` runs of a level merge into one sorted run of the next, which keeps for each digest the
row that stays and how many there were, until one run is left. A run's rows are dealt by digest, so a
level is merged by all tasks, and a hot digest is reduced before it is shuffled.

Digests of several rows in the last run are hits. They get a Bloom filter sized by their number (``EACH`` bits for each,
``MOST`` in all, so it may be broadcast; 0.5 % of other texts pass it, more only beyond ``MOST`` / ``EACH`` hits, and results
never depend on it); texts that pass it are looked up in the hits and their bytes
compared, and a digest whose texts differ is split by text. Point look-ups in the first runs use their files' own filters.

Defined results: a null text is empty, and all empty texts are one group; a
null id loses to any id; rows that repeat an id carry the same decision each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import saved, scratch

#: Characters that don't count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
#: Runs that merge into one.
FANOUT = 16
#: Bits of the hits' filter for each hit, and in all (128 MB); how many of a digest's bits are set; bits of one row of it.
EACH, MOST, PROBES, ROW = 16, 1 << 30, 3, 1 << 15
#: How the first runs are written: Parquet's own filters, each of the size that its file's digests need, for point look-ups.
FILTERED = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "1048576"}


def normalised(text: Column) -> Column:
    for x in IGNORED:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flushed(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Level 0: (run, digest, id, chars) in sorted runs, one for each task, with filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.spark_partition_id().alias("run"), digest(normalised(text)).alias("digest"), F.col("doc_id").alias("id"), F.length(text).alias("chars"))
    return saved(spark, rows.sortWithinPartitions("digest"), "runs", **FILTERED)


def merged(level: DataFrame, *also: str) -> DataFrame:
    """The next level of runs (run, digest, best, n): each digest once in each, with the row that stays (longest text, then least id)."""
    out = level.groupBy(F.floor(F.col("run") / FANOUT).cast("int").alias("run"), "digest", *also).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return out.sortWithinPartitions("run", "digest")


def compacted(spark: SparkSession, runs: DataFrame, *also: str) -> DataFrame:
    """The last run, (digest, keep_id, group_size), after merging level by level."""
    level = runs.select("run", "digest", *also, F.struct("chars", F.bitwise_not("id").alias("rest")).alias("best"), F.lit(1).cast("long").alias("n"))
    most = runs.agg(F.max("run")).first()[0] or 0
    with scratch(spark, "levels") as keep:
        while most >= FANOUT:
            level = keep(merged(level, *also))
            most //= FANOUT
        level = saved(spark, merged(level, *also), "level")
    return level.select("digest", *also, F.bitwise_not("best.rest").alias("keep_id"), F.col("n").alias("group_size"))


def filter_bits(hits: int, most: int = MOST) -> int:
    """Bits of a filter for so many digests: a power of two, one row of ``ROW`` at least."""
    return max(ROW, min(most, 1 << max(hits * EACH - 1, 0).bit_length()))


def _row(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits // ROW)).cast("int")


def _places() -> list[Column]:
    """The bits of a digest in its row of the filter: slices of a second hash."""
    h = F.xxhash64(F.col("digest"), F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(ROW - 1)) for i in range(PROBES)]


def filter_of(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, set): a Bloom filter of digests in rows of 4 KB, ``bits`` / 8 bytes at most."""
    places = digests.select(_row(bits).alias("bucket"), F.explode(F.array(*_places())).alias("at"))
    return places.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("set"))


def passing(rows: DataFrame, held: DataFrame, bits: int) -> DataFrame:
    """The rows whose digest may be among those of the filter ``held``; nothing is shuffled."""
    byte = lambda at: F.conv(F.hex(F.substring("set", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("bucket", _row(bits)).join(F.broadcast(held), "bucket")
    for at in _places():
        out = out.where(F.getbit(byte(at), (at % 8).cast("int")) == 1)
    return out.select(rows.columns)


def found(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Rows of a level with the given digests (a short list): ranges and Bloom filters of the files let the scan skip their row groups."""
    return runs.where(F.col("digest").isin([F.lit(x) for x in digests]))


def exact_dedup(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256, most: int = MOST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    runs = flushed(spark, docs, digest)
    hits = saved(spark, compacted(spark, runs).where("group_size > 1"), "hits")

    # Byte verification of the hits. Copies in one task collapse before the shuffle by text, so a hot text
    # costs a row for each task; only digests that belong to several texts are left.
    text = normalised(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(digest(text).alias("digest"), text.alias("norm"), "doc_id", "text")
    bits = filter_bits(hits.count(), most)
    maybe = passing(rows.select("digest", "norm"), filter_of(hits, bits), bits)
    texts = maybe.groupBy("norm").agg(F.first("digest").alias("digest")).join(hits.select("digest"), "digest", "left_semi")
    mixed = saved(spark, texts.groupBy("digest").count().where("count > 1").select("digest"), "mixed")

    pure = hits.join(mixed, "digest", "left_anti")
    single = (
        runs.join(mixed, "digest", "left_anti")
        .join(pure, "digest", "left")
        .select(F.col("id").alias("doc_id"), F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest")
    )
    if mixed.isEmpty():
        out = single
    else:
        clash = rows.join(mixed, "digest", "left_semi").select(F.lit(0).alias("run"), "digest", "norm", F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
        split = clash.join(compacted(spark, clash, "norm"), ["digest", "norm"]).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "digest")
        out = single.unionByName(split)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(spark, docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM n WINDOW w AS (PARTITION BY x ORDER BY length(t) DESC, doc_id)
"""
