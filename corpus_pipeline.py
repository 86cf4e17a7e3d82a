"""From raw documents to training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last returns the packed pieces.

Defined results: a null text is an empty text in every stage; empty texts are exact copies of each
other, near copies of nothing and never contaminated; rows may share an id or have none: they are told apart
by their text, and of rows equal in both one stays; an empty table passes through; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm import decontamination, exact_dedup, near_dedup, packing, quality
from wavefix.llm.common import keyed, saved, unkeyed
from wavefix.llm.tokens import vocabulary


def _matched(docs: DataFrame, listed: DataFrame, mark: Column, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and ``mark`` (of their text) are in ``listed`` (doc_id, mark), by a semi or anti join; ids may be null or repeated."""
    other = listed.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_listed")).distinct().hint("merge")
    return docs.withColumn("_mark", mark).join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_listed")), how).select(docs.columns)


def _text_mark() -> Column:
    return exact_dedup.sha256(F.coalesce(F.col("text"), F.lit("")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    score = quality.scorer(quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def exact_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that repeat an id too, the one of longest text."""
    found = saved(spark, exact_dedup.exact_dedup(spark, docs).where("group_size > 1").select("doc_id", F.col("digest").alias("mark"), "kept"), "copies")
    mark = exact_dedup.sha256(exact_dedup.normalised(F.coalesce(F.col("text"), F.lit(""))))
    repeated = saved(spark, found.where("kept").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"), "repeated")
    dropped = found.where("NOT kept").select("doc_id", "mark")
    if repeated.isEmpty():
        return _matched(docs, dropped, mark, "left_anti")
    rows = _matched(docs, repeated, mark, "left_semi").withColumn("_mark", mark)
    one = rows.groupBy("doc_id", "_mark").agg(F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), "text")).alias("row"), F.first(F.struct(*docs.columns)).alias("any"))
    one = one.select(F.coalesce("row", "any").alias("row")).select("row.*")
    return _matched(docs, dropped.unionByName(repeated), mark, "left_anti").unionByName(one)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; of rows that share an id or have none, the one of least text hash."""
    shared = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        found = near_dedup.near_groups(spark, keyed(docs))
        dropped = saved(spark, found.where("key <> comp").select(unkeyed().alias("doc_id")), "near")
        return docs.join(dropped.withColumnRenamed("doc_id", "_dropped").distinct(), F.col("doc_id") == F.col("_dropped"), "left_anti")
    # Ids don't tell rows apart: each (id, text) gets a number in order of its id.
    names = docs.select("doc_id", _text_mark().alias("mark")).distinct().orderBy(F.asc_nulls_last("doc_id"), "mark")
    names = saved(spark, names.withColumn("key", F.monotonically_increasing_id()), "names")
    own = names.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_listed"), "key")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _text_mark().alias("_mark"))
    rows = saved(spark, rows.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_listed"))).select("key", "text"), "named", compression="zstd")
    dropped = near_dedup.near_groups(spark, rows).where("key <> comp").select("key").distinct()
    return _matched(docs, saved(spark, names.join(dropped, "key", "left_semi").select("doc_id", "mark"), "near"), _text_mark(), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    own = docs.select("text", F.struct(*docs.columns).alias("_row"))  # whatever the columns' names are
    rows = decontamination.scored(spark, own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.where("NOT contaminated").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(spark, docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies_removed),
    ("near_dedup", near_copies_removed),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
