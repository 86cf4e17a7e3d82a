"""Boilerplate lines by their frequency within a site.

A page's lines are what stands between its tags. For each line of a host the pages that
contain it are divided by the host's pages, the page in question left out of both: lines that more
than ``RATIO`` of a page's fellow pages contain are dropped from all pages of the host. So a host of one page,
which has no fellows, keeps its lines, and one rule holds for hosts of any size. A host has about (lines of
a page) / ``RATIO`` such lines at most, so a page meets them as one array of its host.

DataFrame functions only. Counts are partial before they are shuffled, so a host or
a line of any frequency costs a row for each task.

Defined results: a null page has no lines; a null or odd URL belongs to the host '';
a line repeated in a page counts once for its share, and all its copies are dropped or
kept; rows that repeat a page count as pages of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import saved

RATIO = 0.3

#: Fixed patterns: parts that are not text, tags, and the host of a URL.
NOT_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
HOST = r"^[a-z][a-z0-9+.-]*://([^/:?#]+)"


def lines_of(html: Column) -> Column:
    """The non-empty trimmed lines between tags, in order."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), NOT_TEXT, "\n"), TAG, "\n")
    trimmed = F.transform(F.split(text, r"[\n\r]+"), lambda x: F.btrim(x, F.lit(" \t")))
    return F.filter(trimmed, lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def line_dedup(spark: SparkSession, pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, lines, kept) for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    rows = saved(spark, rows, "lines", compression="zstd")  # so that pages are parsed once
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    per = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = per.join(total, "host").where(F.col("n") - 1 > ratio * (F.col("total") - 1)).groupBy("host").agg(F.collect_list("line").alias("common"))
    common = saved(spark, common, "common-lines")
    out = rows.join(common, "host", "left")
    kept = F.filter("lines", lambda x: ~F.array_contains("common", x))
    return out.select("page_id", "host", "lines", F.when(F.col("common").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1) AS host,
         list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '[\n\r]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS w
  FROM pages
), t AS (SELECT host, count(*) AS total FROM p GROUP BY 1), l AS (
  SELECT host, line, count(*) AS n FROM (SELECT page_id, host, unnest(list_distinct(w)) AS line FROM p) GROUP BY ALL
), c AS (SELECT host, list(line) AS common FROM l JOIN t USING (host) WHERE n - 1 > 0.3::DOUBLE * (total - 1) GROUP BY 1), k AS (
  SELECT page_id, host, w, CASE WHEN common IS NULL THEN w ELSE list_filter(w, lambda x: NOT list_contains(common, x)) END AS k FROM p LEFT JOIN c USING (host)
)
SELECT page_id, host, CAST(len(w) AS BIGINT) AS n_lines, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, chr(10)), '')) AS kept_sha256 FROM k
"""
