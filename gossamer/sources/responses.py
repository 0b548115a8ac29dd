"""Response tables: the log, pages as responses, statuses of assets."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.functions import urls

RESPONSES = "site string, method string, url string, seq long, status int, headers map<string,string>, body string, location string, ms int, error string, fetched_at timestamp"


def latest(log: DataFrame) -> DataFrame:
    """One row for each method and url of a site: the one fetched last (ties: the largest seq)."""
    w = Window.partitionBy("site", "method", "url").orderBy(F.desc("fetched_at"), F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Superseded rows that are sent to all executors.
SENT_ROWS = 200_000


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """latest() of a response log in Parquet files, without moving a body.

    Keys and times alone tell which rows are superseded, each known by its file and place; these few are taken out where
    bodies are read. (Equal times and seqs: the last by file and place.)
    """
    log = spark.read.schema(RESPONSES).parquet(path)
    keys, own = ["site", "method", "url"], ["_file", "_row"]
    at = {"_file": F.xxhash64("_metadata.file_path", "_metadata.file_size"), "_row": F.col("_metadata.row_index")}
    rows = log.select(*keys, "fetched_at", "seq", *(c.alias(n) for n, c in at.items()))
    order = F.struct("fetched_at", "seq", *own)
    last = rows.groupBy(*keys).agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = last.select(*(F.col(k).alias(f"_{k}") for k in keys), "last")
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    gone = rows.join(last.hint("merge"), same).where(~order.eqNullSafe(F.col("last"))).select(*own)
    few = gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return log.withColumns(at).join(gone.hint("broadcast" if few else "merge"), own, "left_anti").drop(*own)


def from_pages(pages: DataFrame, site=None) -> DataFrame:
    """(page_id, url, html) as responses: status 200, text/html. site: an expression, the url's origin by default."""
    return pages.select(
        (urls.origin(F.col("url")) if site is None else site).alias("site"),
        F.lit("GET").alias("method"),
        "url",
        F.col("page_id").alias("seq"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        F.col("html").alias("body"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("int").alias("ms"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def asset_status(responses: DataFrame) -> DataFrame:
    """(site, url, status): that of HEAD, unless it is 405 or 501 or there is none; then that of GET."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("status")))
    both = responses.groupBy("site", "url").agg(of("HEAD").alias("head"), of("GET").alias("get"))
    return both.select("site", "url", F.when(F.col("head").isNull() | F.col("head").isin(405, 501), F.coalesce("get", "head")).otherwise(F.col("head")).alias("status"))
