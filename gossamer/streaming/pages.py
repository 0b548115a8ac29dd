"""Page rules on a feed of responses. The rules keep no state, so a stream takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gossamer.operators import features, page_rules
from gossamer.sources.responses import RESPONSES


def read_responses(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder of responses."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def page_findings(stream: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Findings of each response as it arrives; limits is a static table of sites."""
    return page_rules.page_findings(stream, features.page_features(stream), limits)


def latest_findings(stream: DataFrame, delay: str = "1 hour", limits: DataFrame | None = None) -> DataFrame:
    """The same, with an address judged once within `delay` of fetched_at; later copies of it are left out."""
    once = stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["site", "method", "url"])
    return page_findings(once, limits)


def write_findings(findings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append findings as Parquet by site; `once` works off what is there and ends."""
    writer = findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("site").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def answers_by_window(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(site, start, answered, failed, slowest): how sites answer in each window of fetched_at; late rows within `delay` count."""
    w = stream.withWatermark("fetched_at", delay).groupBy("site", F.window("fetched_at", window).alias("w"))
    good = F.col("status").between(200, 399)
    return w.agg(F.count_if(good).alias("answered"), F.count_if(~good).alias("failed"), F.max("ms").alias("slowest")).select("site", F.col("w.start").alias("start"), "answered", "failed", "slowest")
