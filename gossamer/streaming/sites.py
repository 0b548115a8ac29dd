"""Rules over whole sites on a feed: each batch of responses judges anew the sites it has responses of, and those alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gossamer.operators import findings, graph
from gossamer.plans import audit
from gossamer.sources import responses


def judge_changed_sites(stream: DataFrame, log: str, out: str, checkpoint: str, as_of=None, judge: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, once: bool = False) -> StreamingQuery:
    """Keep the log of a stream of responses, and the findings of its sites, up to date.

    A batch is appended to the log, a folder by site and batch (so one that is repeated after a failure replaces itself); the sites it has
    responses of are read from their folders, judged, and replace their findings below `out`. Sites without news are neither read
    nor written. judge(responses) gives findings and runs: the whole audit at as_of by default.
    """
    if judge is None:
        judge = lambda r: audit.audit({"responses": r}, as_of)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        kept = rows.withColumn("batch", F.lit(number))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "batch").parquet(log)
        whole = spark.read.schema(responses.RESPONSES + ", batch int").parquet(log)
        # folders of sites are pruned when the names of changed ones are known; they are sent only if they are few
        changed = graph.kept(spark.read.schema(responses.RESPONSES + ", batch int").parquet(log).where(F.col("batch") == number).select("site").distinct(), "changed")
        if changed.isEmpty():
            return
        few = changed.limit(findings.SENT_RULES + 1).count() <= findings.SENT_RULES
        news = whole.join(changed.hint("broadcast" if few else "merge"), "site", "left_semi").drop("batch")
        found, runs = judge(news)
        findings.write_findings(found, out, "parquet", runs=runs)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
