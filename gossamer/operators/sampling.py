"""Targets and samples: globs over paths, spread samples, capped sweeps."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import graph, pattern_index


def glob_matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(site, path, glob) of paths (site, path) and globs (site, glob) that match as a whole."""
    return pattern_index.matches(paths.select("site", "path").distinct(), globs.select("site", "glob").distinct(), ["site"], "glob", end=True).select("site", "path", "glob")


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with _at (place in the group from 0, by `order`) and _size of each group.

    Rows are dealt by ranges of group and order, numbered within each range and moved by what lies before it, so a group
    that holds most rows is spread over many tasks.
    """
    ranged = graph.kept(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    before = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_size"))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1)
    same = [local[c].eqNullSafe(before[c]) for c in [*by, "_range"]]
    whole = local.join(before.hint("merge"), functools.reduce(operator.and_, same))
    return whole.select(*(local[c] for c in rows.columns), (local["_at"] + before["_before"]).alias("_at"), before["_size"])


def spread_sample(rows: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Items floor(i * size / n) for i < n of each group, in order; all of a group of n or fewer."""
    d = placed(rows, by, order)
    # the first place of step i is the smallest place p with floor(p * n / size) = i after rounding up
    step = F.ceil(F.col("_at") * n / F.col("_size"))
    chosen = (F.col("_size") <= n) | ((step < n) & (F.floor(step * F.col("_size") / n) == F.col("_at")))
    return d.where(chosen).drop("_at", "_size")


def sample_targets(entries: DataFrame, pages: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Targets (site, url) of entries (site, entry): addresses and paths as they are, globs as a spread sample of matching pages; and notes on globs."""
    star = F.col("entry").contains("*")
    direct = entries.where(~star).select("site", F.when(F.col("entry").rlike("^https?://"), F.col("entry")).otherwise(F.concat("site", "entry")).alias("url"))
    globs = entries.where(star).select("site", F.col("entry").alias("glob"))
    p = pages.select("site", "url", "seq", urls.path(F.col("url")).alias("path"))
    hits = graph.kept(p.join(glob_matches(p, globs).hint("merge"), ["site", "path"]), "glob-hits")
    counts = globs.join(hits.groupBy("site", "glob").agg(F.count("*").alias("n")).hint("merge"), ["site", "glob"], "left").fillna(0, ["n"])
    notes = counts.where((F.col("n") == 0) | (F.col("n") > n)).select("site", F.col("glob").alias("url"), F.lit(None).cast("long").alias("seq"), F.lit("info").alias("level"), F.when(F.col("n") == 0, "psi-no-match").otherwise("psi-sampled").alias("id"), F.lit("A pattern of pages to measure").alias("title"), F.col("n").cast("string").alias("detail"))
    return direct.unionByName(spread_sample(hits, n, ["site", "glob"], ["seq", "url"]).select("site", "url")).distinct(), notes


def capped(targets: DataFrame, cap: int | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first `cap` targets of each site (all if None), and (site, left) of those beyond."""
    if cap is None:
        return targets, targets.groupBy("site").agg(F.lit(0).cast("long").alias("left")).limit(0)
    d = targets.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    left = targets.groupBy("site").agg((F.count("*") - cap).alias("left")).where("left > 0")
    return d.where(F.col("_n") <= cap).drop("_n"), left
