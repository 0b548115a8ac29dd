"""Rules over all pages of a site: duplicates, orphans, anchors, alternates, depth.

Hot keys (a footer link is the target of every page, a title may be shared by all) are aggregated before
the shuffle; samples are bounded and come from min_by and ranked rows, never from unbounded lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import graph
from gossamer.operators.features import anchor_phrase

# Phrases that say nothing about where a link leads
GENERIC = ["click", "click here", "continue reading", "details", "find out more", "go", "here", "learn more", "link", "more", "more info", "more information", "open", "read more", "read the rest", "see more", "this", "this link", "this page", "view", "view more"]
TOP_DEEP, TOP_NAMELESS, TOP_GENERIC = 20, 10, 10


def _rows(df: DataFrame, level: str, rule: str, title: str, detail: Column | None = None) -> DataFrame:
    d = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    evidence = F.col("evidence") if "evidence" in df.columns else F.lit(None).cast("string").alias("evidence")
    return df.select("site", "url", "seq", F.lit(level).alias("level"), F.lit(rule).alias("id"), F.lit(title).alias("title"), d.alias("detail"), evidence)


def _rest(df: DataFrame, top: int, rule: str, title: str) -> DataFrame:
    """One row for a site that has more than `top` ranked rows."""
    more = df.groupBy("site").agg((F.count("*") - top).alias("n")).where("n > 0")
    return _rows(more.select("site", F.col("site").alias("url"), F.lit(None).cast("long").alias("seq"), "n"), "info", rule, title, F.col("n"))


def examples(df: DataFrame, keys: list[str], value: str, order: list[str], n: int) -> DataFrame:
    """keys and evidence: the first n values of each group by `order`, in one text. Ranks beyond n end before the shuffle."""
    top = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return top.groupBy(*keys).agg(F.array_join(listed, ", ").alias("evidence"))


def duplicates(features: DataFrame, column: str, rule: str, shown: int = 4) -> DataFrame:
    """Pages of a site that share a text; the first in crawl order stands for them, and the first few are named."""
    some = features.where(F.coalesce(F.col(column), F.lit("")) != "").select("site", "url", "seq", F.xxhash64(column).alias("h"), column)
    g = some.groupBy("site", "h", column).agg(F.count("*").alias("n"), F.min_by("url", F.struct("seq", "url")).alias("url"), F.min("seq").alias("seq")).where("n > 1")
    named = examples(some, ["site", "h", column], "url", ["seq", "url"], shown)
    return _rows(g.join(named.hint("merge"), ["site", "h", column]), "warn", rule, "Several pages share this text", F.col("n"))


def orphans(features: DataFrame, links: DataFrame, homes: DataFrame) -> DataFrame:
    """Pages that no internal link leads to. homes: site, url."""
    targets = links.where("kind = 'internal'").select("site", urls.key(F.col("href")).alias("k")).distinct()
    pages = features.select("site", "url", "seq", urls.bare(F.col("url")).alias("k")).join(homes.select("site", urls.bare(F.col("url")).alias("k")).distinct().hint("merge"), ["site", "k"], "left_anti")
    return _rows(pages.join(targets.hint("merge"), ["site", "k"], "left_anti"), "warn", "orphan-page", "No page links here")


def nameless_links(anchors: DataFrame, top: int = TOP_NAMELESS) -> DataFrame:
    """Targets whose every inbound link is without a name; the most linked first, with the first page that links there."""
    nameless = F.col("name") == ""
    g = anchors.groupBy("site", urls.bare(F.col("href")).alias("k")).agg(F.count("*").alias("n"), F.count_if(~nameless).alias("named"), F.min_by("href", F.struct("src_seq", "pos")).alias("url"), F.min(F.struct("src_seq", "pos")).alias("at"), F.min_by("src_url", F.struct("src_seq", "pos")).alias("evidence")).where("named = 0")
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "at"))).withColumn("seq", F.col("at.src_seq"))
    return _rows(g.where(F.col("rank") <= top), "warn", "link-no-text", "All links here are without a text", F.col("n")).unionByName(_rest(g, top, "link-no-text-more", "More link targets without a text"))


def generic_anchors(anchors: DataFrame, features: DataFrame, top: int = TOP_GENERIC) -> DataFrame:
    """Pages that are only linked to by phrases that say nothing about them."""
    named = anchors.where("name <> ''").withColumn("generic", anchor_phrase(F.col("name")).isin(GENERIC))
    g = named.groupBy("site", urls.bare(F.col("href")).alias("k")).agg(F.bool_and("generic").alias("all_generic"), F.min(F.lower("name")).alias("example")).where("all_generic")
    pages = features.select("site", "url", "seq", urls.key(F.col("url")).alias("k")).join(g.hint("merge"), ["site", "k"])
    pages = pages.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("seq", "url")))
    return _rows(pages.where(F.col("rank") <= top), "info", "anchor-generic", "Links here don't say what the page is", F.col("example")).unionByName(_rest(pages, top, "anchor-generic-more", "More pages with generic links only"))


def alternates_without_default(features: DataFrame) -> DataFrame:
    langs = F.transform("hreflang", lambda x: F.lower(x["lang"]))
    g = features.where(F.size("hreflang") > 0).groupBy("site").agg(F.bool_or(F.array_contains(langs, "x-default")).alias("has"), F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
    return _rows(g.where("not has"), "info", "hreflang-no-x-default", "No page names a default alternate")


def one_way_alternates(features: DataFrame) -> DataFrame:
    """Alternates within the crawl that don't point back."""
    e = features.select("site", "url", "seq", F.explode("hreflang").alias("a")).where("a.lang <> 'x-default'")
    e = e.select("site", "url", "seq", urls.bare(F.col("url")).alias("src"), urls.bare(F.col("a.href")).alias("dst"), F.col("a.href").alias("href")).where("src <> dst")
    known = features.select("site", urls.bare(F.col("url")).alias("dst")).distinct()
    back = features.select("site", F.explode("hreflang").alias("a"), urls.bare(F.col("url")).alias("dst")).select("site", "dst", urls.bare(F.col("a.href")).alias("src")).distinct()
    return _rows(e.join(known.hint("merge"), ["site", "dst"], "left_semi").join(back.hint("merge"), ["site", "dst", "src"], "left_anti"), "error", "hreflang-one-way", "The alternate doesn't point back", F.col("href"))


def depth_findings(features: DataFrame, depths: DataFrame, links: DataFrame, homes: DataFrame, max_depth: int = 4, truncated: DataFrame | None = None, top: int = TOP_DEEP, limits: DataFrame | None = None) -> DataFrame:
    """deep-page, no-path-from-home and their guards; depths: site, k (bare url), depth, via. limits: site, max_click_depth, which go before max_depth."""
    pages = features.select("site", "url", "seq", urls.key(F.col("url")).alias("k")).join(graph.few(homes.select("site").distinct()), "site", "left_semi")
    # all that follows is read from what is kept: pages meet their depths once
    placed = graph.kept(pages.join(depths.select("site", "k", "depth").hint("merge"), ["site", "k"], "left"), "placed")
    share = placed.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("depth").isNull()).alias("stranded"))
    skipped = share.where((F.col("n") >= 5) & (F.col("stranded") > 0.3 * F.col("n")))
    if truncated is not None:
        skipped = share.join(graph.few(truncated.select("site").distinct()), "site", "left_semi").unionByName(skipped).distinct()
    skipped = graph.kept(skipped, "skipped")
    skip_rows = _rows(skipped.select("site", F.col("site").alias("url"), F.lit(None).cast("long").alias("seq"), "stranded"), "info", "click-depth-skipped", "Click depth isn't judged: too little of the site is linked", F.col("stranded"))
    judged = placed.join(graph.few(skipped.select("site")), "site", "left_anti")
    targets = links.where("kind = 'internal'").select("site", urls.key(F.col("href")).alias("k")).distinct()
    lost = _rows(judged.where("depth is null").join(targets.hint("merge"), ["site", "k"], "left_semi"), "warn", "no-path-from-home", "No path of links from the home page")
    # a site whose depth isn't judged by its own limit has the common one; pages at the home page's depth are never deep, so few rows meet limits
    deep = judged.where("depth > 0")
    if limits is None:
        deep = deep.where(F.col("depth") > max_depth)
    else:
        own = limits.select("site", F.col("max_click_depth").alias("_limit"))
        deep = deep.join(graph.few(own), "site", "left").where(F.col("depth") > F.coalesce("_limit", F.lit(max_depth))).drop("_limit")
    deep = graph.kept(deep, "deep")
    first = graph.kept(deep.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("depth"), "seq", "url"))).where(F.col("rank") <= top), "deep-pages")
    way = graph.routes(depths, first.select("site", "k").distinct()).select("site", "k", F.array_join(F.transform("route", lambda x: urls.path(x.cast("string"))), " > ").alias("evidence"))
    shown = first.join(way.hint("merge"), ["site", "k"], "left")
    return skip_rows.unionByName(lost).unionByName(_rows(shown, "info", "deep-page", "Many clicks from the home page", F.col("depth"))).unionByName(_rest(deep, top, "deep-page-more", "More deep pages"))


def cross_page_findings(features: DataFrame, links: DataFrame, anchors: DataFrame, homes: DataFrame) -> DataFrame:
    parts = [duplicates(features, "title", "duplicate-title"), duplicates(features, "description", "duplicate-description"), orphans(features, links, homes), nameless_links(anchors), generic_anchors(anchors, features), alternates_without_default(features), one_way_alternates(features)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
