"""Which pages of a site are looked at: the choice among its sitemaps, or reachability by links; and findings on that choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import graph, site_files

# Where sitemaps lie by convention, and endings of addresses that are files rather than pages
SITEMAPS = ["/sitemap-index.xml", "/sitemap_index.xml", "/sitemap.xml"]
FILE_ENDINGS = ["avif", "css", "csv", "doc", "docx", "eot", "gif", "gz", "ico", "jpeg", "jpg", "js", "json", "mp3", "mp4", "pdf", "png", "svg", "ttf", "txt", "wav", "webm", "webp", "woff", "woff2", "xls", "xlsx", "xml", "zip"]
FILE = rf"(?i)\.({'|'.join(FILE_ENDINGS)})($|\?)"
HAS_LOCATION = r"(?is)<url\b[^>]*>.*?<loc>\s*\S"


def sitemap_candidates(sites: DataFrame, robots: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(site, url, rank): what robots.txt declares, in its order, then the conventional places.

    robots: site, body. explicit: site, url of sites whose sitemap is given; they have no other candidate.
    """
    lines = robots.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("rank", "line"))
    declared = lines.select("site", F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)\s*$", 1).alias("url"), "rank").where("url <> ''")
    places = F.array(*(F.struct(F.lit(2**30 + k).alias("rank"), F.lit(p).alias("path")) for k, p in enumerate(SITEMAPS)))
    usual = sites.select("site", F.explode(places).alias("p")).select("site", F.concat("site", "p.path").alias("url"), F.col("p.rank").alias("rank"))
    every = declared.unionByName(usual)
    if explicit is not None:
        every = every.join(explicit.select("site").distinct(), "site", "left_anti").unionByName(explicit.select("site", "url", F.lit(0).alias("rank")))
    return every.groupBy("site", "url").agg(F.min("rank").alias("rank"))


def answers(starts: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, start, body) of addresses (site, url) whose redirects end at an ok response."""
    chains = graph.redirect_chains(starts, responses).where(F.col("final_status").between(200, 299))
    bodies = responses.select("site", F.col("url").alias("final_url"), "body")
    return chains.select("site", "start", "final_url").join(bodies.hint("merge"), ["site", "final_url"]).select("site", "start", "body")


def chosen_sitemaps(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, source, url, seq, body): the files of each site's first candidate that lists any page; an index counts by its children.

    responses: (site, url, status, location, body), one row for an address. Only small rows decide; bodies are joined for the chosen.
    """
    asked = candidates.select("site", F.col("url").alias("start"), "rank")
    found = graph.kept(asked.join(answers(candidates, responses).hint("merge"), ["site", "start"]).where(F.col("body").rlike("(?i)<(urlset|sitemapindex)")), "sitemaps")
    lists = F.col("body").rlike(HAS_LOCATION)
    own = found.where(lists).select("site", "rank", F.col("start").alias("source"), F.col("start").alias("url"), F.lit(0).alias("seq"), "body")
    children = site_files.sitemap_children(found.where(~lists).select("site", F.col("start").alias("url"), "body"))
    children = children.select("site", F.col("file").alias("source"), F.col("child").alias("start"), (F.col("pos") + 1).alias("seq"))
    loaded = answers(children.select("site", F.col("start").alias("url")), responses).where(lists)
    nested = children.join(loaded.hint("merge"), ["site", "start"]).join(asked.withColumnRenamed("start", "source").hint("merge"), ["site", "source"])
    every = own.unionByName(nested.select("site", "rank", "source", F.col("start").alias("url"), "seq", "body"))
    first = every.groupBy("site").agg(F.min("rank").alias("rank"))
    return every.join(first.hint("merge"), ["site", "rank"]).select("site", "source", "url", "seq", "body")


def link_edges(links: DataFrame, chains: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(site, src, dst, pos, url): internal links between pages, redirects followed; aliases of a page are one page.

    Left out: files, addresses that robots may not visit (verdicts: site, path, allowed), targets that leave the site
    or have no response. src and dst are addresses without a trailing slash; url is where the link ends.
    """
    # what becomes of a target is found out once for each; links, of which there are many more, then meet targets once
    ends = chains.where("final_status is not null").select("site", "start", F.col("final_url").alias("url")).where(~F.col("start").rlike(FILE))
    ends = ends.where(urls.origin(F.col("url")) == F.col("site")).withColumn("dst", urls.bare(F.col("url")))
    if verdicts is not None:
        barred = verdicts.where("not allowed").select("site", "path").distinct()
        ends = ends.withColumn("path", urls.path(F.col("start"))).join(barred.hint("merge"), ["site", "path"], "left_anti").drop("path")
    ends = graph.kept(ends.select("site", "start", "url", "dst"), "ends")
    t = links.where("kind = 'internal'").select("site", urls.bare(F.col("src_url")).alias("src"), "pos", F.regexp_replace("href", "#.*$", "").alias("start"))
    t = t.join(graph.few(ends), ["site", "start"])
    return t.where("src <> dst").groupBy("site", "src", "dst").agg(F.min("pos").alias("pos"), F.min_by("url", F.struct("pos", "start")).alias("url"))


def reachable(homes: DataFrame, edges: DataFrame, budget: int | None = None, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (site, k, url, depth, trail) that links lead to from home, level by level, and (site, left): linked from these, but not visited.

    homes: site, url (where the home page's redirects end). trail lists the positions of the links on the way, so that
    (depth, trail) is the order of visits without ranking a site's pages in one task. With a budget, a site's first so
    many pages in this order are visited, and `left` is a floor: pages behind unvisited ones aren't known.
    """
    spark, trail = homes.sparkSession, F.expr("cast(array() as array<int>)")
    links, levels = graph.Buckets(spark, "edges", ["site", "src"], ordered=True), graph.Buckets(spark, "levels", ["site", "k"])
    try:
        links.append(edges.repartition("site", "src"))
        first = homes.groupBy("site", urls.bare(F.col("url")).alias("k")).agg(F.min("url").alias("url")).withColumn("trail", trail)
        frontier = levels.append(first)
        while not frontier.isEmpty() and (max_depth is None or levels.depth < max_depth):
            frontier = levels.append(_next_level(frontier, links.read(), levels.read(), budget))
    finally:
        edges = links.close().drop("depth")
        seen = levels.close().select("site", "k", "url", "depth", "trail")
    keys = seen.select("site", "k")
    known = edges.join(keys.withColumnRenamed("k", "src").hint("merge"), ["site", "src"], "left_semi").select("site", F.col("dst").alias("k")).distinct()
    left = known.join(keys.hint("merge"), ["site", "k"], "left_anti").groupBy("site").agg(F.count("*").alias("left"))
    return seen, left


def _next_level(frontier: DataFrame, edges: DataFrame, seen: DataFrame, budget: int | None) -> DataFrame:
    """(site, k, url, trail) of pages that the frontier links to and that weren't seen, as many as the budget has room for. Links and pages seen aren't shuffled."""
    step = frontier.select("site", F.col("k").alias("src"), "trail").join(edges.hint("merge"), ["site", "src"])
    step = step.groupBy("site", F.col("dst").alias("k")).agg(F.min(F.struct(F.concat("trail", F.array(F.col("pos").cast("int"))).alias("trail"), "url")).alias("at"))
    step = step.join(seen.select("site", "k").hint("merge"), ["site", "k"], "left_anti").select("site", "k", "at.url", "at.trail")
    if budget is not None:
        room = seen.groupBy("site").agg((F.lit(budget) - F.count("*")).alias("room"))
        # the rank is bounded by a constant, so each task sends on no more than the budget
        rank = F.row_number().over(Window.partitionBy("site").orderBy("trail", "k"))
        step = step.withColumn("n", rank).where(F.col("n") <= budget).join(room.hint("merge"), "site").where("n <= room").select("site", "k", "url", "trail")
    return step


def run_findings(sites: DataFrame, responses: DataFrame, entries: DataFrame, crawled: DataFrame, left: DataFrame) -> DataFrame:
    """unreachable, nothing-crawlable and truncated. crawled: site, status of the pages looked at; left: site, left."""
    listed, answered = entries.select("site").distinct(), responses.where("status > 0").select("site").distinct()
    unlisted = sites.select("site").distinct().join(listed, "site", "left_anti")
    silent = unlisted.join(answered, "site", "left_anti")
    good = crawled.where(F.col("status").between(200, 299)).select("site").distinct()
    empty = unlisted.join(answered, "site", "left_semi").join(good, "site", "left_anti")
    return (
        site_files._site_rows(silent, "error", "unreachable", "The site answers nothing", F.lit(""))
        .unionByName(site_files._site_rows(empty, "error", "nothing-crawlable", "There is no page to look at", F.lit("")))
        .unionByName(site_files._site_rows(left.where("left > 0"), "info", "truncated", "More pages are known than were looked at", F.col("left")))
    )
