"""Robots, sitemap and redirect-map bodies: their rows, the verdicts and findings on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.functions.text import decoded, first, trimmed
from gossamer.operators import cross_rules, graph, pattern_index

MAX_URLS, MAX_BYTES = 50_000, 50 * 1024 * 1024
#: Redirect rules with these aren't followed.
PLACEHOLDER = r"\*|/:"


def robots_rules(bodies: DataFrame) -> DataFrame:
    """(site, group_no, agent, allow, path) of (site, body): agent lines in a row share a group; rules before any agent are dropped."""
    lines = bodies.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw")).withColumn("line", trimmed(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.select("site", "n", F.lower(trimmed(F.substring_index("line", ":", 1))).alias("field"), trimmed(F.regexp_replace("line", "^[^:]*:", "")).alias("value"), F.col("line").contains(":").alias("has")).where("has and field in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("site").orderBy("n")
    agent = F.col("field") == "user-agent"
    opens = (agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")).cast("int")
    lines = lines.withColumn("opens", opens).withColumn("group_no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("group_no > 0")
    agents = lines.where(agent).select("site", "group_no", F.lower("value").alias("agent"))
    rules = lines.where(~agent).select("site", "group_no", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules.hint("merge"), ["site", "group_no"], "left")


def robots_verdicts(paths: DataFrame, rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    """(site, path, allowed, rule) of the distinct paths (site, path): the group of the agent, else of *; the longest pattern wins, ties allow."""
    group = rules.groupBy("site").agg(F.coalesce(F.min(F.when(F.col("agent") == agent, F.col("group_no"))), F.min(F.when(F.col("agent") == "*", F.col("group_no")))).alias("group_no"))
    mine = rules.join(graph.few(group), ["site", "group_no"]).where("path <> ''").select("site", "allow", F.col("path").alias("rule")).distinct()
    rule = F.struct(F.length("rule").alias("n"), "allow", "rule")
    verdict = pattern_index.best(paths, mine, ["site"], rule, rule, pattern="rule")
    return verdict.select("site", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("best.rule").alias("rule"))


def _texts(block: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(block, F.lit(rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1)), decoded)


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(site, file, pos, loc, lastmod) of (site, url, body): a lastmod belongs to the location of its own <url> block."""
    blocks = bodies.select("site", F.col("url").alias("file"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))).alias("pos", "b"))
    return blocks.select("site", "file", "pos", F.try_element_at(_texts(F.col("b"), "loc"), F.lit(1)).alias("loc"), F.try_element_at(_texts(F.col("b"), "lastmod"), F.lit(1)).alias("lastmod")).where("loc is not null")


def sitemap_children(bodies: DataFrame) -> DataFrame:
    blocks = bodies.select("site", F.col("url").alias("file"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1))).alias("pos", "b"))
    return blocks.select("site", "file", "pos", F.try_element_at(_texts(F.col("b"), "loc"), F.lit(1)).alias("child")).where("child is not null")


def sitemap_files(bodies: DataFrame) -> DataFrame:
    """(site, url, urls, bytes): sizes of each file."""
    return bodies.select("site", "url", F.size(F.regexp_extract_all("body", F.lit(r"(?i)<url\b"), F.lit(0))).alias("urls"), F.octet_length("body").alias("bytes"))


def instant(s: Column) -> Column:
    """A timestamp from ISO or RFC 1123 forms; NULL if it is neither."""
    rfc = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss z")))


def _site_rows(df: DataFrame, level: str, rule: str, title: str, detail: Column, url: str = "site") -> DataFrame:
    evidence = F.col("evidence") if "evidence" in df.columns else F.lit(None).cast("string").alias("evidence")
    return df.select("site", F.col(url).alias("url"), F.lit(None).cast("long").alias("seq"), F.lit(level).alias("level"), F.lit(rule).alias("id"), F.lit(title).alias("title"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"), evidence)


def sitemap_findings(files: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Sizes of sitemap files, and what their dates say."""
    big = _site_rows(files.where(F.col("urls") > MAX_URLS), "error", "sitemap-too-many-urls", "The sitemap lists too many addresses", F.col("urls"), "url")
    heavy = _site_rows(files.where(F.col("bytes") > MAX_BYTES), "error", "sitemap-too-large", "The sitemap is too large", F.col("bytes"), "url")
    dated = F.coalesce("lastmod", F.lit("")) != ""
    late = instant(F.col("lastmod")) > as_of + F.expr("interval 1 day")
    g = entries.groupBy("site").agg(F.count_if(dated).alias("dated"), F.count_distinct(F.when(dated, F.col("lastmod"))).alias("values"), F.count_if(dated & late).alias("late"))
    return (
        big.unionByName(heavy)
        .unionByName(_site_rows(g.where("dated = 0"), "info", "sitemap-lastmod-missing", "No entry has a date", F.lit("")))
        .unionByName(_site_rows(g.where("late > 0"), "warn", "sitemap-lastmod-future", "Entries are dated in the future", F.col("late")))
        .unionByName(_site_rows(g.where("dated >= 5 and values = 1"), "info", "sitemap-lastmod-identical", "All entries have one date", F.col("dated")))
    )


def sitemap_not_indexable(entries: DataFrame, features: DataFrame, hidden: DataFrame) -> DataFrame:
    """Listed live pages that must not be indexed: one row for a site."""
    listed = entries.select("site", F.col("loc").alias("url")).distinct().join(features.select("site", "url").distinct().hint("merge"), ["site", "url"], "left_semi").join(hidden.hint("merge"), ["site", "url"])
    g = listed.groupBy("site", "reason").agg(F.count("*").alias("n")).groupBy("site").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "reason", "n"))), ", ").alias("evidence"))
    return _site_rows(g, "warn", "sitemap-not-indexable", "The sitemap lists pages that aren't to be indexed", F.col("n"))


def robots_findings(sites: DataFrame, bodies: DataFrame, entries: DataFrame, responses: DataFrame) -> DataFrame:
    """Missing or contradicting robots, sitemap and llms files. sites: site; bodies: site, body of robots.txt that answered well."""
    rules = robots_rules(bodies)
    missing = _site_rows(sites.join(bodies.hint("merge"), "site", "left_anti"), "warn", "robots-missing", "No robots.txt", F.lit(""))
    all_blocked = robots_verdicts(bodies.select("site", F.lit("/").alias("path")), rules).where("not allowed").select("site", "rule")
    blocked = _site_rows(all_blocked, "error", "robots-blocks-all", "Robots may not visit the site", F.col("rule"))
    silent = _site_rows(bodies.where(~F.col("body").rlike(r"(?im)^\s*sitemap\s*:")), "info", "robots-no-sitemap", "robots.txt names no sitemap", F.lit(""))
    listed = entries.select("site", urls.path(F.col("loc")).alias("path")).join(graph.few(all_blocked), "site", "left_anti")
    verdicts = robots_verdicts(listed, rules).where("not allowed")
    barred = verdicts.groupBy("site").agg(F.count("*").alias("n")).join(cross_rules.examples(verdicts, ["site"], "path", ["path"], 3).hint("merge"), "site")
    shut = _site_rows(barred, "error", "robots-blocks-sitemap-url", "Robots may not visit listed addresses", F.col("n"))
    llms = responses.where(F.col("url").endswith("/llms.txt") & F.col("status").between(200, 299)).select("site").distinct()
    no_llms = _site_rows(sites.join(llms.hint("merge"), "site", "left_anti"), "info", "llms-missing", "No llms.txt", F.lit(""))
    no_map = _site_rows(sites.join(entries.select("site").distinct().hint("merge"), "site", "left_anti"), "warn", "no-sitemap", "No sitemap", F.lit(""))
    return missing.unionByName(blocked).unionByName(silent).unionByName(shut).unionByName(no_llms).unionByName(no_map)


def redirect_rules(lines: DataFrame) -> DataFrame:
    """(site, line_no, src, dst, status) of (site, line_no, line): comments and blank lines aside, target and status optional; 301! is 301."""
    parts = F.split(trimmed(F.regexp_replace("line", r"(^|\s)#.*$", "")), r"(?U)\s+")
    d = lines.select("site", "line_no", parts.alias("p")).where("p[0] <> ''")
    code = lambda c: F.regexp_extract(c, r"^(\d{3})!?$", 1)
    second, third = F.try_element_at("p", F.lit(2)), F.try_element_at("p", F.lit(3))
    only_status = F.coalesce(code(second) != "", F.lit(False))
    return d.select("site", "line_no", F.col("p")[0].alias("src"), F.when(~only_status, second).alias("dst"), F.when(only_status, code(second)).otherwise(code(third)).try_cast("int").alias("status"))


def redirect_findings(rules: DataFrame, chains: DataFrame) -> DataFrame:
    """One row for a site and outcome, with its count. rules: src and dst absolute; chains: of (site, start)."""
    pattern = F.col("src").rlike(PLACEHOLDER)
    skipped = _site_rows(rules.where(pattern).groupBy("site").agg(F.count("*").alias("n")), "info", "redirect-pattern-skipped", "Rules with placeholders aren't followed", F.col("n"))
    j = rules.where(~pattern).join(chains.withColumnRenamed("start", "src").hint("merge"), ["site", "src"])
    hop, good = F.try_element_at("hops", F.lit(1))["status"], F.col("final_status").between(200, 299)
    moved = F.size(F.filter("hops", lambda h: h["status"].between(300, 399)))
    exact = F.col("dst").isNotNull() & ~F.col("dst").rlike(PLACEHOLDER)
    later = F.array(F.when(moved > 1, F.lit("redirect-hops")), F.when((F.col("status") == 301) & (hop == 302), F.lit("redirect-temporary")), F.when(exact & (urls.bare(F.col("dst")) != urls.bare(F.col("final_url"))), F.lit("redirect-elsewhere")))
    kinds = F.when(hop.isNull() | F.col("final_status").isNull(), F.expr("cast(array() as array<string>)")).when(hop.isin(404, 410, 0), F.array(F.lit("redirect-dead"))).when(hop.between(200, 299), F.array(F.lit("redirect-not-applied"))).when(~good, F.array(F.lit("redirect-broken"))).otherwise(F.filter(later, lambda x: x.isNotNull()))
    g = j.select("site", F.explode(kinds).alias("id")).groupBy("site", "id").agg(F.count("*").alias("n"))
    level = F.when(F.col("id").isin("redirect-dead", "redirect-broken"), "error").otherwise("warn")
    return skipped.drop("evidence").unionByName(g.select("site", F.col("site").alias("url"), F.lit(None).cast("long").alias("seq"), level.alias("level"), "id", F.lit("Redirect rules don't work as written").alias("title"), F.col("n").cast("string").alias("detail")))
