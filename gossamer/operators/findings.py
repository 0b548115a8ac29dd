"""Findings: categories, summaries, portfolio, comparison, gate, ignore rules, indexability, sinks and sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import pattern_index

LEVELS = {"error": 0, "warn": 1, "info": 2}
SCHEMA = "site string, url string, seq long, level string, id string, title string, detail string"

# The areas that rules belong to, in order of presentation
CATEGORIES = {
    "Indexability": [
        "canonical-chain",
        "canonical-dead",
        "canonical-missing",
        "canonical-multiple",
        "canonical-noindex",
        "canonical-other",
        "canonical-redirects",
        "nofollow-page",
        "noindex",
        "nothing-crawlable",
        "page-status",
        "robots-conflict",
        "soft-404",
        "unreachable",
        "x-robots-noindex",
    ],
    "Content": [
        "charset-missing",
        "desc-long",
        "desc-missing",
        "desc-short",
        "duplicate-description",
        "duplicate-title",
        "h1-missing",
        "h1-multiple",
        "heading-skip",
        "lang-missing",
        "thin-content",
        "title-long",
        "title-missing",
        "title-short",
        "viewport-fixed-width",
        "viewport-locked",
        "viewport-missing",
    ],
    "Links": [
        "anchor-generic",
        "anchor-generic-more",
        "broken-link",
        "click-depth-skipped",
        "deep-page",
        "deep-page-more",
        "external-broken",
        "external-redirects",
        "external-sweep-capped",
        "internal-nofollow",
        "link-no-text",
        "link-no-text-more",
        "link-redirects",
        "link-sweep-capped",
        "missing-from-sitemap",
        "missing-from-sitemap-more",
        "no-editorial-links",
        "no-path-from-home",
        "orphan-page",
    ],
    "Redirects": [
        "host-variant-dead",
        "meta-refresh",
        "redirect-broken",
        "redirect-chain",
        "redirect-dead",
        "redirect-elsewhere",
        "redirect-hops",
        "redirect-map-capped",
        "redirect-not-applied",
        "redirect-pattern-skipped",
        "redirect-temporary",
        "sitemap-redirect",
        "trailing-slash",
    ],
    "Images": [
        "broken-image",
        "image-sweep-capped",
        "img-alt",
        "img-alt-duplicate",
        "img-alt-filename",
        "img-alt-long",
        "img-alt-placeholder",
        "img-dimensions",
        "img-srcset",
        "img-title-duplicates-alt",
        "img-title-on-decorative",
    ],
    "Social": [
        "og-image-broken",
        "og-image-heavy",
        "og-image-relative",
        "og-missing",
        "og-no-dimensions",
        "og-webp",
    ],
    "Structured data": [
        "jsonld-invalid",
        "jsonld-no-type",
        "schema-expected",
        "schema-image-broken",
        "schema-incomplete",
    ],
    "Multilingual": [
        "hreflang-dead",
        "hreflang-invalid",
        "hreflang-lang-mismatch",
        "hreflang-no-self",
        "hreflang-no-x-default",
        "hreflang-one-way",
    ],
    "Sitemap & robots": [
        "llms-missing",
        "no-sitemap",
        "robots-blocks-all",
        "robots-blocks-sitemap-url",
        "robots-missing",
        "robots-no-sitemap",
        "sitemap-lastmod-future",
        "sitemap-lastmod-identical",
        "sitemap-lastmod-missing",
        "sitemap-not-indexable",
        "sitemap-too-large",
        "sitemap-too-many-urls",
        "truncated",
    ],
    "Site & security": [
        "header-content-security-policy",
        "header-referrer-policy",
        "header-strict-transport-security",
        "header-x-content-type-options",
        "mixed-content",
        "tls-expired",
        "tls-expiring",
        "url-space",
        "url-underscore",
        "url-uppercase",
    ],
    "Performance": [
        "huge-html",
        "psi-cls",
        "psi-failed",
        "psi-field-cls",
        "psi-field-inp",
        "psi-field-lcp",
        "psi-inp",
        "psi-lcp",
        "psi-no-field-data",
        "psi-no-match",
        "psi-opportunity",
        "psi-sampled",
        "psi-score",
        "slow",
        "uncompressed",
    ],
}


def level_rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warn", 1).otherwise(2)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def categorized(findings: DataFrame) -> DataFrame:
    """findings with category and its rank; an unknown rule belongs to Other, which comes last."""
    rows = [(rule, name, k) for k, (name, rules) in enumerate(CATEGORIES.items()) for rule in rules]
    names = findings.sparkSession.createDataFrame(rows, "id string, category string, category_rank int")
    joined = findings.join(F.broadcast(names), "id", "left")  # a fixed table of rules
    return joined.withColumns({"category": F.coalesce("category", F.lit("Other")), "category_rank": F.coalesce("category_rank", F.lit(len(CATEGORIES)))})


def check_summary(findings: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """A row for each rule: worst level, findings, first title."""
    out = findings.groupBy(*keys, "id").agg(F.min(level_rank(F.col("level"))).alias("rank"), F.count("*").alias("findings"), F.min_by("title", F.struct("seq", "url", "title")).alias("title"))
    return out.withColumn("level", level_name(F.col("rank"))).drop("rank")


def category_summary(findings: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """A row for each area that has findings."""
    out = categorized(findings).groupBy(*keys, "category", "category_rank").agg(F.count("*").alias("findings"), F.count_distinct("id").alias("rules"), level_name(F.min(level_rank(F.col("level")))).alias("worst"))
    return out.drop("category_rank")


def level_counts(findings: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("level") == x).alias(name) for x, name in (("error", "errors"), ("warn", "warnings"), ("info", "notes"))))


def portfolio(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each site of runs (site, pages); `empty` marks sites without pages. Most errors, then most warnings, come first where it is shown."""
    out = runs.join(level_counts(findings), "site", "left").fillna(0, ["errors", "warnings", "notes"])
    return out.withColumn("empty", F.col("pages") == 0)


def portfolio_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("sites"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("pages", "errors", "warnings", "notes")), F.count_if(F.col("errors") > 0).alias("sites_with_errors"))


def diff(before: DataFrame, after: DataFrame, ignore_host: bool = False) -> DataFrame:
    """change (added, fixed, unchanged) of each distinct (site, id, url); with ignore_host, of (id, rest of the url)."""
    keys = ["id", "place"] if ignore_host else ["site", "id", "place"]
    place = F.regexp_replace("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*", "") if ignore_host else F.col("url")
    side = lambda df, name: df.withColumn("place", F.coalesce(place, F.lit(""))).select(*keys).distinct().withColumn(name, F.lit(True))
    both = side(before, "b").join(side(after, "a"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "fixed").otherwise("unchanged").alias("change"))


def gate(sites: DataFrame, findings: DataFrame, fail_on: str = "error", added: DataFrame | None = None) -> DataFrame:
    """(site, passed). fail_on: error, warn, new (any finding added) or never."""
    bad = {"error": findings.where("level = 'error'"), "warn": findings.where("level in ('error', 'warn')"), "new": added, "never": findings.limit(0)}[fail_on]
    failed = bad.select("site").distinct().withColumn("failed", F.lit(True))
    return sites.select("site").distinct().join(failed, "site", "left").select("site", F.col("failed").isNull().alias("passed"))


def gate_portfolio(gates: DataFrame) -> DataFrame:
    """(passed, sites, failed): a portfolio passes if all of its sites do; one without sites passes."""
    return gates.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count("*").alias("sites"), F.count_if(~F.col("passed")).alias("failed"))


def rollup(findings: DataFrame) -> DataFrame:
    """(site, category, level, grouping, findings, rules): counts by site, area and level, and all their totals, in one pass.

    grouping tells totals from groups: 0 is a level of an area of a site, 1 an area of a site, 3 a site, 7 everything.
    """
    counted = categorized(findings).rollup("site", "category", "level").agg(F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("findings"), F.count_distinct("id").alias("rules"))
    return counted.select("site", "category", "level", "grouping", "findings", "rules")


#: Ignore rules that are sent to all executors; more are joined by shuffling.
SENT_RULES = 10_000


def apply_ignores(findings: DataFrame, rules: DataFrame, how: str = "left_anti") -> DataFrame:
    """Findings that no ignore rule silences (or with how="left_semi", those that one does).

    rules: site, id, url_glob (NULL: everywhere); a NULL site means every site. Rules for every site meet findings by
    id, those of a site by site and id. They are broadcast only if they are counted to be few.
    """
    r = pattern_index.indexed(rules.select(F.col("site").alias("r_site"), F.col("id").alias("r_id"), "url_glob"), "url_glob", end=True).drop("url_glob")

    def joined(df: DataFrame, some: DataFrame, keys: Column, how: str) -> DataFrame:
        small = some.limit(SENT_RULES + 1).count() <= SENT_RULES
        path = urls.path(F.col("url"))
        # the glob's literal beginning is compared first; NULL: the rule holds everywhere
        fits = F.when(F.col("_key").isNull(), True).when(F.startswith(path, F.col("_key")), F.rlike(path, F.col("_regex"))).otherwise(False)
        return df.join(some.hint("broadcast" if small else "merge"), keys & fits, how)

    shared, own, same = r.where("r_site is null"), r.where("r_site is not null"), F.col("id") == F.col("r_id")
    rest = joined(findings, shared, same, "left_anti")
    if how == "left_anti":
        return joined(rest, own, same & (F.col("site") == F.col("r_site")), how)
    return joined(findings, shared, same, how).unionByName(joined(rest, own, same & (F.col("site") == F.col("r_site")), how))


def not_indexable(responses: DataFrame, features: DataFrame) -> DataFrame:
    """(site, url, reason): not ok, or noindex by meta element or header, or with its canonical address elsewhere."""
    has = lambda s: F.lower(F.coalesce(s, F.lit(""))).contains("noindex")
    one = F.try_element_at("canonical_refs", F.lit(1))
    elsewhere = (F.size("canonical_refs") > 0) & (urls.bare(one) != urls.bare(F.col("url")))
    reason = F.when(has(F.col("robots")), "noindex").when(has(F.col("headers")["x-robots-tag"]), "x-robots-noindex").when(elsewhere, "canonical-other")
    return responses.where(~F.col("status").between(200, 299)).select("site", "url", F.lit("status").alias("reason")).unionByName(features.select("site", "url", reason.alias("reason")).where("reason is not null")).groupBy("site", "url").agg(F.min("reason").alias("reason"))


def tag_indexable(findings: DataFrame, hidden: DataFrame) -> DataFrame:
    """findings with indexable: false for pages of hidden, else NULL."""
    return findings.join(hidden.select("site", "url", F.lit(False).alias("indexable")).distinct(), ["site", "url"], "left")


def run_summary(responses: DataFrame, findings: DataFrame, hidden: DataFrame, ignored: DataFrame, sitemaps: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """(site, pages, requests, not_indexable, findings, ignored, sitemap, date). sitemaps: site, source of the chosen one; date: that of as_of."""
    pages = responses.groupBy("site").agg(F.count_if(F.col("status").between(200, 299)).alias("pages"), F.count("*").alias("requests"))
    count = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    out = pages.join(count(hidden, "not_indexable"), "site", "left").join(count(findings, "findings"), "site", "left").join(count(ignored, "ignored"), "site", "left")
    out = out.fillna(0)
    if sitemaps is not None:
        out = out.join(sitemaps.groupBy("site").agg(F.min("source").alias("sitemap")), "site", "left")
    else:
        out = out.withColumn("sitemap", F.lit(None).cast("string"))
    return out.withColumn("date", F.lit(None).cast("date") if as_of is None else as_of.cast("date"))


#: What a run's summary says of a site, and how a document holds it.
META = ["pages", "requests", "not_indexable", "findings", "ignored", "sitemap", "date"]
META_TYPE = "struct<pages:bigint,requests:bigint,not_indexable:bigint,findings:bigint,ignored:bigint,sitemap:string,date:string>"
DOCUMENT = f"struct<site:string,date:string,meta:{META_TYPE},findings:array<struct<url:string,seq:bigint,level:string,id:string,title:string,detail:string>>>"
#: Documents that a site's findings are spread over, so that none has to hold them all.
DOCUMENTS = 32


def write_findings(findings: DataFrame, path: str, kind: str = "parquet", date: str | None = None, runs: DataFrame | None = None) -> None:
    """Findings as a table by site, or with kind="json" as documents {"site", "date", "meta", "findings": [...]}, one in a line.

    Sites that are written replace what is there of them; other sites stay. runs (run_summary): sites looked at; each of them is
    written even if it has no findings, which replaces those of an earlier run, and documents carry its summary as meta.
    """
    one = ["url", "seq", "level", "id", "title", "detail"]
    rows = findings
    if runs is not None:
        have = {f.name.lower() for f in findings.schema}
        clean = runs.select("site").distinct().join(findings.select("site").distinct().hint("merge"), "site", "left_anti")
        rows = findings.unionByName(clean, allowMissingColumns=True) if len(have) > 1 else clean
    if kind == "json":
        part = F.pmod(F.xxhash64("url", "id"), F.lit(DOCUMENTS))
        found = F.collect_list(F.when(F.col("id").isNotNull(), F.struct(*one)))
        docs = rows.groupBy("site", part.alias("part")).agg(found.alias("findings"))
        if runs is not None:
            told = [(F.col(c) if c in runs.columns else F.lit(None)).cast("string" if c in ("sitemap", "date") else "bigint").alias(c) for c in META]
            docs = docs.join(runs.select("site", F.struct(*told).alias("meta")).hint("merge"), "site", "left")
        else:
            docs = docs.withColumn("meta", F.lit(None).cast(META_TYPE))
        rows = docs.select("site", F.to_json(F.struct("site", F.lit(date).alias("date"), "meta", "findings")).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").format("text" if kind == "json" else kind).save(path)


def _documents(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    raw = spark.read.text(path, wholetext=whole_files).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))
    broken = parsed.where(F.col("d").isNull() | F.col("d.findings").isNull()).limit(1).collect()
    if broken:
        raise ValueError("not a findings document: " + json.dumps(broken[0]["value"][:80]))
    return parsed.select("d.*")


def read_findings(spark: SparkSession, path: str, whole_files: bool = False, kind: str = "json") -> DataFrame:
    """Findings from JSON documents {"site", "findings": [...]}, one in a line or (whole_files) one in a file; one that isn't such a document is an error. kind="parquet": from a table."""
    if kind == "parquet":
        table = spark.read.parquet(path).where("id is not null")
        return table.withColumn("site", F.col("site").cast("string")).select(*(["site"] + [c for c in table.columns if c != "site"]))
    return _documents(spark, path, whole_files).select("site", F.explode("findings").alias("f")).select("site", "f.*")


def read_runs(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(site, date, meta) of findings documents, once for each site."""
    return _documents(spark, path, whole_files).groupBy("site").agg(F.max("date").alias("date"), F.max("meta").alias("meta"))


def ranked(findings: DataFrame) -> DataFrame:
    w = Window.partitionBy("site").orderBy(level_rank(F.col("level")), "seq", "id")
    return findings.withColumn("position", F.row_number().over(w))
