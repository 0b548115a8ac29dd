"""Rules that join targets found on pages with the response log. A target without a response isn't judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import cross_rules, graph, sampling

# Headers that a home page should send, and how much they matter
HEADERS = {"content-security-policy": "info", "referrer-policy": "info", "strict-transport-security": "warn", "x-content-type-options": "info"}
GONE = (404, 410, 0)


def _rows(df: DataFrame, level, rule, title: str, detail: Column | None = None) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    evidence = F.col("evidence") if "evidence" in df.columns else F.lit(None).cast("string").alias("evidence")
    return df.select("site", "url", F.lit(None).cast("long").alias("seq"), as_col(level).alias("level"), as_col(rule).alias("id"), F.lit(title).alias("title"), F.coalesce((F.lit("") if detail is None else detail).cast("string"), F.lit("")).alias("detail"), evidence)


def _per_site(df: DataFrame, level: str, rule: str, title: str, order: list[str] | None = None, value: str = "url", shown: int = 3) -> DataFrame:
    """A row for each site with the number of its rows, and the first of them by `order` as evidence."""
    g = df.groupBy("site").agg(F.count("*").alias("n")).withColumn("url", F.col("site"))
    if order is not None:
        g = g.join(cross_rules.examples(df, ["site"], value, order, shown).hint("merge"), "site", "left")
    return _rows(g, level, rule, title, F.col("n"))


def sweep(targets: DataFrame, cap: int | None, rule: str) -> tuple[DataFrame, DataFrame]:
    """A site's first `cap` targets, by first_seq and url (all if None); and a finding `rule` for sites that have more."""
    kept, left = sampling.capped(targets, cap, ["first_seq", "url"])
    return kept, _rows(left.withColumn("url", F.col("site")), "info", rule, "More targets are known than were asked", F.col("left"))


def link_targets(links: DataFrame, features: DataFrame, entries: DataFrame) -> DataFrame:
    """(site, k, url, first_seq, sources) of each internal target that was neither crawled nor listed."""
    t = links.where("kind = 'internal'").withColumn("k", urls.key(F.col("href"))).where(~F.col("href").contains("/cdn-cgi/"))
    t = t.groupBy("site", "k").agg(F.min_by(F.regexp_replace("href", "#.*$", ""), F.struct("src_seq", "pos")).alias("url"), F.min("src_seq").alias("first_seq"), F.count("*").alias("sources"))
    crawled = features.select("site", urls.key(F.col("url")).alias("k")).distinct()
    listed = entries.select("site", urls.key(F.col("loc")).alias("k")).distinct()
    return t.join(crawled.hint("merge"), ["site", "k"], "left_anti").join(listed.hint("merge"), ["site", "k"], "left_anti")


def link_status(links: DataFrame, features: DataFrame, entries: DataFrame, statuses: DataFrame, cap: int | None = None) -> DataFrame:
    """(site, url, first_seq, sources, status) of link_targets; one sweep for three rules."""
    rest, _ = sweep(link_targets(links, features, entries), cap, "link-sweep-capped")
    return rest.join(statuses.select("site", "url", "status", "is_html").hint("merge"), ["site", "url"])


def link_findings(swept: DataFrame, entries: DataFrame, top: int = 20, links: DataFrame | None = None, shown: int = 3) -> DataFrame:
    """broken-link, missing-from-sitemap and link-redirects of swept targets; with links, the first pages that link to a broken target are named."""
    dead = swept.where(F.col("status").isin(404, 0))
    if links is not None:
        at = links.where("kind = 'internal'").select("site", urls.key(F.col("href")).alias("k"), "src_url", "src_seq").join(dead.select("site", "k").hint("merge"), ["site", "k"], "left_semi")
        dead = dead.join(cross_rules.examples(at, ["site", "k"], "src_url", ["src_seq", "src_url"], shown).hint("merge"), ["site", "k"], "left")
    broken = _rows(dead, "error", "broken-link", "The link leads nowhere", F.col("sources"))
    sites = entries.select("site").distinct()
    absent = swept.where("status = 200 and is_html").join(graph.few(sites), "site", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("first_seq", "url")))
    more = absent.groupBy("site").agg((F.count("*") - top).alias("n")).where("n > 0").withColumn("url", F.col("site"))
    return (
        broken.unionByName(_rows(absent.where(F.col("n") <= top), "warn", "missing-from-sitemap", "A linked page isn't in the sitemap"))
        .unionByName(_rows(more, "info", "missing-from-sitemap-more", "More pages aren't in the sitemap", F.col("n")))
        .unionByName(_per_site(swept.where(F.col("status").between(300, 399)), "info", "link-redirects", "Links lead to redirects", ["first_seq", "url"]))
    )


def image_targets(features: DataFrame) -> DataFrame:
    """(site, url, page, first_seq) of each image, at the first page that has it."""
    t = features.select("site", "url", "seq", F.explode("images").alias("i")).where("i.src <> '' and not startswith(i.src, 'data:')")
    t = t.select("site", urls.resolve(F.col("url"), F.col("i.src")).alias("target"), "seq", F.col("url").alias("page"))
    return t.groupBy("site", F.col("target").alias("url")).agg(F.min_by("page", F.struct("seq", "page")).alias("page"), F.min("seq").alias("first_seq"))


def image_findings(features: DataFrame, assets: DataFrame, cap: int | None = None) -> DataFrame:
    """assets: site, url, status, by HEAD with GET behind it."""
    t, _ = sweep(image_targets(features), cap, "image-sweep-capped")
    hit = t.join(assets.hint("merge"), ["site", "url"]).where(F.col("status").isin(*GONE))
    return _rows(hit, "error", "broken-image", "The image is gone", F.col("page"))


def canonical_findings(features: DataFrame, statuses: DataFrame) -> DataFrame:
    """What a page's canonical address answers: the first of redirect, dead, noindex, chain. statuses also has noindex and canonical."""
    t = features.where(F.size("canonical_refs") > 0).select("site", "seq", "url", F.col("canonical_refs")[0].alias("target")).where(urls.bare(F.col("target")) != urls.bare(F.col("url")))
    t = t.groupBy("site", "target").agg(F.max_by("url", "seq").alias("url"))
    s = statuses.select("site", F.col("url").alias("target"), "status", "noindex", "canonical")
    kind = F.when(F.col("status").between(300, 399), "canonical-redirects").when(~F.col("status").between(200, 299), "canonical-dead").when(F.col("noindex"), "canonical-noindex").when(F.col("canonical").isNotNull() & (urls.bare(F.col("canonical")) != urls.bare(F.col("target"))), "canonical-chain")
    j = t.join(s.hint("merge"), ["site", "target"]).withColumn("kind", kind).where("kind is not null")
    return _rows(j, F.when(F.col("kind") == "canonical-chain", "warn").otherwise("error"), F.col("kind"), "The canonical address doesn't serve", F.col("target"))


def alternate_findings(features: DataFrame, statuses: DataFrame) -> DataFrame:
    """Pages that declare alternates outside the crawl that are gone: a row for each page."""
    e = features.select("site", "url", F.posexplode("hreflang").alias("pos", "a")).groupBy("site", "url", F.col("a.href").alias("target")).agg(F.min("pos").alias("pos"))
    e = e.join(features.select("site", F.col("url").alias("target")).distinct().hint("merge"), ["site", "target"], "left_anti")
    gone = e.join(statuses.select("site", F.col("url").alias("target"), "status").hint("merge"), ["site", "target"]).where(F.col("status").isin(*GONE))
    g = gone.groupBy("site", "url").agg(F.count("*").alias("n")).join(cross_rules.examples(gone, ["site", "url"], "target", ["pos", "target"], 3).hint("merge"), ["site", "url"])
    return _rows(g, "error", "hreflang-dead", "Alternates are gone", F.col("n"))


def trailing_slash_findings(features: DataFrame, statuses: DataFrame, sample: int = 12) -> DataFrame:
    """Sites whose sampled pages also answer under the form with, or without, a trailing slash."""
    p = features.where(urls.path(F.col("url")) != "/").withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("seq", "url"))).where(F.col("n") <= sample)
    flipped = F.when(F.col("url").endswith("/"), urls.bare(F.col("url"))).otherwise(F.concat("url", F.lit("/")))
    both = p.select("site", flipped.alias("url")).join(statuses.where("status = 200").select("site", "url").hint("merge"), ["site", "url"])
    return _per_site(both, "warn", "trailing-slash", "Pages answer with and without a trailing slash")


def certificate_findings(sites: DataFrame, certificates: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """sites: site, host; certificates: host, not_after."""
    left = F.floor((F.unix_timestamp("not_after") - F.unix_timestamp(as_of)) / 86400)
    j = sites.join(certificates, "host").withColumn("days", left).withColumn("url", F.col("site")).where(F.col("days") <= days)
    return _rows(j, F.when(F.col("days") < 0, "error").otherwise("warn"), F.when(F.col("days") < 0, "tls-expired").otherwise("tls-expiring"), "The certificate runs out", F.col("days"))


def header_findings(homes: DataFrame) -> DataFrame:
    """homes: site, url, headers of ok home pages."""
    wanted = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(v).alias("level")) for h, v in HEADERS.items()))
    j = homes.select("site", "url", F.explode(F.filter(wanted, lambda w: ~F.array_contains(F.map_keys("headers"), w["h"]))).alias("w"))
    return _rows(j, F.col("w.level"), F.concat(F.lit("header-"), F.col("w.h")), "A security header isn't sent")


def shared_image_findings(features: DataFrame, chains: DataFrame, assets: DataFrame, heavy: int = 5_000_000) -> DataFrame:
    """chains: of the absolute og:image addresses; assets: site, url, length."""
    t = features.select("site", F.col("og")["og:image"].alias("target"), "seq", "url").where(F.col("target").rlike("(?i)^https?://")).groupBy("site", "target").agg(F.max_by("url", "seq").alias("url"))
    gone = t.join(chains.select("site", F.col("start").alias("target"), "final_status").hint("merge"), ["site", "target"]).where(F.col("final_status").isin(*GONE))
    large = t.join(assets.select("site", F.col("url").alias("target"), "length").hint("merge"), ["site", "target"]).where(F.col("length") > heavy)
    return _rows(gone, "error", "og-image-broken", "The shared image is gone", F.col("target")).unionByName(_rows(large, "warn", "og-image-heavy", "The shared image is heavy", F.col("length")))


def external_targets(links: DataFrame) -> DataFrame:
    return links.where("kind = 'external'").groupBy("site", F.col("href").alias("url")).agg(F.min("src_seq").alias("first_seq"))


def external_findings(links: DataFrame, chains: DataFrame, cap: int | None = None) -> DataFrame:
    t, _ = sweep(external_targets(links), cap, "external-sweep-capped")
    t = t.join(chains.withColumnRenamed("start", "url").hint("merge"), ["site", "url"])
    first = F.try_element_at("hops", F.lit(1))["status"]
    return _per_site(t.where(F.col("final_status").isin(*GONE)), "warn", "external-broken", "Links to other sites are gone", ["first_seq", "url"]).unionByName(_per_site(t.where(first.between(300, 399) & F.col("final_status").between(200, 299)), "info", "external-redirects", "Links to other sites redirect", ["first_seq", "url"]))


def missing_page_findings(probes: DataFrame, chains: DataFrame, features: DataFrame) -> DataFrame:
    """soft-404 of probes (site, url): an address that shouldn't exist ends as an ok HTML page."""
    j = probes.join(chains.select("site", F.col("start").alias("url"), "final_url", "final_status").hint("merge"), ["site", "url"]).where("final_status = 200")
    f = features.select("site", F.col("url").alias("final_url"), F.lower(F.coalesce("robots", F.lit(""))).contains("noindex").alias("hidden"))
    j = j.join(f.hint("merge"), ["site", "final_url"], "left")
    mild = (urls.path(F.col("final_url")) == "/") | F.coalesce("hidden", F.lit(False))
    return _rows(j, F.when(mild, "warn").otherwise("error"), "soft-404", "A missing page answers as if it were there", F.col("final_url"))


def host_variants(sites: DataFrame) -> DataFrame:
    """(site, url): the plain scheme, and the form with www where the host is a registrable name."""
    authority = F.regexp_replace(F.regexp_extract("site", "://([^/?#]+)", 1), r"^www\.", "")
    host = F.regexp_replace(authority, r":\d+$", "")
    named = host.contains(".") & ~host.rlike(r"^\[?[\d.:]+\]?$")
    plain = F.array(F.concat(F.lit("http://"), authority, F.lit("/")))
    www = F.array(F.concat(F.lit("https://www."), authority, F.lit("/")), F.concat(F.lit("http://www."), authority, F.lit("/")))
    return sites.select("site", F.explode(F.when(named, F.concat(plain, www)).otherwise(plain)).alias("url")).distinct()


def host_variant_findings(variants: DataFrame, chains: DataFrame) -> DataFrame:
    """host-variant-dead and redirect-chain; chains: of the variants."""
    j = variants.join(chains.withColumnRenamed("start", "url").hint("merge"), ["site", "url"]).where("final_status is not null")
    good = F.col("final_status").between(200, 299)
    dead = _rows(j.where(~good), "warn", "host-variant-dead", "A form of the host leads to no page", F.col("final_status"))
    return dead.unionByName(_rows(j.where(good & (F.size("hops") > 2)), "warn", "redirect-chain", "A form of the host takes several redirects", F.size("hops") - 1))


def schema_image_findings(images: DataFrame, assets: DataFrame) -> DataFrame:
    """schema-image-broken, one row for a site at the first page that names a dead image.

    images: site, url, seq, target, as structured_data.schema_images gives them; assets: site, url, status.
    """
    t = images.groupBy("site", "target").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
    gone = t.join(assets.select("site", F.col("url").alias("target"), "status").hint("merge"), ["site", "target"]).where(F.col("status").isin(*GONE))
    g = gone.groupBy("site").agg(F.count("*").alias("n"), F.min_by("url", F.struct("seq", "target")).alias("url"))
    g = g.join(cross_rules.examples(gone, ["site"], "target", ["seq", "target"], 3).hint("merge"), "site")
    return _rows(g, "warn", "schema-image-broken", "Structured data names images that are gone", F.col("n"))
