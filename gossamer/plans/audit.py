"""The whole audit: from the response log and the side tables of all sites to findings and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import crawl, cross_rules, features, findings, graph, options, page_rules, performance, response_rules, sampling, site_files, structured_data
from gossamer.sources import responses as log

COLUMNS = ["site", "url", "seq", "level", "id", "title", "detail", "evidence"]


_kept = graph.kept
#: Tables that what audit() returns is read from; all others of a run are deleted at its end.
KEPT = ("asked", "files", "chosen", "hidden", "found")


def _session() -> SparkSession:
    return SparkSession.active()


def audit(tables: dict[str, DataFrame | str], as_of: Column, page_budget: int | None = None, include_external: bool = False, caps: dict[str, int] | None = None, shared_limits: dict | None = None, psi_sample: int = 3, psi_strategy: str = "mobile", rules=None) -> tuple[DataFrame, DataFrame]:
    """(findings, run_summary) of all sites in `responses`.

    tables: responses (a DataFrame, or the path of a log in Parquet files, whose bodies then move once, when they are kept); and, where there are any, sitemaps (site, url: explicit choice), certificates (host, not_after),
    probes (site, url of a page that shouldn't exist), psi_payloads, psi_targets (site, entry: address, path or glob of
    pages to measure), redirect_map, site_limits, ignore_rules, shared_ignore_rules (id, url_glob), expect_rules.
    shared_limits: limits for sites that have none of their own in site_limits.
    rules: a gossamer.rules registry of own rules; they get features, links, anchors, responses, nodes, sitemap_entries and sites (of the pages looked at), and
    one that fails is a finding `rule-failed` of no site.
    psi_strategy: the payloads judged, where the table has several strategies.
    caps: how many targets of a site are asked, by the id of the finding that reports the rest; without one, all are.
    """
    with graph.scope(_session(), KEPT):
        return _audit(tables, as_of, page_budget, include_external, caps, shared_limits, psi_sample, psi_strategy, rules)


def _audit(tables, as_of, page_budget, include_external, caps, shared_limits, psi_sample, psi_strategy, rules) -> tuple[DataFrame, DataFrame]:
    cap = (caps or {}).get
    given = tables["responses"]
    latest = log.read_latest(_session(), given) if isinstance(given, str) else log.latest(given)
    asked = _kept(latest.withColumn("location", F.when(F.col("location").isNotNull(), urls.resolve(F.col("url"), F.col("location")))), "asked")
    get = asked.where("method = 'GET'")
    ok = F.col("status").between(200, 299)
    sites = _kept(asked.select("site").distinct())
    robots = _kept(get.where(ok & (F.col("url") == F.concat("site", F.lit("/robots.txt")))).select("site", "body"))
    files = _kept(crawl.chosen_sitemaps(crawl.sitemap_candidates(sites, robots, tables.get("sitemaps")), get), "files")
    entries = _kept(site_files.sitemap_entries(files))

    # every page of the log once: targets of links and of canonical addresses are pages too
    every, links = features.page_tables(get, _kept)
    targets = links.where("kind = 'internal'").select("site", F.regexp_replace("href", "#.*$", "").alias("url"))
    homes = sites.select("site", F.concat("site", F.lit("/")).alias("url"))
    variants = response_rules.host_variants(sites)
    outside = links.where("kind = 'external'").select("site", F.col("href").alias("url")) if include_external else targets.limit(0)
    starts = targets.unionByName(homes).unionByName(variants).unionByName(outside)
    if "probes" in tables:
        starts = starts.unionByName(tables["probes"].select("site", "url"))
    shared = every.select("site", F.col("og")["og:image"].alias("url")).where(F.col("url").rlike("(?i)^https?://"))
    chains = _kept(graph.redirect_chains(starts.unionByName(shared).distinct(), get))
    homes = chains.join(homes.select("site", F.col("url").alias("start")).hint("merge"), ["site", "start"]).where("final_status is not null").select("site", F.col("final_url").alias("url"))

    # sites with a sitemap: its pages; others: what links lead to
    listed = entries.select("site").distinct()
    barred = site_files.robots_verdicts(targets.select("site", urls.path(F.col("url")).alias("path")), site_files.robots_rules(robots))
    edges = crawl.link_edges(links.join(graph.few(listed), "site", "left_anti"), chains, barred)
    seen, left = crawl.reachable(homes.join(graph.few(listed), "site", "left_anti"), edges, page_budget)
    of_map = entries.groupBy("site", F.col("loc").alias("url")).agg(F.min(F.struct("file", "pos")).alias("at"))
    if page_budget is not None:
        from pyspark.sql import Window

        of_map = of_map.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("n") <= page_budget)
        known = entries.groupBy("site").agg(F.count_distinct("loc").alias("n"))
        left = left.unionByName(known.select("site", (F.col("n") - page_budget).alias("left")))
    chosen = _kept(of_map.select("site", "url").unionByName(seen.select("site", "url")).distinct(), "chosen")
    only = lambda df, key="url": df.join(chosen.select("site", F.col("url").alias(key)).hint("merge"), ["site", key], "left_semi")
    pages, live = only(get), _kept(only(every))
    links, anchors = only(links, "src_url"), only(features.page_anchors(get), "src_url")

    clicks = links.where("kind = 'internal'").select("site", urls.key(F.col("src_url")).alias("src"), urls.key(F.col("href")).alias("dst"), F.struct("src_seq", "pos").alias("ord"))
    depths = graph.click_depth(clicks, homes.select("site", urls.key(F.col("url")).alias("k")))
    noindex = F.lower(F.concat_ws(" ", "robots", F.col("headers")["x-robots-tag"])).contains("noindex")
    facts = every.select("site", "url", noindex.alias("noindex"), F.try_element_at("canonical_refs", F.lit(1)).alias("canonical"))
    statuses = get.select("site", "url", "status", F.lower(F.coalesce(F.col("headers")["content-type"], F.lit(""))).contains("text/html").alias("is_html")).join(facts.hint("merge"), ["site", "url"], "left").withColumn("noindex", F.coalesce("noindex", F.lit(False)))
    assets = log.asset_status(asked)
    lengths = asked.groupBy("site", "url").agg(F.max(F.col("headers")["content-length"].try_cast("bigint")).alias("length"))
    nodes = structured_data.jsonld_nodes(live)
    hidden = _kept(findings.not_indexable(pages, live), "hidden")
    limits = sites if "site_limits" not in tables else sites.join(graph.few(tables["site_limits"]), "site", "left")
    limits = options.site_limits(limits, shared_limits)
    on_run = _kept(crawl.run_findings(sites, asked, entries, pages, left))
    parts = [
        page_rules.page_findings(pages, live, limits),
        structured_data.incomplete_nodes(nodes),
        cross_rules.cross_page_findings(live, links, anchors, homes),
        cross_rules.depth_findings(live, depths, links, homes, truncated=left.where("left > 0"), limits=limits),
        site_files.sitemap_findings(site_files.sitemap_files(files), entries, as_of),
        site_files.sitemap_not_indexable(entries, live, hidden),
        site_files.robots_findings(sites, robots, entries, get),
        on_run,
        response_rules.link_findings(_kept(response_rules.link_status(links, live, entries, statuses, cap("link-sweep-capped"))), entries, links=links),
        response_rules.sweep(response_rules.link_targets(links, live, entries), cap("link-sweep-capped"), "link-sweep-capped")[1],
        response_rules.image_findings(live, assets, cap("image-sweep-capped")),
        response_rules.sweep(response_rules.image_targets(live), cap("image-sweep-capped"), "image-sweep-capped")[1],
        response_rules.canonical_findings(live, statuses),
        response_rules.alternate_findings(live, statuses),
        response_rules.trailing_slash_findings(live, statuses),
        response_rules.header_findings(get.where(ok).join(homes.hint("merge"), ["site", "url"], "left_semi")),
        response_rules.shared_image_findings(live, chains, lengths),
        response_rules.schema_image_findings(structured_data.schema_images(nodes), assets),
        response_rules.host_variant_findings(variants, chains),
    ]
    if include_external:
        parts.append(response_rules.external_findings(links, chains, cap("external-sweep-capped")))
        parts.append(response_rules.sweep(response_rules.external_targets(links), cap("external-sweep-capped"), "external-sweep-capped")[1])
    if "probes" in tables:
        parts.append(response_rules.missing_page_findings(tables["probes"], chains, every))
    if "certificates" in tables:
        hosts = sites.select("site", F.regexp_extract("site", "://([^/:]+)", 1).alias("host"))
        parts.append(response_rules.certificate_findings(hosts, tables["certificates"], as_of))
    if "expect_rules" in tables:
        parts.append(structured_data.missing_types(live, nodes, tables["expect_rules"]))
    if "psi_targets" in tables:
        parts.append(sampling.sample_targets(tables["psi_targets"], pages, psi_sample)[1])
    if "psi_payloads" in tables:
        parts.append(performance.performance_findings(tables["psi_payloads"], psi_strategy))
    if "redirect_map" in tables:
        at = lambda c: F.when(F.col(c).rlike("^/"), F.concat("site", c)).otherwise(F.col(c))
        moves = site_files.redirect_rules(tables["redirect_map"]).withColumn("src", at("src")).withColumn("dst", at("dst"))
        whole = moves.where(~F.col("src").rlike(site_files.PLACEHOLDER))
        kept, more = response_rules.sweep(whole.withColumns({"first_seq": F.col("line_no"), "url": F.col("src")}), cap("redirect-map-capped"), "redirect-map-capped")
        moves = kept.select(moves.columns).unionByName(moves.where(F.col("src").rlike(site_files.PLACEHOLDER)))
        parts.append(more)
        parts.append(site_files.redirect_findings(moves, graph.redirect_chains(moves.select("site", F.col("src").alias("url")), get)))
    if rules is not None:
        own_rows, failed = rules.run({"features": live, "links": links, "anchors": anchors, "responses": pages, "nodes": nodes, "sitemap_entries": entries, "sites": sites})
        parts.append(own_rows)
        parts.append(failed.select(F.lit("").alias("site"), F.lit("").alias("url"), F.lit(None).cast("long").alias("seq"), F.lit("error").alias("level"), F.lit("rule-failed").alias("id"), F.lit("A rule of one's own failed").alias("title"), F.concat_ws(": ", "rule", "error").alias("detail")))
    bare = F.lit(None).cast("string").alias("evidence")
    found = reduce(DataFrame.unionByName, (p.select(F.col("seq").cast("long").alias("seq"), *(c for c in COLUMNS[:-1] if c != "seq"), "evidence" if "evidence" in p.columns else bare) for p in parts)).select(COLUMNS)
    # of a site that never answers there is nothing else to say
    silent = on_run.where("id = 'unreachable'").select("site")
    found = _kept(found.where("id <> 'unreachable'").join(graph.few(silent), "site", "left_anti").unionByName(found.where("id = 'unreachable'")), "found")
    own, common = tables.get("ignore_rules"), tables.get("shared_ignore_rules")
    kept, ignored = found, found.limit(0)
    if own is not None or common is not None:
        none = sites.select("site", F.lit("").alias("id"), F.lit("").alias("url_glob")).limit(0)
        silent = options.ignore_rules(none if own is None else own, common)
        kept, ignored = findings.apply_ignores(found, silent), findings.apply_ignores(found, silent, "left_semi")
    return findings.tag_indexable(kept, hidden), findings.run_summary(pages, kept, hidden, ignored, files, as_of)
