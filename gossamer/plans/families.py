"""Registered queries of the rules over whole sites: each returns all findings of one family on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import cross_rules, features, findings, graph, options, performance, response_rules, sampling, site_files
from gossamer.plans import derived
from gossamer.plans.derived import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, on the site of its source."""
    d = table(spark, sf_dir, "documents").selectExpr("concat('https://', source, '.example') as site", "doc_id as seq")
    return d.withColumn("url", F.concat("site", F.lit("/d/"), "seq"))


DOCS = "d AS (SELECT 'https://' || source || '.example' AS site, doc_id AS n, 'https://' || source || '.example/d/' || doc_id AS url FROM documents)"


@query(f"""
WITH {DOCS}, t AS (SELECT site, n, url, 'T' || n % 700 AS title, CASE WHEN n % 4 = 0 THEN '' ELSE 'D' || n % 311 END AS description FROM d),
links AS (SELECT DISTINCT site, site || '/d/' || (n + 20) AS url FROM d WHERE n % 3 > 0),
alternates AS (SELECT site, n, url, n + 20 AS t FROM d WHERE n % 5 = 0 UNION ALL SELECT site, n, url, n - 40 FROM d WHERE n % 5 = 0 AND n % 3 > 0 UNION ALL SELECT site, n, url, n - 20 FROM d WHERE n % 5 = 0 AND n % 7 = 0),
groups AS (SELECT site, 'duplicate-title' AS id, title AS k, n, url FROM t UNION ALL SELECT site, 'duplicate-description', description, n, url FROM t WHERE description <> '')
SELECT min_by(url, n) AS url, id, count(*)::VARCHAR AS detail, array_to_string(list(url ORDER BY n)[1:4], ', ') AS evidence FROM groups GROUP BY site, id, k HAVING count(*) > 1
UNION ALL SELECT d.url, 'orphan-page', '', NULL FROM d WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.url = d.url) AND n <> (SELECT min(n) FROM d e WHERE e.site = d.site)
UNION ALL SELECT min_by(url, n), 'hreflang-no-x-default', '', NULL FROM d WHERE n % 5 = 0 AND site NOT LIKE '%e.example' GROUP BY site
UNION ALL SELECT a.url, 'hreflang-one-way', b.url, NULL FROM alternates a JOIN d b ON b.site = a.site AND b.n = a.t WHERE NOT EXISTS (SELECT 1 FROM alternates c WHERE c.site = b.site AND c.n = b.n AND c.t = a.n)
""")
def cross_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates with their first pages, orphans, and alternates, one of which on every fifth page and relative in markup."""
    d = _docs(spark, sf_dir)
    body = F.expr("""concat('<title>T', seq % 700, '</title>', if(seq % 4 = 0, '', concat('<meta name=description content="D', seq % 311, '">')),
      if(seq % 5 = 0, concat('<link rel=alternate hreflang=de href="', seq + 20, '">', if(seq % 3 = 0, '', concat('<link rel=alternate hreflang=fr href="../d/', seq - 40, '">')), if(seq % 7 = 0, concat('<link rel=alternate hreflang=it href="', seq - 20, '">'), ''), '<link rel=alternate hreflang=', if(site like '%e.example', 'x-default', 'en'), ' href="./', seq, '">'), ''))""")
    r = d.select("site", F.lit("GET").alias("method"), "url", "seq", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"), F.lit(0).alias("ms"))
    pages = graph.kept(features.page_features(r), "features")
    links = d.where("seq % 3 > 0").select("site", F.lit("internal").alias("kind"), F.col("url").alias("src_url"), F.col("seq").alias("src_seq"), F.concat("site", F.lit("/d/"), F.col("seq") + 20, F.lit("/#x")).alias("href"))
    homes = d.groupBy("site").agg(F.min_by("url", "seq").alias("url"))
    parts = [cross_rules.duplicates(pages, "title", "duplicate-title"), cross_rules.duplicates(pages, "description", "duplicate-description"), cross_rules.orphans(pages, links, homes), cross_rules.alternates_without_default(pages), cross_rules.one_way_alternates(pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("url", "id", "detail", "evidence")


DEPTH_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS depth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
lost AS (SELECT c, k, depth, n, c % 3 = 1 AND depth >= n - 1 AND n > 4 OR c % 3 = 2 AND depth >= 2 AS cut FROM o),
s AS (SELECT c, count(*) AS n, count(*) FILTER (cut) AS stranded FROM lost GROUP BY c),
skipped AS (SELECT * FROM s WHERE n >= 5 AND stranded > 0.3 * n OR c % 10 = 7),
judged AS (SELECT * FROM lost WHERE c NOT IN (SELECT c FROM skipped)),
deep AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY depth DESC, k) AS place FROM judged WHERE NOT cut AND depth > 4)
SELECT c AS site, NULL::BIGINT AS seq, 'click-depth-skipped' AS id, stranded::VARCHAR AS detail, NULL AS evidence FROM skipped
UNION ALL SELECT c, k, 'no-path-from-home', '', NULL FROM judged WHERE cut AND depth > CASE c % 3 WHEN 1 THEN n - 1 ELSE 2 END
UNION ALL SELECT c, k, 'deep-page', depth::VARCHAR, (SELECT string_agg('/' || b.k, ' > ' ORDER BY b.k) FROM o b WHERE b.c = deep.c AND b.depth <= deep.depth) FROM deep WHERE place <= 20
UNION ALL SELECT c, NULL, 'deep-page-more', (count(*) - 20)::VARCHAR, NULL FROM deep GROUP BY c HAVING count(*) > 20
"""


@query(DEPTH_SQL)
def depth_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each customer, whose orders are pages in a chain; some chains are cut, and some sites were left unfinished."""
    return _depths(spark, sf_dir)


@query(DEPTH_SQL.replace("depth > 4)", "depth > CASE c % 5 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 6 END)"))
def depth_rules_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depth_rules where sites have limits of their own: some one click, some nine; six are shared."""
    sites = table(spark, sf_dir, "customer").selectExpr("concat('https://c', c_custkey, '.example') as site", "case c_custkey % 5 when 0 then 1 when 1 then 9 end as max_click_depth")
    return _depths(spark, sf_dir, options.site_limits(sites, {"max_click_depth": 6}))


def _depths(spark: SparkSession, sf_dir: str, limits: DataFrame | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as c", "o_orderkey as k", "row_number() over (partition by o_custkey order by o_orderkey) - 1 as place", "count(*) over (partition by o_custkey) as n", "lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before")
    rows = graph.kept(rows.withColumns({"site": F.concat(F.lit("https://c"), "c", F.lit(".example")), "cut": F.expr("c % 3 = 1 and place = n - 1 and n > 4 or c % 3 = 2 and place = 2")}), "orders")
    pages = rows.select("site", F.concat("site", F.lit("/"), "k").alias("url"), F.col("k").alias("seq"))
    chain = rows.where("before is not null and not cut").select("site", F.lit("internal").alias("kind"), F.concat("site", F.lit("/"), "before").alias("src_url"), F.col("before").alias("src_seq"), F.lit(0).alias("pos"), F.concat("site", F.lit("/"), "k").alias("href"))
    homes = rows.where("place = 0").select("site", F.concat("site", F.lit("/"), "k").alias("url"))
    clicks = chain.select("site", urls.key(F.col("src_url")).alias("src"), urls.key(F.col("href")).alias("dst"), F.struct("src_seq", "pos").alias("ord"))
    depths = graph.click_depth(clicks, homes.select("site", urls.key(F.col("url")).alias("k")))
    unfinished = rows.where("c % 10 = 7").select("site").distinct()
    found = cross_rules.depth_findings(pages, depths, chain, homes, truncated=unfinished, limits=limits)
    return found.select(F.regexp_extract("site", r"c(\d+)", 1).cast("long").alias("site"), "seq", "id", "detail", "evidence")


@query(f"""
WITH {DOCS}, c AS (SELECT *, n + CASE n % 4 WHEN 0 THEN 0 WHEN 3 THEN 100000000 ELSE 20 END AS t FROM d),
k AS (SELECT c.site, max(c.n) AS n, c.site || '/d/' || t AS target, any_value(t) AS t FROM c WHERE t <> n GROUP BY c.site, c.site || '/d/' || t),
j AS (SELECT k.*, CASE WHEN e.n % 5 = 0 THEN 'canonical-redirects' WHEN e.n % 5 = 1 THEN 'canonical-dead' WHEN e.n % 5 = 2 THEN 'canonical-noindex' WHEN e.n % 4 > 0 THEN 'canonical-chain' END AS id FROM k JOIN d e ON e.url = k.target)
SELECT site || '/d/' || n AS url, id, target AS detail FROM j WHERE id IS NOT NULL
""")
def canonical_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses in relative markup: of the page itself, of the next, or of one without a response."""
    d = _docs(spark, sf_dir)
    step = "seq + case seq % 4 when 0 then 0 when 3 then 100000000 else 20 end"
    body = F.expr(f"concat('<link rel=canonical href=\"', case seq % 3 when 0 then '' when 1 then '../d/' else concat('//', substring(site, 9), '/d/') end, {step}, '\"><meta name=robots content=\"', if(seq % 5 = 2, 'noindex', ''), '\">')")
    r = d.select("site", F.lit("GET").alias("method"), "url", "seq", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"), F.lit(0).alias("ms"))
    pages = graph.kept(features.page_features(r), "features")
    answers = pages.select("site", "url", F.expr("case seq % 5 when 0 then 302 when 1 then 410 else 200 end").alias("status"), F.coalesce(F.col("robots").contains("noindex"), F.lit(False)).alias("noindex"), F.try_element_at("canonical_refs", F.lit(1)).alias("canonical"))
    return response_rules.canonical_findings(pages, answers).select("url", "id", "detail")


@query(f"""
WITH {DOCS}, e AS (SELECT DISTINCT site, url, n, site || '/x/' || (n + k) % 500 AS target FROM d, (VALUES (1), (2), (3)) a(k) WHERE n % 2 = 0)
SELECT url, count(*)::VARCHAR AS detail FROM e WHERE regexp_extract(target, '(\\d+)$', 1)::INT % 3 = 0 GROUP BY url
""")
def hreflang_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three alternates of every other page, in relative markup; a third of the addresses are gone, a third have no response."""
    d = _docs(spark, sf_dir)
    body = F.expr("if(seq % 2 = 0, concat_ws('', transform(array(1, 2, 3), k -> concat('<link rel=\"alternate\" hreflang=\"a', k, '\" href=\"../x/', (seq + k) % 500, '\">'))), '')")
    r = d.select("site", F.lit("GET").alias("method"), "url", "seq", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"), F.lit(0).alias("ms"))
    log = d.select("site").distinct().select("site", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("k")).where("k % 3 <> 1").select("site", F.concat("site", F.lit("/x/"), "k").alias("url"), F.when(F.col("k") % 3 == 0, 404).otherwise(200).alias("status"))
    return response_rules.alternate_findings(features.page_features(r), log).select("url", "detail")


@query(f"""
WITH {DOCS}, i AS (SELECT site, n, url, CASE WHEN n % 3 = 0 THEN 'https://cdn.example/' || n % 400 || '.png' ELSE site || '/d/' || n % 90 || '.png' END AS target, CASE WHEN n % 3 = 0 THEN n % 400 ELSE n % 90 END AS k FROM d WHERE n % 7 > 0),
f AS (SELECT site, target, any_value(k) AS k, min(n) AS n, min_by(url, n) AS page FROM i GROUP BY site, target),
capped AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n, target) AS place FROM f)
SELECT site, target AS url, 'broken-image' AS id, page AS detail FROM capped WHERE place <= 250 AND k % 4 IN (1, 3)
UNION ALL SELECT site, site, 'image-sweep-capped', (count(*) - 250)::VARCHAR FROM f GROUP BY site HAVING count(*) > 250
""")
def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages, shared by many; HEAD isn't allowed for some, and a sweep asks 250 of a site, as its cap says."""
    d = _docs(spark, sf_dir)
    src = F.expr("if(seq % 3 = 0, concat('https://cdn.example/', seq % 400, '.png'), concat(seq % 90, '.png'))")
    image = F.struct(src.alias("src"))
    pages = d.select("site", "url", "seq", F.when(F.col("seq") % 7 > 0, F.array(image)).otherwise(F.array(F.struct(F.lit("data:,x").alias("src")), F.struct(F.lit("").alias("src")))).alias("images"))
    known = d.select("site", F.explode(F.expr("array(struct(concat('https://cdn.example/', seq % 400, '.png') as url, seq % 400 as k), struct(concat(site, '/d/', seq % 90, '.png') as url, seq % 90 as k))")).alias("x")).select("site", "x.url", "x.k").distinct()
    log = known.selectExpr("site", "url", "stack(2, 'HEAD', case k % 4 when 0 then 405 when 1 then 404 when 2 then 403 else 501 end, 'GET', if(k % 4 = 3, 410, 200)) as (method, status)")
    from gossamer.sources import responses

    found = response_rules.image_findings(pages, responses.asset_status(log), 250).unionByName(response_rules.sweep(response_rules.image_targets(pages), 250, "image-sweep-capped")[1])
    return found.select("site", "url", "id", "detail")


@query("""
WITH s AS (SELECT c_custkey AS c, 'https://c' || c_custkey || '.example' AS site FROM customer),
h AS (SELECT * FROM (VALUES ('content-security-policy', 2), ('referrer-policy', 3), ('strict-transport-security', 5), ('x-content-type-options', 7)) v(h, m))
SELECT c, 'header-' || h AS id, CASE WHEN m < 4 THEN 'info' WHEN h LIKE 'strict%' THEN 'warn' ELSE 'info' END AS level, '' AS detail FROM s, h WHERE c % m > 0
UNION ALL SELECT c, 'trailing-slash', 'warn', CASE WHEN c % 4 = 0 THEN '12' ELSE '1' END FROM s WHERE c % 4 < 2
UNION ALL SELECT c, 'soft-404', CASE WHEN c % 6 = 0 THEN 'error' ELSE 'warn' END, CASE c % 6 WHEN 0 THEN site || '/no-such-page' WHEN 1 THEN site || '/' ELSE site || '/no-such-page' END FROM s WHERE c % 6 < 3
""")
def site_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of home pages, pages under two addresses, and addresses that shouldn't exist, on a site for each customer."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as c")
    # a customer makes 14 pages and their answers, and all customers may be one row group; so they are dealt first, and answers to as many tasks
    n = graph.tasks(spark, 14 * c.count())
    s = c.repartition(n, "c").withColumn("site", F.expr("concat('https://c', c, '.example')"))
    names = "map_entries(map('content-security-policy', 2, 'referrer-policy', 3, 'strict-transport-security', 5, 'x-content-type-options', 7))"
    homes = s.selectExpr("site", "concat(site, '/') as url", f"map_from_entries(transform(filter({names}, x -> c % x.value = 0), x -> struct(x.key, 'x'))) as headers")
    # 14 pages a site, with and without a slash at the end; only the first twelve are tried the other way
    pages = s.selectExpr("c", "site", "explode(sequence(1, 14)) as seq").withColumn("url", F.expr("concat(site, '/p', seq, if(seq % 2 = 0, '/', ''))"))
    other = pages.where("c % 4 = 0 or c % 4 = 1 and seq in (5, 13)").selectExpr("site", "if(seq % 2 = 0, concat(site, '/p', seq), concat(site, '/p', seq, '/')) as url", "200 as status")
    slashes = response_rules.trailing_slash_findings(pages, other.unionByName(pages.selectExpr("site", "url", "200 as status")).repartition(n, "site", "url"))
    probes = s.selectExpr("site", "concat(site, '/no-such-page') as url")
    log = s.selectExpr("site", "stack(2, concat(site, '/no-such-page'), case c % 6 when 0 then 200 when 1 then 302 when 2 then 200 when 3 then 404 when 4 then 302 else 410 end, concat(site, '/'), if(c % 6 = 4, 500, 200)) as (url, status)").withColumn("location", F.concat("site", F.lit("/")))
    judged = s.selectExpr("site", "concat(site, '/no-such-page') as url", "if(c % 6 = 2, 'noindex', null) as robots")
    soft = response_rules.missing_page_findings(probes, graph.redirect_chains(probes, log), judged)
    found = response_rules.header_findings(homes).unionByName(slashes).unionByName(soft)
    return found.join(s.hint("merge"), "site").select("c", "id", "level", "detail")


@query(f"""
WITH {DOCS}, t AS (SELECT site, 'https://img.example/' || n % 300 AS target, max(n) AS n, any_value(n % 300) AS k FROM d WHERE n % 3 > 0 GROUP BY site, target),
x AS (SELECT site, 'https://out.example/' || n % 200 AS href, any_value(n % 200) AS k FROM d GROUP BY site, href)
SELECT site, site || '/d/' || n AS url, 'og-image-broken' AS id, target AS detail FROM t WHERE k % 5 < 2
UNION ALL SELECT site, site || '/d/' || n, 'og-image-heavy', (4999990 + k)::VARCHAR FROM t WHERE k > 10
UNION ALL SELECT site, site, 'external-broken', count(*)::VARCHAR FROM x WHERE k % 6 < 2 GROUP BY site
UNION ALL SELECT site, site, 'external-redirects', count(*)::VARCHAR FROM x WHERE k % 6 = 2 GROUP BY site
""")
def outside_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared images, some of them behind redirects, and links to other sites."""
    d = _docs(spark, sf_dir)
    pages = d.select("site", "url", "seq", F.create_map(F.lit("og:image"), F.expr("if(seq % 3 > 0, concat('https://img.example/', seq % 300), '/local.png')")).alias("og"))
    targets = d.selectExpr("site", "concat('https://img.example/', seq % 300) as url", "seq % 300 as k").distinct()
    # every fifth image redirects to one that is gone
    log = targets.selectExpr("site", "stack(2, url, case k % 5 when 0 then 301 when 1 then 404 else 200 end, concat(url, '/old'), 410) as (url, status)", "concat(url, '/old') as location")
    lengths = targets.selectExpr("site", "url", "4999990 + k as length")
    images = response_rules.shared_image_findings(pages, graph.redirect_chains(targets.select("site", "url"), log), lengths)
    links = d.selectExpr("site", "'external' as kind", "concat('https://out.example/', seq % 200) as href", "seq as src_seq", "seq % 200 as k")
    out = links.selectExpr("site", "href", "k").distinct()
    answers = out.selectExpr("site", "stack(2, href, case k % 6 when 0 then 404 when 1 then 0 when 2 then 301 when 3 then 403 when 4 then 301 else 200 end, concat(href, '/to'), if(k % 6 = 2, 200, 500)) as (url, status)", "concat(href, '/to') as location")
    outside = response_rules.external_findings(links, graph.redirect_chains(out.selectExpr("site", "href as url"), answers))
    return images.unionByName(outside).select("site", "url", "id", "detail")


@query("""
WITH s AS (SELECT c_custkey AS c FROM customer), has AS (SELECT c, c % 2 = 0 AS robots, c % 3 > 0 AS map, c % 5 = 0 AS shut FROM s)
SELECT c, 'robots-missing' AS id, '' AS detail FROM has WHERE NOT robots
UNION ALL SELECT c, 'robots-blocks-all', '/' FROM has WHERE robots AND shut
UNION ALL SELECT c, 'robots-no-sitemap', '' FROM has WHERE robots AND c % 4 = 0
UNION ALL SELECT c, 'robots-blocks-sitemap-url', '2' FROM has WHERE robots AND NOT shut AND map
UNION ALL SELECT c, 'llms-missing', '' FROM has WHERE c % 7 > 0
UNION ALL SELECT c, 'no-sitemap', '' FROM has WHERE NOT map
UNION ALL SELECT c, 'sitemap-lastmod-missing', '' FROM has WHERE map
UNION ALL SELECT c, 'sitemap-too-many-urls', '50001' FROM has WHERE map AND c % 500 = 1
UNION ALL SELECT c, 'sitemap-too-large', (50 * 1024 * 1024 + 1)::VARCHAR FROM has WHERE map AND c % 500 = 2
UNION ALL SELECT c, 'sitemap-not-indexable', CASE WHEN c % 2 = 0 THEN '2' ELSE '1' END FROM has WHERE map
""")
def site_files_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt, llms.txt and sitemaps of a site for each customer."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as c")
    # all customers may be one row group; so they are dealt before files and addresses are made of them
    s = c.repartition(graph.tasks(spark, 4 * c.count()), "c").withColumn("site", F.expr("concat('https://c', c, '.example')"))
    robots = s.where("c % 2 = 0").selectExpr("site", "concat('User-agent: *\\n', if(c % 5 = 0, 'Disallow: /\\n', 'Disallow: /p\\nAllow: /p/3\\n'), if(c % 4 = 0, '', concat('Sitemap: ', site, '/s.xml'))) as body")
    entries = s.where("c % 3 > 0").selectExpr("site", "explode(array('/', '/p/1', '/p/2', '/p/3')) as path").selectExpr("site", "concat(site, '/s.xml') as file", "concat(site, path) as loc", "cast(null as string) as lastmod")
    log = s.where("c % 7 = 0").selectExpr("site", "concat(site, '/llms.txt') as url", "200 as status")
    files = s.where("c % 3 > 0").selectExpr("site", "concat(site, '/s.xml') as url", "if(c % 500 = 1, 50001, 50000) as urls", "50 * 1024 * 1024 + if(c % 500 = 2, 1, 0) as bytes")
    pages = entries.select("site", F.col("loc").alias("url"))
    hidden = s.selectExpr("site", "explode(if(c % 2 = 0, array('/p/1', '/p/2', '/x'), array('/p/3'))) as path").selectExpr("site", "concat(site, path) as url", "'noindex' as reason")
    now = F.lit("2026-01-01").cast("timestamp")
    found = site_files.robots_findings(s, robots, entries, log).unionByName(site_files.sitemap_findings(files, entries, now)).unionByName(site_files.sitemap_not_indexable(entries, pages, hidden))
    return found.join(s.hint("merge"), "site").select("c", "id", "detail")


@query("""
WITH o AS (SELECT o_custkey % 100 AS c, o_orderkey AS k FROM orders)
SELECT c, 'redirect-pattern-skipped' AS id, count(*)::VARCHAR AS detail FROM o WHERE k % 5 = 0 GROUP BY c
UNION ALL SELECT c, 'redirect-temporary', count(*)::VARCHAR FROM o WHERE k % 5 = 1 GROUP BY c
UNION ALL SELECT c, 'redirect-dead', count(*)::VARCHAR FROM o WHERE k % 5 = 2 GROUP BY c
UNION ALL SELECT c, 'redirect-elsewhere', count(*)::VARCHAR FROM o WHERE k % 5 = 3 GROUP BY c
""")
def redirect_rules_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redirect rule for each order: with a placeholder, answered by another status, gone, to another place, or not asked."""
    o = table(spark, sf_dir, "orders").selectExpr("concat('s', o_custkey % 100) as site", "o_custkey % 100 as c", "o_orderkey as k")
    lines = o.selectExpr("site", "k as line_no", "concat('/', k, if(k % 5 = 0, '/*', ''), ' /to/', k, ' 301')  as line")
    log = o.where("k % 5 in (1, 2, 3)").selectExpr("site", "stack(2, concat('/', k), case k % 5 when 1 then 302 when 2 then 410 else 301 end, concat(if(k % 5 = 3, '/else/', '/to/'), k), 200) as (url, status)", "concat(if(k % 5 = 3, '/else/', '/to/'), k) as location")
    rules = site_files.redirect_rules(lines)
    chains = graph.redirect_chains(rules.where(~F.col("src").rlike(site_files.PLACEHOLDER)).select("site", F.col("src").alias("url")), log)
    return site_files.redirect_findings(rules, chains).select(F.regexp_extract("site", r"(\d+)", 1).cast("long").alias("c"), "id", "detail")


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k, 'psi-failed' AS id, 'info' AS level FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'psi-cls', CASE WHEN k % 40 > 25 THEN 'error' ELSE 'warn' END FROM c WHERE k % 5 > 0 AND k % 40 > 10
UNION ALL SELECT k, 'psi-field-cls', 'error' FROM c WHERE k % 5 > 0 AND k % 3 = 0
UNION ALL SELECT k, 'psi-field-inp', 'error' FROM c WHERE k % 5 > 0 AND k % 3 = 1
UNION ALL SELECT k, 'psi-no-field-data', 'info' FROM c WHERE k % 5 > 0 AND k % 3 = 2
""")
def performance_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that failed, layout shift in the laboratory, shift and responsiveness in the field."""
    field = "case k % 3 when 0 then ',\"loadingExperience\":{\"metrics\":{\"CUMULATIVE_LAYOUT_SHIFT_SCORE\":{\"category\":\"SLOW\"}}}' when 1 then ',\"loadingExperience\":{\"metrics\":{\"INTERACTION_TO_NEXT_PAINT\":{\"category\":\"SLOW\"}}}' else '' end"
    lab = "concat('{\"lighthouseResult\":{\"categories\":{\"performance\":{\"score\":1}},\"audits\":{\"cumulative-layout-shift\":{\"numericValue\":', k % 40 / 100, '}}}'"
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey as k").selectExpr("'s' as site", "k as url", f"if(k % 5 = 0, null, {lab}, {field}, '}}')) as payload", "if(k % 5 = 0, 'quota', null) as error")
    return performance.performance_findings(p).select(F.col("url").alias("k"), "id", "level")


@query("""
WITH e AS (SELECT n_nationkey AS site, unnest(['/c/*', '/none/*', '/c/1']) AS entry FROM nation),
p AS (SELECT c_nationkey AS site, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer)
SELECT site, 'psi-no-match' AS id, '0' AS detail FROM e WHERE entry = '/none/*'
UNION ALL SELECT site, CASE WHEN any_value(size) > 3 THEN 'psi-sampled' END, any_value(size)::VARCHAR FROM p GROUP BY site HAVING any_value(size) > 3
UNION ALL SELECT n_nationkey, 'psi-no-match', '0' FROM nation WHERE n_nationkey NOT IN (SELECT site FROM p)
UNION ALL SELECT DISTINCT site, 'target', 'c' || k FROM p, range(3) r(i) WHERE size <= 3 OR place = i * size // 3
UNION ALL SELECT site, 'target', 'c1' FROM e WHERE entry = '/c/1' AND site NOT IN (SELECT site FROM p WHERE k = 1 AND (size <= 3 OR place IN (0, size // 3, 2 * size // 3)))
""")
def psi_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to measure: an address, a pattern that matches and one that doesn't, for each nation's site; and the notes on patterns."""
    site = F.concat(F.lit("https://n"), F.col("k"), F.lit(".example"))
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).select(site.alias("site"), F.explode(F.array(F.lit("/c/*"), F.lit("/none/*"), F.lit("/c/1"))).alias("entry"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("seq")).select(site.alias("site"), F.concat(site, F.lit("/c/"), "seq").alias("url"), "seq")
    targets, notes = sampling.sample_targets(entries, pages)
    both = notes.select("site", "id", "detail").unionByName(targets.select("site", F.lit("target").alias("id"), F.concat(F.lit("c"), F.regexp_extract("url", r"/c/(\d+)$", 1)).alias("detail")))
    return both.select(F.regexp_extract("site", r"n(\d+)", 1).cast("int").alias("site"), "id", "detail")


@query("""
WITH f AS (SELECT 'https://c' || o_custkey % 50 || '.example' AS site, o_orderkey AS k, ['noindex', 'title-short', 'slow', 'img-alt', 'og-webp', 'own-rule'][o_orderkey % 6 + 1] AS id FROM orders WHERE o_orderkey % 5 <> 0),
kept AS (SELECT *, id = 'slow' OR id = 'noindex' AND k % 2 = 0 AND site < 'https://c3' AS silent FROM f),
p AS (SELECT 'https://c' || o_custkey % 50 || '.example' AS site, count(*) FILTER (o_orderkey % 7 > 0) AS pages, count(*) AS requests, count(DISTINCT o_orderkey) FILTER (o_orderkey % 7 = 0) AS hidden FROM orders GROUP BY ALL)
SELECT p.site, pages, requests, hidden AS not_indexable, count(*) FILTER (k IS NOT NULL AND NOT silent) AS findings, count(*) FILTER (silent) AS ignored, p.site || '/sitemap.xml' AS sitemap, DATE '2026-01-01' AS date
FROM p LEFT JOIN kept ON kept.site = p.site GROUP BY ALL
""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 50 sites, with shared and own ignore rules."""
    f = derived.findings_snapshot(spark, sf_dir, 0)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://c"), F.col("o_custkey") % 50, F.lit(".example")).alias("site"), F.col("o_orderkey").alias("k"))
    pages = o.select("site", F.concat("site", F.lit("/p/"), "k").alias("url"), F.when(F.col("k") % 7 > 0, 200).otherwise(500).alias("status"))
    hidden = pages.where("status = 500").select("site", "url").distinct()
    own = o.where("site < 'https://c3'").select("site").distinct().select("site", F.lit("noindex").alias("id"), F.explode(F.array(*(F.lit(f"/p/*{k}") for k in (0, 2, 4, 6, 8)))).alias("url_glob"))
    rules = options.ignore_rules(own, own.select(F.lit("slow").alias("id"), F.lit(None).cast("string").alias("url_glob")))
    kept, ignored = findings.apply_ignores(f, rules), findings.apply_ignores(f, rules, "left_semi")
    maps = o.select("site").distinct().select("site", F.concat("site", F.lit("/sitemap.xml")).alias("source"))
    return findings.run_summary(pages, kept, hidden, ignored, maps, F.lit("2026-01-01").cast("timestamp"))


@query("""
WITH d AS (SELECT doc_id AS n FROM documents)
SELECT n AS src_seq, '/t/' || n % 50 AS target, CASE n % 6 WHEN 0 THEN 'Text here' WHEN 1 THEN 'Alt' WHEN 2 THEN 'Label' WHEN 3 THEN 'Title & more' WHEN 4 THEN '…' ELSE '' END AS name FROM d
""")
def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of links by text, image, label, title, and what a script may fill in; a link of a page to itself has no row."""
    d = _docs(spark, sf_dir)
    inner = "case seq % 6 when 0 then '> <b>Text</b>\n here</a>' when 1 then '><img alt=\"Alt\"></a>' when 2 then ' aria-label=\"Label\"></a>' when 3 then ' title=\"Title &amp; more\"><img></a>' when 4 then '><img :alt=\"x\"></a>' else '><i></i></a>' end"
    body = F.expr(f"concat('<a href=\"../t/', seq % 50, '\"', {inner}, '<a href=\"', seq, '#top\">self</a><a href=\"#x\">no</a><a href=\"https://other.example/\">other</a>')")
    r = d.select("site", F.lit("GET").alias("method"), "url", "seq", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"))
    return features.page_anchors(r).select("src_seq", urls.path(F.col("href")).alias("target"), "name")


@query("""
SELECT doc_id AS seq, doc_id % 3 AS headings, 0 AS images, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS links FROM documents
""")
def attribute_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose attribute values hold whole tags: those are no headings, images or links of the page."""
    d = _docs(spark, sf_dir)
    body = F.expr("concat('<main><div data-a=\"', repeat('<img src=x>', cast(seq % 4 as int)), '\" data-b=\"say <h1>no</h1> <a href=/no>n</a>\">', repeat('<h1>yes</h1>', cast(seq % 3 as int)), if(seq % 5 = 0, '<a href=\"/yes\">y</a>', ''), '</div></main>')")
    r = d.select("site", F.lit("GET").alias("method"), "url", "seq", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"), F.lit(0).alias("ms"))
    links = features.page_links(r).groupBy(F.col("src_seq").alias("seq")).agg(F.count("*").cast("int").alias("links"))
    f = features.page_features(r).select("seq", F.size("h1").alias("headings"), F.size("images").alias("images"))
    return f.join(links.hint("merge"), "seq", "left").fillna(0, ["links"])


@query("""
WITH c AS (SELECT c_nationkey AS k, c_custkey AS n FROM customer),
f AS (SELECT k, count(*) AS urls, sum(octet_length(encode('<url><loc>https://n.example/é/' || n || '</loc><lastmod>' || CASE WHEN k % 3 = 0 THEN '2024-01-01' WHEN k % 3 = 1 THEN '2024-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') ELSE '' END || '</lastmod></url>'))) + 17 AS bytes, k % 3 = 0 AS alike, k % 3 = 2 AS undated FROM c GROUP BY k)
SELECT k, 'size' AS id, urls || ' ' || bytes AS detail FROM f
UNION ALL SELECT k, 'sitemap-lastmod-identical', urls::VARCHAR FROM f WHERE alike AND urls >= 5
UNION ALL SELECT k, 'sitemap-lastmod-missing', '' FROM f WHERE undated
""")
def sitemap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of each nation's customers: its size in addresses and bytes, and dates that are alike, differ, or are missing."""
    entry = "concat('<url><loc>https://n.example/é/', c_custkey, '</loc><lastmod>', case c_nationkey % 3 when 0 then '2024-01-01' when 1 then concat('2024-01-', lpad(c_custkey % 28 + 1, 2, '0')) else '' end, '</lastmod></url>')"
    bodies = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.expr(entry)), ""), F.lit("</urlset>")).alias("body")).withColumn("url", F.lit("/sitemap.xml"))
    files = site_files.sitemap_files(bodies)
    found = site_files.sitemap_findings(files, site_files.sitemap_entries(bodies), F.lit("2026-01-01").cast("timestamp"))
    sizes = files.select("site", F.lit("size").alias("id"), F.concat_ws(" ", "urls", "bytes").alias("detail"))
    return found.select("site", "id", "detail").unionByName(sizes).withColumnRenamed("site", "k")


@query("""
WITH f AS (SELECT DISTINCT o_orderkey AS seq, 'https://c' || o_custkey % 50 || '.example/p/' || o_orderkey AS url FROM orders WHERE o_orderkey % 5 <> 0)
SELECT seq, CASE WHEN seq % 4 = 1 THEN FALSE END AS indexable FROM f
""")
def indexable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of pages of which a quarter isn't to be indexed; the table of those names some pages twice, and pages of other sites."""
    f = derived.findings_snapshot(spark, sf_dir, 0)
    hidden = f.where("seq % 4 = 1").select("site", "url")
    others = f.where("seq % 4 = 2").select(F.lit("https://other.example").alias("site"), "url")
    return findings.tag_indexable(f, hidden.unionByName(hidden).unionByName(others)).select("seq", "indexable")


@query("""
WITH l AS (SELECT DISTINCT 's' || l_orderkey % 3 AS site, l_partkey AS k FROM lineitem WHERE l_partkey % 3 <> 0),
e AS (SELECT 's' || o_orderkey % 3 AS site, o_custkey AS k FROM orders GROUP BY ALL), m AS (SELECT 's' || c_custkey % 4 AS site, count(*) AS n FROM customer GROUP BY ALL)
SELECT site, 'link-sweep-capped' AS id, (count(*) - 200)::VARCHAR AS detail FROM l GROUP BY site HAVING count(*) > 200
UNION ALL SELECT site, 'external-sweep-capped', (count(*) - 100)::VARCHAR FROM e GROUP BY site HAVING count(*) > 100
UNION ALL SELECT site, 'redirect-map-capped', (n - 200)::VARCHAR FROM m WHERE n > 200
""")
def capped_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sweeps of links, of links to other sites and of redirect maps leave when they are capped."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_orderkey % 3) as site", "'internal' as kind", "'p' as src_url", "l_orderkey as src_seq", "0 as pos", "concat('u', l_partkey, '/') as href")
    orders = table(spark, sf_dir, "orders").selectExpr("concat('s', o_orderkey % 3) as site", "'external' as kind", "o_orderkey as src_seq", "concat('x', o_custkey) as href")
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("explode(array('s0', 's1', 's2')) as site", "concat('u', p_partkey) as url")
    targets = response_rules.link_targets(lines, parts, parts.limit(0).withColumnRenamed("url", "loc"))
    rules = site_files.redirect_rules(table(spark, sf_dir, "customer").selectExpr("concat('s', c_custkey % 4) as site", "c_custkey as line_no", "concat('/', c_custkey, ' /to') as line"))
    swept = [
        response_rules.sweep(targets, 200, "link-sweep-capped"),
        response_rules.sweep(response_rules.external_targets(orders), 100, "external-sweep-capped"),
        response_rules.sweep(rules.select("site", F.col("src").alias("url"), F.col("line_no").alias("first_seq")), 200, "redirect-map-capped"),
    ]
    return swept[0][1].unionByName(swept[1][1]).unionByName(swept[2][1]).select("site", "id", "detail")


@query(f"""
WITH {DOCS}, e AS (SELECT site, 'https://out.example/' || n % 200 AS href, n % 200 AS k, min(n) AS first FROM d GROUP BY ALL),
x AS (SELECT *, CASE WHEN k % 6 < 2 THEN 'external-broken' ELSE 'external-redirects' END AS id FROM e WHERE k % 6 < 3),
a AS (SELECT DISTINCT site, url, site || '/x/' || (n + j) % 500 AS target, j FROM d, (VALUES (1), (2), (3)) a(j) WHERE n % 2 = 0)
SELECT site AS url, id, array_to_string(list(href ORDER BY first, href)[1:3], ', ') AS evidence FROM x GROUP BY site, id
UNION ALL SELECT url, 'hreflang-dead', array_to_string(list(target ORDER BY j), ', ') FROM a WHERE regexp_extract(target, '(\\d+)$', 1)::INT % 3 = 0 GROUP BY url
""")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings on links to other sites and on dead alternates name as their first examples."""
    d = _docs(spark, sf_dir)
    links = d.selectExpr("site", "'external' as kind", "concat('https://out.example/', seq % 200) as href", "seq as src_seq", "seq % 200 as k")
    out = links.selectExpr("site", "href", "k").distinct()
    answers = out.selectExpr("site", "stack(2, href, case k % 6 when 0 then 404 when 1 then 0 when 2 then 301 when 3 then 403 else 200 end, concat(href, '/to'), 200) as (url, status)", "concat(href, '/to') as location")
    outside = response_rules.external_findings(links, graph.redirect_chains(out.selectExpr("site", "href as url"), answers))
    pages = d.where("seq % 2 = 0").select("site", "url", "seq", F.expr("transform(array(1, 2, 3), k -> struct('de' as lang, concat(site, '/x/', (seq + k) % 500) as href))").alias("hreflang"))
    gone = d.select("site").distinct().selectExpr("site", "explode(sequence(0, 499, 3)) as k").select("site", F.concat("site", F.lit("/x/"), "k").alias("url"), F.lit(404).alias("status"))
    return outside.unionByName(response_rules.alternate_findings(pages, gone)).select("url", "id", "evidence")
