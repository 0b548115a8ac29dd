"""Registered queries of the audit engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.functions.text import units
from gossamer.operators import crawl, cross_rules, features, findings, graph, options, page_rules, performance, response_rules, sampling, site_files, structured_data
from gossamer.plans import audit, derived, families
from gossamer.plans.derived import table
from gossamer.rules.registry import Rules
from gossamer.sources import responses
from gossamer.streaming import pages as page_stream

QUERIES: dict = dict(families.QUERIES)
ORACLE: dict = dict(families.ORACLE)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str, site=None) -> DataFrame:
    return responses.from_pages(table(spark, sf_dir, "pages"), site)


PAGE_WORDS = r"""
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS m FROM pages),
t AS (SELECT page_id, m, regexp_extract(m, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM m)
SELECT page_id, length(trim(title)) AS title_units, len(regexp_extract_all(m, '(?is)<h1\b[^>]*>(.*?)</h1>')) AS headings,
  len(list_filter(string_split_regex(regexp_replace(m, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) AS words FROM t
"""


@query(PAGE_WORDS)
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.page_features(_pages(spark, sf_dir))
    return f.select(F.col("seq").alias("page_id"), units(F.col("title")).cast("long").alias("title_units"), F.size("h1").cast("long").alias("headings"), F.col("words").cast("long").alias("words"))


@query(r"""
WITH l AS (SELECT DISTINCT page_id AS src_seq, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS ref FROM pages),
p AS (SELECT src_seq, site, regexp_extract_all(ref, '[!-;=?-_a-z|~#@]+|[^!-;=?-_a-z|~#@]+') AS runs FROM l)
SELECT src_seq, site || array_to_string(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[!-;=?-_a-z|~#@]') THEN r ELSE regexp_replace(hex(encode(r)), '(..)', '%\1', 'g') END), '') AS href FROM p
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.page_links(_pages(spark, sf_dir)).select("src_seq", "href")


@query(r"""
WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)
SELECT min_by(url, page_id) AS url, count(*)::VARCHAR AS detail FROM t WHERE title <> '' GROUP BY title HAVING count(*) > 1
""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole corpus as one scope."""
    return cross_rules.duplicates(features.page_features(_pages(spark, sf_dir, F.lit("all"))), "title", "duplicate-title").select("url", "detail")


def _crawl_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.crawl(spark, sf_dir)
    return page_rules.page_findings(r, features.page_features(r))


LIVE = "n % 17 <> 0 AND n % 19 <> 0"
CRAWL_RULES = {
    ("error", "sitemap-redirect"): "n % 17 = 0",
    ("error", "page-status"): "n % 17 <> 0 AND n % 19 = 0",
    ("error", "noindex"): f"{LIVE} AND n % 11 = 0",
    ("error", "x-robots-noindex"): f"{LIVE} AND n % 26 = 13",
    ("warn", "robots-conflict"): f"{LIVE} AND n % 26 = 0 AND n % 11 < 2",
    ("warn", "uncompressed"): f"{LIVE} AND n % 26 = 13 AND units > 5120",
    ("info", "huge-html"): f"{LIVE} AND units > 1048576",
    ("info", "img-alt-long"): f"{LIVE} AND n % 20 = 9",
    ("warn", "nofollow-page"): f"{LIVE} AND n % 11 < 2",
    ("warn", "meta-refresh"): f"{LIVE} AND n % 23 = 0",
    ("error", "title-missing"): f"{LIVE} AND n % 80 = 0",
    ("warn", "title-long"): f"{LIVE} AND n % 80 > 60",
    ("warn", "title-short"): f"{LIVE} AND n % 80 BETWEEN 1 AND 14",
    ("warn", "desc-missing"): f"{LIVE} AND n % 200 = 0",
    ("warn", "desc-long"): f"{LIVE} AND n % 200 > 160",
    ("info", "desc-short"): f"{LIVE} AND n % 200 BETWEEN 1 AND 69",
    ("error", "h1-missing"): f"{LIVE} AND n % 4 = 0",
    ("warn", "h1-multiple"): f"{LIVE} AND n % 4 > 1",
    ("warn", "lang-missing"): f"{LIVE} AND n % 5 = 0",
    ("error", "viewport-missing"): f"{LIVE} AND n % 6 = 0",
    ("warn", "viewport-locked"): f"{LIVE} AND n % 6 IN (2, 3)",
    ("warn", "viewport-fixed-width"): f"{LIVE} AND n % 6 = 1",
    ("warn", "canonical-missing"): f"{LIVE} AND n % 8 = 0",
    ("error", "canonical-multiple"): f"{LIVE} AND n % 8 = 1",
    ("info", "canonical-other"): f"{LIVE} AND n % 8 = 2",
    ("error", "og-image-relative"): f"{LIVE} AND n % 9 = 2",
    ("warn", "og-webp"): f"{LIVE} AND n % 9 = 2 ",
    ("info", "og-no-dimensions"): f"{LIVE} AND n % 9 = 2  ",
    ("error", "hreflang-invalid"): f"{LIVE} AND n % 12 = 0",
    ("warn", "hreflang-no-self"): f"{LIVE} AND n % 12 = 1",
    ("warn", "hreflang-lang-mismatch"): f"{LIVE} AND n % 5 <> 0 AND n % 12 IN (0, 2)",
    ("error", "img-alt"): f"{LIVE} AND n % 5 = 0 ",
    ("warn", "img-alt-filename"): f"{LIVE} AND n % 5 = 1",
    ("warn", "img-alt-placeholder"): f"{LIVE} AND n % 5 = 2",
    ("info", "img-alt-duplicate"): f"{LIVE} AND n % 5 = 3",
    ("info", "img-title-duplicates-alt"): f"{LIVE} AND n % 5 = 3 ",
    ("info", "img-title-on-decorative"): f"{LIVE} AND n % 5 = 4",
    ("warn", "img-dimensions"): f"{LIVE} AND n % 5 = 1 ",
    ("info", "img-srcset"): f"{LIVE} AND n % 5 IN (0, 1)",
    ("warn", "thin-content"): f"{LIVE} AND n % 600 + n % 4 + 2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END < 300",
    ("info", "internal-nofollow"): LIVE,
    ("info", "no-editorial-links"): f"{LIVE} AND n % 2 = 1",
    ("warn", "heading-skip"): f"{LIVE} AND n % 3 = 0",
    ("warn", "url-uppercase"): f"{LIVE} AND n % 16 = 0",
    ("info", "url-underscore"): f"{LIVE} AND n % 16 = 1",
    ("warn", "url-space"): f"{LIVE} AND n % 16 = 2",
    ("warn", "charset-missing"): f"{LIVE} AND n % 7 = 0",
    ("error", "mixed-content"): f"{LIVE} AND n % 14 = 0",
    ("info", "slow"): f"{LIVE} AND n % 10 >= 8",
    ("error", "jsonld-invalid"): f"{LIVE} AND n % 10 = 0",
    ("warn", "jsonld-no-type"): f"{LIVE} AND n % 10 = 1",
}
#: The same markup in DuckDB, to know its length.
MARKUP_SQL = derived.MARKUP.replace("substring_index(url, '/', -2)", "array_to_string(string_split(url, '/')[-2:], '/')")
CRAWL_SQL = (
    "WITH u AS (SELECT doc_id AS n, 'https://' || source || '.example' || CASE doc_id % 16 WHEN 0 THEN '/Page' WHEN 1 THEN '/a_b' WHEN 2 THEN '/a%20b' ELSE '/p' END AS base FROM documents), "
    f"d AS (SELECT n, length({MARKUP_SQL}) AS units FROM (SELECT n, base || '/' || n AS url FROM u)) "
    + " UNION ALL ".join(f"SELECT n AS seq, '{level}' AS level, '{rule}' AS id FROM d WHERE {where}" for (level, rule), where in CRAWL_RULES.items())
    + f" UNION ALL SELECT n, 'warn', 'og-missing' FROM d, (VALUES (1), (2), (3)) k(k) WHERE {LIVE} AND (n % 9 = 0 OR n % 9 = 1 AND k < 3)"
)


#: What each finding says besides its id; nothing where a rule isn't named.
DETAILS = {
    "sitemap-redirect": "'/moved'",
    "page-status": "'404'",
    "noindex": "'noindex, nofollow'",
    "x-robots-noindex": "'noindex'",
    "robots-conflict": "CASE n % 11 WHEN 0 THEN 'index, follow' ELSE 'follow' END",
    "uncompressed": "units::VARCHAR",
    "huge-html": "units::VARCHAR",
    "nofollow-page": "CASE n % 11 WHEN 0 THEN 'noindex, nofollow' ELSE 'nofollow' END || CASE n % 26 WHEN 0 THEN ',all' WHEN 13 THEN ',noindex' ELSE '' END",
    "meta-refresh": "'0; url=/next'",
    "title-long": "(n % 80)::VARCHAR",
    "title-short": "(n % 80)::VARCHAR",
    "desc-long": "(n % 200)::VARCHAR",
    "desc-short": "(n % 200)::VARCHAR",
    "h1-multiple": "CASE n % 4 WHEN 2 THEN 'Head | Head' ELSE 'Head | Head | Head' END",
    "viewport-locked": "CASE n % 6 WHEN 2 THEN 'width=device-width, user-scalable=no' ELSE 'width=device-width, maximum-scale=1.5' END",
    "viewport-fixed-width": "'width=600'",
    "canonical-multiple": "'2'",
    "canonical-other": "site || '/elsewhere'",
    "og-image-relative": "'/i.webp'",
    "og-webp": "'/i.webp'",
    "og-no-dimensions": "'/i.webp'",
    "hreflang-invalid": "'en_GB'",
    "hreflang-lang-mismatch": "CASE n % 12 WHEN 0 THEN 'en_GB' ELSE 'de-AT' END",
    **{k: "'1'" for k in ("img-alt", "img-alt-filename", "img-alt-placeholder", "img-title-duplicates-alt", "img-title-on-decorative", "img-alt-long", "img-dimensions", "img-srcset")},
    "img-alt-duplicate": "'a cat'",
    "thin-content": "(n % 600 + n % 4 + 2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END)::VARCHAR",
    "internal-nofollow": "site || '/home'",
    "heading-skip": "'4'",
    "url-uppercase": "'/Page/' || n",
    "url-underscore": "'/a_b/' || n",
    "url-space": "'/a%20b/' || n",
    "mixed-content": "'http://cdn.example/x.js'",
    "slow": "(n % 10 * 100 + 50)::VARCHAR",
    "jsonld-invalid": "'{bad'",
    "jsonld-no-type": "'{\"name\":\"x\"}'",
}
DETAIL_SQL = (
    CRAWL_SQL.split(" UNION ALL ")[0].split("d AS (SELECT")[0].replace("SELECT doc_id AS n, ", "SELECT doc_id AS n, 'https://' || source || '.example' AS site, ")
    + f"d AS (SELECT n, site, length({MARKUP_SQL}) AS units FROM (SELECT n, site, base || '/' || n AS url FROM u)) "
    + " UNION ALL ".join(f"SELECT n AS seq, '{rule}' AS id, {DETAILS.get(rule, chr(39) * 2)} AS detail FROM d WHERE {where}" for (_, rule), where in CRAWL_RULES.items())
    + f" UNION ALL SELECT n, 'og-missing', ['og:title', 'og:description', 'og:image'][4 - k] FROM d, (VALUES (1), (2), (3)) k(k) WHERE {LIVE} AND (n % 9 = 0 OR n % 9 = 1 AND k < 3)"
)


@query(DETAIL_SQL)
def page_rule_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules on single pages say of each page."""
    return _crawl_findings(spark, sf_dir).select("seq", "id", "detail")


@query(CRAWL_SQL)
def page_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on single pages."""
    return _crawl_findings(spark, sf_dir).select("seq", "level", "id")


OWN_RULES = Rules()


@OWN_RULES.rule("title-repeats-path")
def title_repeats_path(tables: dict[str, DataFrame]) -> DataFrame:
    """A rule over a site: pages whose title is as long as that of more than ten pages of their site."""
    f = tables["features"].select("site", "url", "seq", F.length("title").alias("n"))
    common = f.groupBy("site", "n").agg(F.count("*").alias("pages")).where("pages > 10")
    rows = f.join(common.hint("merge"), ["site", "n"])
    return rows.select("site", "url", "seq", F.lit("info").alias("level"), F.lit("title-repeats-path").alias("id"), F.lit("Titles are of one length").alias("title"), F.concat("pages", F.lit("")).alias("detail"))


@OWN_RULES.page_rule("even-headings", columns=["h1", "h2", "headers"])
def even_headings(page: dict):
    """A rule in Python over pages: findings for pages with two main headings, worse for those that aren't compressed."""
    if len(page["h1"]) == 2:
        yield "warn" if "content-encoding" in page["headers"] else "error", "Two main headings", len(page["h1"]) + len(page["h2"])


@OWN_RULES.rule("never-there")
def never_there(tables: dict[str, DataFrame]) -> DataFrame:
    """A rule that can't be planned; the others run all the same."""
    return tables["features"].select("no_such_column")


@query(f"""
WITH d AS (SELECT doc_id AS n, source, doc_id % 80 AS t FROM documents WHERE {LIVE.replace("n %", "doc_id %")}),
c AS (SELECT source, t, count(*) AS pages FROM d GROUP BY source, t HAVING count(*) > 10)
SELECT n AS seq, 'title-repeats-path' AS id, 'info' AS level, pages::VARCHAR AS detail FROM d JOIN c ON c.source = d.source AND c.t = d.t
UNION ALL SELECT n, 'even-headings', CASE WHEN n % 2 = 0 THEN 'warn' ELSE 'error' END, '3' FROM d WHERE n % 4 = 2
UNION ALL SELECT NULL, 'rule-failed', 'error', 'never-there'
""")
def own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of a user's own, one over DataFrames and one in Python, and one that fails."""
    found, failed = OWN_RULES.run({"features": features.page_features(derived.crawl(spark, sf_dir))})
    failures = failed.select(F.lit(None).cast("long").alias("seq"), F.lit("rule-failed").alias("id"), F.lit("error").alias("level"), F.col("rule").alias("detail"))
    return found.select("seq", "id", "level", "detail").unionByName(failures)


@query(f"SELECT level, id, count(*) AS findings FROM ({CRAWL_SQL}) GROUP BY ALL")
def audit_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check_summary(_crawl_findings(spark, sf_dir), ()).select("level", "id", "findings")


@query("""
WITH d AS (SELECT doc_id AS n FROM documents) SELECT n AS seq, 'Article.headline, Event.location, Event.startDate, Recipe.image' AS detail FROM d WHERE n % 17 <> 0 AND n % 19 <> 0 AND n % 10 = 3
UNION ALL SELECT n, 'Product.name' FROM d WHERE n % 17 <> 0 AND n % 19 <> 0 AND n % 10 = 2
""")
def schema_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.page_features(derived.crawl(spark, sf_dir))
    return structured_data.incomplete_nodes(structured_data.jsonld_nodes(f)).select("seq", "detail")


@query("""
WITH d AS (SELECT doc_id AS n FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0)
SELECT n AS seq FROM d WHERE n % 16 > 2 AND n % 10 <> 3
""")
def schema_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.page_features(derived.crawl(spark, sf_dir))
    rules = f.select("site").distinct().select("site", F.lit("/p/**").alias("url_glob"), F.lit("Event").alias("type"))
    return structured_data.missing_types(f, structured_data.jsonld_nodes(f), rules).select("seq")


@query("""
SELECT doc_id AS seq FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 26 = 13 OR doc_id % 8 IN (1, 2)
""")
def not_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.crawl(spark, sf_dir)
    hidden = findings.not_indexable(r, features.page_features(r))
    return hidden.join(r.select("site", "url", "seq"), ["site", "url"]).select("seq")


def _next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("'s' as site", "l_orderkey", "l_partkey as src", "l_linenumber", "lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst").where("dst is not null").selectExpr("site", "src", "dst", "l_orderkey as ord")


@query("""
WITH RECURSIVE e AS (SELECT src, dst, min(ord) AS ord FROM (SELECT l_orderkey AS ord, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
home AS (SELECT min(src) AS k FROM e),
walk(k, depth) USING KEY (k) AS (SELECT k, 0 FROM home UNION
  SELECT e.dst, min(walk.depth + 1) FROM walk JOIN e ON e.src = walk.k LEFT JOIN recurring.walk AS known ON known.k = e.dst WHERE known.k IS NULL GROUP BY e.dst)
SELECT w.k, w.depth, CASE WHEN w.depth > 0 THEN (SELECT arg_min(e.src, (ord, e.src)) FROM e JOIN walk p ON p.k = e.src WHERE e.dst = w.k AND p.depth = w.depth - 1) END AS via FROM walk w
""")
def click_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _next_links(spark, sf_dir)
    homes = links.where("src <> dst").groupBy("site").agg(F.min("src").alias("k"))
    return graph.click_depth(links, homes).select("k", "depth", "via")


@query("""
WITH RECURSIVE r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 301 WHEN o_orderkey % 9 = 0 THEN 404 ELSE 200 END AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
walk AS (SELECT k AS start, k AS cur, s, 1 AS hops, nxt FROM r UNION ALL SELECT w.start, r.k, r.s, hops + 1, r.nxt FROM walk w JOIN r ON r.k = w.nxt WHERE w.s = 301 AND hops < 5)
SELECT start, arg_max(s, hops) AS final_status, max(hops) AS n_hops FROM walk GROUP BY start
""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select(F.ltrim(F.col("start"), F.lit("/")).cast("long").alias("start"), "final_status", F.size("hops").cast("long").alias("n_hops"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each order; a fourth redirect to the customer's next order."""
    o = table(spark, sf_dir, "orders")
    status = "case when o_orderkey % 4 = 0 then 301 when o_orderkey % 9 = 0 then 404 else 200 end as status"
    return o.selectExpr("'s' as site", "concat('/', o_orderkey) as url", status, "concat('/', lead(o_orderkey) over (partition by o_custkey order by o_orderkey)) as location")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return graph.redirect_chains(log.select("site", "url"), log)


@query("""
WITH o AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k FROM i)
SELECT user_id, min(event_seq) AS settled_at FROM (SELECT user_id, epoch_us(ts)::VARCHAR || lpad(event_id::VARCHAR, 12, '0') AS event_seq, k FROM n) WHERE k = 3 GROUP BY user_id
""")
def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("at"))
    return graph.settled(e, "user_id", "at", "event_type")


ROBOTS = "User-agent: other\\nDisallow: /\\n\\nUser-agent: googlebot\\nUser-agent: two # stacked\\nDisallow: /a/\\nAllow: /a/1*\\nDisallow: /*7$\\nAllow: /b\\nDisallow: /b\\nDisallow:\\n"


@query("""
WITH p AS (SELECT c_nationkey AS k, '/' || CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || '/' || c_custkey AS path FROM customer)
SELECT DISTINCT k, path, CASE WHEN path LIKE '/a/1%' THEN TRUE WHEN path LIKE '/a/%' THEN FALSE WHEN path LIKE '%7' THEN FALSE ELSE TRUE END AS allowed FROM p
""")
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    bodies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("site"), F.expr(f"'{ROBOTS}'").alias("body"))
    paths = c.select(F.col("c_nationkey").alias("site"), F.expr("concat('/', element_at(array('a','b','c'), cast(c_custkey % 3 as int) + 1), '/', c_custkey)").alias("path"))
    return site_files.robots_verdicts(paths, site_files.robots_rules(bodies)).select(F.col("site").alias("k"), "path", "allowed")


@query("""
SELECT '/o/' || o_custkey || '/' || o_orderkey AS path, NOT (o_custkey % 3 = 0 AND NOT (o_custkey % 2 = 0 AND o_orderkey % 10 = 7)) AS allowed,
  CASE WHEN o_custkey % 6 = 0 AND o_orderkey % 10 = 7 THEN '/o/' || o_custkey || '/*7$' WHEN o_custkey % 3 = 0 THEN '/o/' || o_custkey || '/' END AS rule
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def robots_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots.txt of one site with a rule or two for every third customer, over a path for each order."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("'s' as site", "0 as group_no", "'*' as agent", "inline(filter(array(struct(false as allow, concat('/o/', c_custkey, '/') as path), if(c_custkey % 2 = 0, struct(true as allow, concat('/o/', c_custkey, '/*7$') as path), null)), x -> x is not null))")
    paths = table(spark, sf_dir, "orders").selectExpr("'s' as site", "concat('/o/', o_custkey, '/', o_orderkey) as path")
    return site_files.robots_verdicts(paths, c).select("path", "allowed", "rule")


@query("""
SELECT n_nationkey AS site, '/c/*' AS glob, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0
UNION ALL SELECT c_nationkey, '/**/9', c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 10 = 9
""")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), "c_custkey", F.expr("concat('/c/', if(c_custkey % 2 = 0, concat(c_custkey), concat(c_custkey, '/', c_custkey % 10)))").alias("path"))
    globs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("site"), F.explode(F.array(F.lit("/c/*"), F.lit("/**/9"))).alias("glob"))
    hits = sampling.glob_matches(c, globs)
    return hits.join(c, ["site", "path"]).select("site", "glob", "c_custkey")


@query("""
WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer)
SELECT DISTINCT c_nationkey, c_custkey FROM n, range(7) r(i) WHERE size <= 7 OR place = i * size // 7
""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return sampling.spread_sample(c, 7, ["c_nationkey"], ["c_custkey"])


SNAPSHOT = """SELECT 'https://c' || o_custkey %% 50 || '.example' AS site, 'https://c' || o_custkey %% 50 || '.example/p/' || o_orderkey AS url, o_orderkey,
  ['error', 'warn', 'info'][o_orderkey %% 3 + 1] AS level, ['noindex', 'title-short', 'slow', 'img-alt', 'og-webp', 'own-rule'][o_orderkey %% 6 + 1] AS id FROM orders WHERE o_orderkey %% 5 <> {which}""".replace("%%", "%")
BEFORE, AFTER = SNAPSHOT.format(which=0), SNAPSHOT.format(which=1)


@query(f"SELECT coalesce(a.id, b.id) AS id, coalesce(a.url, b.url) AS place, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'fixed' ELSE 'unchanged' END AS change FROM ({BEFORE}) b FULL JOIN ({AFTER}) a ON a.site = b.site AND a.id = b.id AND a.url = b.url")
def findings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.diff(derived.findings_snapshot(spark, sf_dir, 0), derived.findings_snapshot(spark, sf_dir, 1)).select("id", "place", "change")


@query(f"SELECT count(*) AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 5 = 1 THEN 'fixed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY change")
def findings_diff_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.findings_snapshot(spark, sf_dir, 0)
    a = derived.findings_snapshot(spark, sf_dir, 1).withColumn("url", F.replace("url", F.lit(".example"), F.lit(".test")))
    return findings.diff(b, a, ignore_host=True).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""
WITH f AS ({BEFORE}), s AS (SELECT site, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'info') AS notes FROM f GROUP BY site),
r AS (SELECT 'https://c' || k || '.example' AS site, k AS pages FROM range(60) t(k))
SELECT r.site, pages, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(notes, 0) AS notes, pages = 0 AS empty FROM r LEFT JOIN s ON r.site = s.site
""")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.range(60).select(F.concat(F.lit("https://c"), "id", F.lit(".example")).alias("site"), F.col("id").alias("pages"))
    return findings.portfolio(runs, derived.findings_snapshot(spark, sf_dir, 0))


@query(f"""
WITH s AS (SELECT site, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'info') AS notes FROM ({BEFORE}) GROUP BY site)
SELECT count(*) AS sites, count(*) AS pages, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(notes)::BIGINT AS notes, count(*) FILTER (errors > 0) AS sites_with_errors FROM s
""")
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived.findings_snapshot(spark, sf_dir, 0)
    return findings.portfolio_totals(findings.portfolio(f.select("site").distinct().withColumn("pages", F.lit(1).cast("long")), f))


@query(f"""
WITH c AS (SELECT site, CASE id WHEN 'noindex' THEN 'Indexability' WHEN 'title-short' THEN 'Content' WHEN 'slow' THEN 'Performance' WHEN 'img-alt' THEN 'Images' WHEN 'og-webp' THEN 'Social' ELSE 'Other' END AS category, level, id FROM ({BEFORE}))
SELECT site, category, count(*) AS findings, count(DISTINCT id) AS rules, ['error', 'warn', 'info'][min(CASE level WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END)] AS worst FROM c GROUP BY site, category
""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.category_summary(derived.findings_snapshot(spark, sf_dir, 0))


@query(f"SELECT site, bool_and(level = 'info') AS passed FROM ({BEFORE}) GROUP BY site")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived.findings_snapshot(spark, sf_dir, 0)
    return findings.gate(f, f, "warn")


GATES = f"""
WITH b AS ({BEFORE}), a AS ({AFTER}), sites AS (SELECT DISTINCT site FROM a),
new AS (SELECT DISTINCT a.site FROM a LEFT JOIN b ON b.site = a.site AND b.id = a.id AND b.url = a.url WHERE b.id IS NULL),
g AS (SELECT 'error' AS mode, site, NOT EXISTS (SELECT 1 FROM a WHERE a.site = s.site AND level = 'error') AS passed FROM sites s
  UNION ALL SELECT 'warn', site, NOT EXISTS (SELECT 1 FROM a WHERE a.site = s.site AND level <> 'info') FROM sites s
  UNION ALL SELECT 'new', site, NOT EXISTS (SELECT 1 FROM new WHERE new.site = s.site) FROM sites s UNION ALL SELECT 'never', site, TRUE FROM sites)
SELECT * FROM g UNION ALL SELECT mode, 'portfolio', bool_and(passed) FROM g GROUP BY mode
"""


@query(GATES)
def gate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode of the gate for each site, and for the portfolio; two thirds of the sites have but notes in one half of them."""
    before, after = (derived.findings_snapshot(spark, sf_dir, k) for k in (0, 1))
    added = findings.diff(before, after).where("change = 'added'")
    out = None
    for mode in ("error", "warn", "new", "never"):
        g = findings.gate(after, after, mode, added)
        rows = g.unionByName(findings.gate_portfolio(g).select(F.lit("portfolio").alias("site"), "passed")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out.select("mode", "site", "passed")


@query(f"""
WITH c AS (SELECT site, CASE id WHEN 'noindex' THEN 'Indexability' WHEN 'title-short' THEN 'Content' WHEN 'slow' THEN 'Performance' WHEN 'img-alt' THEN 'Images' WHEN 'og-webp' THEN 'Social' ELSE 'Other' END AS category, level, id FROM ({BEFORE}))
SELECT site, category, level, GROUPING_ID(site, category, level)::INT AS grouping, count(*) AS findings, count(DISTINCT id) AS rules FROM c GROUP BY ROLLUP (site, category, level)
""")
def portfolio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rollup(derived.findings_snapshot(spark, sf_dir, 0))


@query(f"""
WITH a AS ({AFTER}), b AS ({BEFORE}), w AS (SELECT 1 AS run, * FROM b UNION ALL SELECT 2, * FROM a WHERE o_orderkey % 3 = 0 AND site LIKE '%c%0.example'),
last AS (SELECT *, max(run) OVER (PARTITION BY site) AS newest FROM w)
SELECT site, id, url, run AS date, count(*) OVER (PARTITION BY site) AS pages FROM last WHERE run = newest
""")
def findings_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of all sites, then one of some of them, written to one place as documents and read back: the others keep what they had. With the meta of each site."""
    path = graph.scratch(spark, "findings-documents")
    second = derived.findings_snapshot(spark, sf_dir, 1).where(F.col("site").like("%c%0.example") & (F.col("seq") % 3 == 0))
    for run, found in enumerate((derived.findings_snapshot(spark, sf_dir, 0), second), 1):
        findings.write_findings(found, path, "json", str(run), found.groupBy("site").agg(F.count("*").alias("pages")))
    runs = findings.read_runs(spark, path).select("site", F.col("date").cast("int").alias("date"), F.col("meta.pages").alias("pages"))
    return findings.read_findings(spark, path).join(runs.hint("merge"), "site").select("site", "id", "url", "date", "pages")


@query("""
WITH o AS (SELECT o_custkey AS url, o_orderkey AS seq, o_orderkey % 2 AS m, o_orderkey % 3 AS day FROM orders)
SELECT url, CASE m WHEN 0 THEN 'HEAD' ELSE 'GET' END AS method, seq, 'body ' || seq AS body FROM o QUALIFY row_number() OVER (PARTITION BY url, m ORDER BY day DESC, seq DESC) = 1
""")
def latest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a customer's orders are fetches of one address, written to files; only the keys of superseded rows move."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "'s' as site", "if(o_orderkey % 2 = 0, 'HEAD', 'GET') as method", "concat(o_custkey) as url", "o_orderkey as seq", "200 as status", "cast(null as map<string,string>) as headers", "concat('body ', o_orderkey) as body", "cast(null as string) as location", "1 as ms", "cast(null as string) as error",
        "timestamp_millis(o_orderkey % 3 * 86400000) as fetched_at",
    )
    path = graph.scratch(spark, "log")
    o.write.parquet(path)
    return responses.read_latest(spark, path).select(F.col("url").cast("long").alias("url"), "method", "seq", "body")


@query("""
SELECT c_custkey AS url, 'psi-score' AS id, (c_custkey % 100)::VARCHAR AS detail FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 100 < 90
UNION ALL SELECT c_custkey, 'psi-no-field-data', '' FROM customer WHERE c_custkey % 3 <> 1
""")
def performance_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile payloads alone; some rows name no strategy."""
    p = table(spark, sf_dir, "customer").selectExpr("'s' as site", "c_custkey as url", "element_at(array('mobile', 'desktop', null), cast(c_custkey % 3 as int) + 1) as strategy", """concat('{"lighthouseResult":{"categories":{"performance":{"score":', c_custkey % 100 / 100, '}}}}') as payload""", "cast(null as string) as error")
    return performance.performance_findings(p, "mobile").select("url", "id", "detail")


@query(f"SELECT id, url FROM ({BEFORE}) WHERE NOT (id = 'slow' OR id = 'noindex' AND url LIKE '%/p/1%')")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(None, "slow", None), (None, "noindex", "/p/1*")], "site string, id string, url_glob string")
    return findings.apply_ignores(derived.findings_snapshot(spark, sf_dir, 0), rules).select("id", "url")


@query("""
WITH o AS (SELECT o_custkey AS url, o_orderkey % 2 AS m, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 405 WHEN 2 THEN 404 ELSE 200 END AS s FROM orders),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url, m ORDER BY seq DESC) = 1),
b AS (SELECT url, max(s) FILTER (m = 0) AS head, max(s) FILTER (m = 1) AS get FROM l GROUP BY url)
SELECT url, CASE WHEN head IS NULL OR head IN (405, 501) THEN coalesce(get, head) ELSE head END AS status FROM b
""")
def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("'s' as site", "if(o_orderkey % 2 = 0, 'HEAD', 'GET') as method", "o_custkey as url", "o_orderkey as seq", "case o_orderkey % 4 when 0 then 405 when 2 then 404 else 200 end as status", "cast(null as timestamp) as fetched_at")
    return responses.asset_status(responses.latest(o)).select("url", "status")


@query("""
WITH e AS (SELECT source AS site, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN '2031-01-01' ELSE '2024-05-0' || (doc_id % 9 + 1) END AS lastmod FROM documents)
SELECT site, 'sitemap-lastmod-future' AS id, count(*)::VARCHAR AS detail FROM e WHERE lastmod = '2031-01-01' GROUP BY site
UNION ALL SELECT site, 'sitemap-lastmod-identical', count(lastmod)::VARCHAR FROM e GROUP BY site HAVING count(lastmod) >= 5 AND count(DISTINCT lastmod) = 1
""")
def sitemap_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("source as site", "concat('https://', source, '.example/sitemap', doc_id, '.xml') as url", """concat('<urlset><url><loc> https://x/', doc_id, '?a=1&amp;b </loc>', case when doc_id % 3 = 0 then '' when doc_id % 50 = 1 then '<lastmod>2031-01-01</lastmod>' else concat('<lastmod>2024-05-0', doc_id % 9 + 1, '</lastmod>') end, '</url></urlset>') as body""")
    return site_files.sitemap_findings(site_files.sitemap_files(d), site_files.sitemap_entries(d), F.lit("2026-01-01").cast("timestamp")).select("site", "id", "detail")


@query("""
WITH RECURSIVE r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 301 WHEN o_orderkey % 9 = 0 THEN 404 ELSE 200 END AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
walk AS (SELECT k AS start, k AS cur, s, 1 AS hops, nxt FROM r UNION ALL SELECT w.start, r.k, r.s, hops + 1, r.nxt FROM walk w JOIN r ON r.k = w.nxt WHERE w.s = 301 AND hops < 5),
c AS (SELECT start, arg_max(s, hops) AS f, arg_min(s, hops) AS h, CASE WHEN arg_max(s, hops) = 301 AND max(hops) = 5 THEN arg_max(nxt, hops) ELSE arg_max(cur, hops) END AS final, count(*) FILTER (s = 301) AS moved FROM walk GROUP BY start),
k AS (SELECT CASE WHEN h = 404 THEN 'redirect-dead' WHEN h = 200 THEN 'redirect-not-applied' WHEN f <> 200 THEN 'redirect-broken' ELSE 'rest' END AS id, * FROM c)
SELECT id, count(*)::VARCHAR AS detail FROM k WHERE id <> 'rest' GROUP BY id
UNION ALL SELECT 'redirect-hops', count(*)::VARCHAR FROM k WHERE id = 'rest' AND moved > 1 HAVING count(*) > 0
UNION ALL SELECT 'redirect-elsewhere', count(*)::VARCHAR FROM k WHERE id = 'rest' AND final <> start + 1 HAVING count(*) > 0
""")
def redirect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").selectExpr("'s' as site", "o_orderkey as line_no", "concat('/', o_orderkey, '  /', o_orderkey + 1, ' 301! # moved') as line")
    return site_files.redirect_findings(site_files.redirect_rules(lines), _chains(spark, sf_dir)).select("id", "detail")


@query("""
WITH d AS (SELECT source AS site, doc_id AS n, 'https://' || source || '.example/' || doc_id AS url FROM documents),
e AS (SELECT site, n, CASE WHEN n % 3 = 0 THEN 'https://' || site || '.example/' || (n + 20) ELSE NULL END AS dst FROM d)
SELECT e.n AS seq, e.dst AS detail FROM e JOIN d ON e.dst = d.url AND e.site = d.site WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.n = d.n AND b.dst = 'https://' || e.site || '.example/' || e.n)
""")
def hreflang_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("source as site", "concat('https://', source, '.example/', doc_id) as url", "doc_id as seq", "if(doc_id % 3 = 0, array(struct('en' as lang, concat('https://', source, '.example/', doc_id + 20) as href)), cast(array() as array<struct<lang:string,href:string>>)) as hreflang")
    return cross_rules.one_way_alternates(d).select("seq", "detail")


@query("""
WITH a AS (SELECT (o_custkey % 20)::VARCHAR AS site, o_custkey AS target, o_orderkey AS o, CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN 'Read more…' ELSE 'Order ' || o_orderkey END AS name FROM orders),
blank AS (SELECT site, target, count(*) AS n, min(o) AS first FROM a WHERE name = '' GROUP BY ALL),
generic AS (SELECT DISTINCT site, target FROM a WHERE name = 'Read more…')
SELECT site, 'https://x/' || target AS url, 'link-no-text' AS id, n::VARCHAR AS detail FROM blank QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, first) <= 10
UNION ALL SELECT site, site::VARCHAR, 'link-no-text-more', (count(*) - 10)::VARCHAR FROM blank GROUP BY site HAVING count(*) > 10
UNION ALL (SELECT site, 'https://x/' || target || '/', 'anchor-generic', 'read more…' FROM generic QUALIFY row_number() OVER (PARTITION BY site ORDER BY 'https://x/' || target || '/') <= 10)
UNION ALL SELECT site, site::VARCHAR, 'anchor-generic-more', (count(*) - 10)::VARCHAR FROM generic GROUP BY site HAVING count(*) > 10
""")
def anchor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").selectExpr("concat(o_custkey % 20) as site", "'x' as src_url", "o_orderkey as src_seq", "0 as pos", "concat('https://x/', o_custkey) as href", "case when o_custkey % 4 = 0 then '' when o_custkey % 4 = 1 then 'Read more…' else concat('Order ', o_orderkey) end as name")
    pages = a.select("site", F.concat("href", F.lit("/")).alias("url")).distinct().withColumn("seq", F.lit(1).cast("long"))
    both = cross_rules.nameless_links(a).unionByName(cross_rules.generic_anchors(a, pages))
    return both.select("site", F.col("url").cast("string").alias("url"), "id", "detail")


@query("""
WITH c AS (SELECT c_custkey AS url, c_custkey % 100 AS s, c_custkey % 5000 AS lcp FROM customer)
SELECT url, CASE WHEN s < 50 THEN 'error' ELSE 'warn' END AS level, 'psi-score' AS id FROM c WHERE s < 90
UNION ALL SELECT url, CASE WHEN lcp > 4000 THEN 'error' ELSE 'warn' END, 'psi-lcp' FROM c WHERE lcp > 2500
UNION ALL SELECT url, 'error', 'psi-field-lcp' FROM c WHERE s % 3 = 0
UNION ALL SELECT url, 'info', 'psi-no-field-data' FROM c WHERE s % 3 = 1
UNION ALL SELECT url, 'warn', 'psi-opportunity' FROM c WHERE lcp % 500 >= 250
""")
def performance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").selectExpr("'s' as site", "c_custkey as url", """concat('{"lighthouseResult":{"categories":{"performance":{"score":', c_custkey % 100 / 100, '}},"audits":{"largest-contentful-paint":{"numericValue":', c_custkey % 5000, '},"unused":{"details":{"overallSavingsMs":', c_custkey % 500, '}}}}',
      case c_custkey % 100 % 3 when 0 then ',"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"category":"SLOW"}}}' when 1 then '' else ',"loadingExperience":{"metrics":{"INTERACTION_TO_NEXT_PAINT":{"category":"FAST"}}}' end, '}') as payload""", "cast(null as string) as error")
    return performance.performance_findings(p).select("url", "level", "id")


@query("""
SELECT s_suppkey AS site, CASE WHEN s_suppkey % 40 < 20 THEN 'tls-expired' ELSE 'tls-expiring' END AS id, (s_suppkey % 40 - 20)::VARCHAR AS detail FROM supplier WHERE s_suppkey % 40 - 20 <= 14
""")
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    certs = s.select(F.col("s_suppkey").alias("host"), F.timestamp_add("DAY", (F.col("s_suppkey") % 40 - 20).cast("int"), now).alias("not_after"))
    return response_rules.certificate_findings(s.select(F.col("s_suppkey").alias("site"), F.col("s_suppkey").alias("host")), certs, now).select("site", "id", "detail")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS k FROM lineitem),
t AS (SELECT k, count(*) AS n, min(src) AS first FROM l WHERE k % 3 <> 0 AND k % 5 <> 0 GROUP BY k),
absent AS (SELECT k, row_number() OVER (ORDER BY first, 'u' || k || '/') AS place FROM t WHERE k % 7 NOT IN (1, 2) AND k % 2 = 0),
named AS (SELECT k, string_agg('p' || src, ', ' ORDER BY src) AS evidence FROM (SELECT k, src FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY src) <= 3) GROUP BY k)
SELECT 'u' || t.k || '/' AS url, 'broken-link' AS id, n::VARCHAR AS detail, evidence FROM t JOIN named ON named.k = t.k WHERE t.k % 7 = 1
UNION ALL SELECT 'u' || k || '/', 'missing-from-sitemap', '', NULL FROM absent WHERE place <= 20
UNION ALL SELECT 's', 'missing-from-sitemap-more', (count(*) - 20)::VARCHAR, NULL FROM absent HAVING count(*) > 20
UNION ALL SELECT 's', 'link-redirects', count(*)::VARCHAR, array_to_string(list('u' || k || '/' ORDER BY first, 'u' || k || '/')[1:3], ', ') FROM t WHERE k % 7 = 2 HAVING count(*) > 0
""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as targets: a third were crawled, a fifth are listed, of the rest some answer 404 and some redirect."""
    links = table(spark, sf_dir, "lineitem").selectExpr("'s' as site", "'internal' as kind", "concat('p', l_orderkey) as src_url", "l_orderkey as src_seq", "0 as pos", "concat('u', l_partkey, '/') as href").distinct()
    # read by the sweep and for examples, and the sweep by every rule: each is computed once
    links = graph.kept(links, "links")
    parts = table(spark, sf_dir, "part").selectExpr("'s' as site", "p_partkey as k", "concat('u', p_partkey) as url")
    statuses = parts.selectExpr("site", "concat(url, '/') as url", "case k % 7 when 1 then 404 when 2 then 301 else 200 end as status", "k % 2 = 0 as is_html")
    swept = graph.kept(response_rules.link_status(links, parts.where("k % 3 = 0"), parts.where("k % 5 = 0").withColumnRenamed("url", "loc"), statuses), "swept")
    return response_rules.link_findings(swept, parts.where("k % 5 = 0").withColumnRenamed("url", "loc"), links=links).select("url", "id", "detail", "evidence")


@query("""
WITH c AS (SELECT 'https://c' || c_custkey || '.example' AS site, c_custkey AS k FROM customer)
SELECT site, site || CASE WHEN k % 6 = 0 THEN '/declared.xml' WHEN k % 5 = 0 THEN '/sitemap_index.xml' ELSE '/sitemap.xml' END AS source,
  site || CASE WHEN k % 6 = 0 THEN '/declared.xml' WHEN k % 5 = 0 THEN '/child.xml' ELSE '/sitemap.xml' END AS url, octet_length(encode('<urlset><url><loc>' || site || '/</loc></url></urlset>')) AS n_bytes
FROM c WHERE k % 6 = 0 OR k % 5 = 0 OR k % 7 <> 0
""")
def sitemap_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each customer: a third declare a sitemap, half of which are missing; some have an index, whose child may be empty; some redirect."""
    c = table(spark, sf_dir, "customer").selectExpr("concat('https://c', c_custkey, '.example') as site", "c_custkey as k").withColumn("full", F.expr("concat('<urlset><url><loc>', site, '/</loc></url></urlset>')"))
    robots = c.where("k % 3 = 0").selectExpr("site", "concat('User-agent: *\\nSitemap: ', site, '/declared.xml') as body")
    files = c.selectExpr(
        "site",
        """stack(5,
          '/declared.xml', if(k % 2 = 0, 200, 404), cast(null as string), full,
          '/sitemap_index.xml', if(k % 5 < 2, 200, 404), null, concat('<sitemapindex><sitemap><loc>', site, '/child.xml</loc></sitemap></sitemapindex>'),
          '/child.xml', 200, null, if(k % 5 = 0, full, '<urlset></urlset>'),
          '/sitemap.xml', case k % 7 when 0 then 404 when 1 then 301 else 200 end, concat(site, '/moved.xml'), full,
          '/moved.xml', 200, null, full) as (path, status, location, body)""",
    )
    log = files.select("site", F.concat("site", "path").alias("url"), "status", "location", "body")
    chosen = crawl.chosen_sitemaps(crawl.sitemap_candidates(c, robots), log)
    return chosen.select("site", "source", "url", F.octet_length("body").cast("long").alias("n_bytes"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst AND dst % 10 > 1),
home AS (SELECT min(src) AS k FROM e),
walk(k, depth) USING KEY (k) AS (SELECT k, 0 FROM home UNION
  SELECT e.dst, min(walk.depth + 1) FROM walk JOIN e ON e.src = walk.k LEFT JOIN recurring.walk AS known ON known.k = e.dst WHERE known.k IS NULL GROUP BY e.dst)
SELECT 'https://s.example/p/' || k AS k, depth FROM walk
""")
def crawl_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, linked in the order of an order's lines; some targets are files, barred by robots, or moved."""
    # read for links, for the addresses that are asked, and for home
    lines = graph.kept(_next_links(spark, sf_dir).where("src <> dst"), "lines")
    href = "concat('https://s.example', case dst % 10 when 0 then concat('/p/', dst, '.pdf') when 1 then concat('/x/', dst) when 2 then concat('/old/', dst) else concat('/p/', dst, '#f') end) as href"
    links = lines.selectExpr("'https://s.example' as site", "concat('https://s.example/p/', src) as src_url", "cast(dst % 50 as int) as pos", href, "'internal' as kind")
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as k")
    forms = parts.selectExpr("stack(4, concat('/p/', k), 200, cast(null as string), concat('/p/', k, '/'), 200, null, concat('/x/', k), 200, null, concat('/old/', k), 301, concat('https://s.example/p/', k, '/')) as (path, status, location)")
    log = forms.select(F.lit("https://s.example").alias("site"), F.concat(F.lit("https://s.example"), "path").alias("url"), "status", "location")
    starts = links.select("site", F.regexp_replace("href", "#.*$", "").alias("url")).distinct()
    robots = site_files.robots_rules(spark.createDataFrame([("https://s.example", "User-agent: *\nDisallow: /x/")], "site string, body string"))
    verdicts = site_files.robots_verdicts(starts.select("site", urls.path(F.col("url")).alias("path")), robots)
    home = lines.where("dst % 10 > 1").agg(F.min("src").alias("k")).selectExpr("'https://s.example' as site", "concat('https://s.example/p/', k) as url")
    seen, _ = crawl.reachable(home, crawl.link_edges(links, graph.redirect_chains(starts, log), verdicts))
    return seen.select("k", F.col("depth").cast("long").alias("depth"))


@query("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'redirect-chain' ELSE 'host-variant-dead' END AS id, CASE c_custkey % 5 WHEN 0 THEN '2' ELSE '500' END AS detail FROM customer WHERE c_custkey % 5 < 2
""")
def host_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host for each customer: a name, a name with www and a port, or a word; the plain scheme redirects once or twice, or fails."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "case c_custkey % 3 when 0 then concat('c', c_custkey, '.example') when 1 then concat('c', c_custkey, '.example:81') else concat('local', c_custkey) end as host")
    c = c.withColumn("site", F.concat(F.lit("https://"), F.when(F.col("k") % 3 == 1, F.lit("www.")).otherwise(F.lit("")), "host"))
    log = c.selectExpr("site", "stack(3, concat('http://', host, '/'), if(k % 5 = 1, 500, 301), concat('https://', host, '/'), concat('https://', host, '/'), if(k % 5 = 0, 301, 200), concat('https://', host, '/home'), concat('https://', host, '/home'), 200, null) as (url, status, location)")
    variants = response_rules.host_variants(c)
    found = response_rules.host_variant_findings(variants, graph.redirect_chains(variants, log))
    return found.join(c.select("site", "k").hint("merge"), "site").select("k", "id", "detail")


@query("""
SELECT 'https://' || source || '.example' AS site, 'schema-image-broken' AS id, count(DISTINCT doc_id % 1000)::VARCHAR AS detail FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 1000 % 3 = 0 GROUP BY source
""")
def schema_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("concat('https://', source, '.example') as site", "doc_id as seq", "concat('https://cdn.example/', doc_id % 1000, '.png') as image", "doc_id % 1000 % 3 = 0 as dead")
    block = "case seq % 4 when 0 then concat('{\"@type\":\"Article\",\"image\":\"', image, '\"}') when 1 then concat('{\"@type\":\"Article\",\"image\":[{\"url\":\"', image, '\"},\"/own.png\"]}') when 2 then concat('{\"@graph\":[{\"@type\":\"Organization\",\"logo\":{\"url\":\"', image, '\"}}]}') else '{\"@type\":\"Article\",\"image\":\"/own.png\"}' end"
    f = d.select("site", F.concat("site", F.lit("/"), "seq").alias("url"), "seq", F.array(F.expr(block)).alias("jsonld"))
    assets = d.select("site", F.col("image").alias("url"), F.when(F.col("dead"), 404).otherwise(200).alias("status")).distinct()
    found = response_rules.schema_image_findings(structured_data.schema_images(structured_data.jsonld_nodes(f)), assets)
    return found.select("site", "id", "detail")


@query("""
SELECT c_custkey AS k, 'unreachable' AS id, '' AS detail FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'nothing-crawlable', '' FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT c_custkey, 'truncated', (c_custkey % 10)::VARCHAR FROM customer WHERE c_custkey % 4 = 3 AND c_custkey % 10 > 0
""")
def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as site", "case c_custkey % 4 when 1 then 0 when 2 then 500 else 200 end as status", "c_custkey % 4 as kind")
    left = c.where("kind = 3").select("site", (F.col("site") % 10).alias("left"))
    return crawl.run_findings(c, c, c.where("kind = 0"), c, left).select(F.col("site").alias("k"), "id", "detail")


@query("""
SELECT c_custkey AS site, CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 15 END::BIGINT AS title_min, 150::BIGINT AS desc_max, 300::BIGINT AS min_words FROM customer
""")
def site_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey as site", "if(c_custkey % 3 = 0, 5, null) as title_min")
    limits = options.site_limits(sites, {"desc_max": 150})
    return limits.select("site", *(F.col(k).cast("long").alias(k) for k in ("title_min", "desc_max", "min_words")))


@query(CRAWL_SQL)
def page_rules_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_rules_all on a stream: what is there is worked off, appended to a folder, and read back."""
    path = f"{sf_dir}/documents.parquet"
    # as a pattern, so that the table may be a file or a folder
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    out = graph.scratch(spark, "page-findings")
    found = page_stream.page_findings(derived.crawl_of(feed))
    page_stream.write_findings(found, out, graph.scratch(spark, "page-findings-log"), once=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("seq", "level", "id")


@query()
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit of all hosts of the page table, as counts by site and rule."""
    found, _ = audit.audit({"responses": _pages(spark, sf_dir)}, F.lit("2026-01-01").cast("timestamp"))
    return findings.check_summary(found).select("site", "level", "id", "findings")
