"""Which pages are looked at, options of sites, streams, and the audit of small sites from end to end."""

import datetime

import pytest
from pyspark.sql import functions as F

from gossamer.operators import crawl, graph, options, response_rules, site_files, structured_data
from gossamer.plans import audit
from gossamer.sources import responses
from gossamer.streaming import pages as page_stream

HTML = {"content-type": "text/html"}


def log(spark, *rows):
    """site, path, status, location, body."""
    data = [(s, "GET", s + p, i, st, {**HTML} if not p.endswith((".xml", ".txt")) else {}, b, loc, 10, None, datetime.datetime(2026, 1, 1)) for i, (s, p, st, loc, b) in enumerate(rows)]
    return spark.createDataFrame(data, responses.RESPONSES)


def page(*hrefs):
    return "<html lang=en><title>A title that is long enough</title><main>" + "".join(f'<a href="{h}">to {h}</a>' for h in hrefs) + "</main></html>"


def test_sitemap_choice_prefers_the_declared_one(spark):
    urlset = "<urlset><url><loc>{}</loc></url></urlset>"
    r = log(
        spark,
        ("https://a.test", "/one.xml", 404, None, ""),
        ("https://a.test", "/two.xml", 301, "https://a.test/three.xml", ""),
        ("https://a.test", "/three.xml", 200, None, urlset.format("https://a.test/x")),
        ("https://a.test", "/sitemap.xml", 200, None, urlset.format("https://a.test/no")),
        ("https://b.test", "/sitemap_index.xml", 200, None, "<sitemapindex><sitemap><loc>https://b.test/c1.xml</loc></sitemap><sitemap><loc>https://b.test/c2.xml</loc></sitemap></sitemapindex>"),
        ("https://b.test", "/c1.xml", 200, None, urlset.format("https://b.test/1")),
        ("https://b.test", "/c2.xml", 200, None, urlset.format("https://b.test/2")),
        ("https://c.test", "/sitemap.xml", 200, None, "<html>not a sitemap</html>"),
    )
    sites = r.select("site").distinct()
    robots = spark.createDataFrame([("https://a.test", "sitemap: https://a.test/one.xml\nSitemap: https://a.test/two.xml")], "site string, body string")
    chosen = crawl.chosen_sitemaps(crawl.sitemap_candidates(sites, robots), r)
    assert {(x["source"], x["url"]) for x in chosen.collect()} == {("https://a.test/two.xml", "https://a.test/two.xml"), ("https://b.test/sitemap_index.xml", "https://b.test/c1.xml"), ("https://b.test/sitemap_index.xml", "https://b.test/c2.xml")}
    given = spark.createDataFrame([("https://a.test", "https://a.test/sitemap.xml")], "site string, url string")
    only = crawl.chosen_sitemaps(crawl.sitemap_candidates(sites, robots, given), r).where("site = 'https://a.test'")
    assert [x["loc"] for x in site_files.sitemap_entries(only).collect()] == ["https://a.test/no"]


def reach(spark, budget=None):
    s = "https://a.test"
    links = spark.createDataFrame(
        [(s, f"{s}{a}", i, f"{s}{b}", "internal") for a, targets in {"/": ["/b", "/old", "/f.pdf", "/no/x"], "/b": ["/c", "/", "/away"], "/moved": ["/d#t", "/unknown"], "/no/x": ["/hidden"]}.items() for i, b in enumerate(targets)],
        "site string, src_url string, pos int, href string, kind string",
    )
    r = log(spark, *[(s, p, 200, None, "") for p in ("/", "/b", "/c", "/d", "/moved/", "/no/x", "/hidden", "/f.pdf")], (s, "/old", 302, f"{s}/moved/", ""), (s, "/away", 301, "https://z.test/", ""), ("https://z.test", "/", 200, None, ""))
    starts = links.select("site", F.regexp_replace("href", "#.*$", "").alias("url"))
    rules = site_files.robots_rules(spark.createDataFrame([(s, "User-agent: *\nDisallow: /no/")], "site string, body string"))
    verdicts = site_files.robots_verdicts(spark.createDataFrame([(s, "/no/x"), (s, "/b")], "site string, path string"), rules)
    edges = crawl.link_edges(links, graph.redirect_chains(starts, r), verdicts)
    seen, left = crawl.reachable(spark.createDataFrame([(s, f"{s}/")], "site string, url string"), edges, budget)
    return [x["url"].removeprefix(s) for x in seen.orderBy("depth", "trail").collect()], {x["site"]: x["left"] for x in left.collect()}


def test_reachable_follows_redirects_and_obeys_robots(spark):
    assert reach(spark) == (["/", "/b", "/moved/", "/c", "/d"], {})


@pytest.mark.parametrize(("budget", "seen", "left"), [(1, ["/"], 2), (2, ["/", "/b"], 2), (3, ["/", "/b", "/moved/"], 2), (4, ["/", "/b", "/moved/", "/c"], 1)])
def test_page_budget(spark, budget, seen, left):
    assert reach(spark, budget) == (seen, {"https://a.test": left})


def test_host_variants(spark):
    sites = spark.createDataFrame([("https://www.a.test:81",), ("http://127.0.0.1:9",), ("https://local",)], "site string")
    got = {(x["site"], x["url"]) for x in response_rules.host_variants(sites).collect()}
    assert got == {("https://www.a.test:81", u) for u in ("http://a.test:81/", "https://www.a.test:81/", "http://www.a.test:81/")} | {("http://127.0.0.1:9", "http://127.0.0.1:9/"), ("https://local", "http://local/")}


def test_schema_images(spark):
    blocks = ['{"@type":"A","image":["https://x.test/1.png",{"url":"https://x.test/2.png"},"/rel.png",7]}', '{"@graph":[{"@type":"B","logo":{"@type":"ImageObject","url":"https://x.test/3.png","contentUrl":"https://x.test/4.png"}}]}', "{bad", '{"@type":"A","image":null}']
    f = spark.createDataFrame([("s", "u", 1, blocks)], "site string, url string, seq long, jsonld array<string>")
    got = structured_data.schema_images(structured_data.jsonld_nodes(f))
    assert {x["target"][-5:-4] for x in got.collect()} == {"1", "2", "3", "4"}
    assets = spark.createDataFrame([("s", "https://x.test/2.png", 410), ("s", "https://x.test/1.png", 403)], "site string, url string, status int")
    assert [(x["id"], x["detail"]) for x in response_rules.schema_image_findings(got, assets).collect()] == [("schema-image-broken", "1")]


def test_site_options(spark):
    sites = spark.createDataFrame([("a", 5), ("b", None)], "site string, title_min int")
    got = {r["site"]: (r["title_min"], r["title_max"], r["desc_min"]) for r in options.site_limits(sites, {"title_min": 9, "title_max": 50}).collect()}
    assert got == {"a": (5, 50, 70), "b": (9, 50, 70)}
    with pytest.raises(ValueError, match="unknown limits"):
        options.site_limits(sites, {"titel_min": 9})
    own = spark.createDataFrame([("a", "slow", None)], "site string, id string, url_glob string")
    shared = spark.createDataFrame([("noindex", "/x/*")], "id string, url_glob string")
    assert {tuple(r) for r in options.ignore_rules(own, shared).collect()} == {("a", "slow", None), (None, "noindex", "/x/*")}


def test_sweep_reports_what_it_leaves(spark):
    t = spark.createDataFrame([("s", f"u{i}", i) for i in range(5)], "site string, url string, first_seq long")
    kept, more = response_rules.sweep(t, 2, "link-sweep-capped")
    assert sorted(r["url"] for r in kept.collect()) == ["u0", "u1"] and [(r["id"], r["detail"]) for r in more.collect()] == [("link-sweep-capped", "3")]
    kept, more = response_rules.sweep(t, None, "link-sweep-capped")
    assert kept.count() == 5 and more.count() == 0


def test_rules_on_a_stream(spark, tmp_path):
    r = log(spark, ("https://a.test", "/", 200, None, page("/b")), ("https://a.test", "/b", 404, None, ""), ("https://a.test", "/b", 404, None, ""))
    r.write.parquet(str(tmp_path / "in"))
    feed = page_stream.read_responses(spark, str(tmp_path / "in"))
    page_stream.write_findings(page_stream.latest_findings(feed), str(tmp_path / "out"), str(tmp_path / "log"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("id = 'page-status'").count() == 1 and got.where("id = 'desc-missing'").count() == 1
    windows = page_stream.answers_by_window(feed)
    query = windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(x["answered"], x["failed"]) for x in spark.table("windows").collect()] == [(1, 2)]


def test_audit_end_to_end(spark):
    a, b, c, d = (f"https://{x}.test" for x in "abcd")
    sitemap = "<urlset>" + "".join(f"<url><loc>{a}{p}</loc></url>" for p in ("/", "/about/", "/hidden/")) + "</urlset>"
    r = log(
        spark,
        (a, "/robots.txt", 200, None, f"User-agent: *\nSitemap: {a}/map.xml"),
        (a, "/map.xml", 200, None, sitemap),
        (a, "/", 200, None, page("/about/", "/gone", "/extra")),
        (a, "/about/", 200, None, page("/")),
        (a, "/hidden/", 200, None, "<meta name=robots content=noindex>" + page("/")),
        (a, "/gone", 404, None, ""),
        (a, "/extra", 200, None, page("/")),
        (b, "/", 302, f"{b}/home", ""),
        (b, "/home", 200, None, page("/next")),
        (b, "/next", 500, None, ""),
        (c, "/", 0, None, None),
        (d, "/", 500, None, ""),
    )
    rules = spark.createDataFrame([(a, "llms-missing", None)], "site string, id string, url_glob string")
    found, runs = audit.audit({"responses": r, "ignore_rules": rules}, F.lit("2026-02-01").cast("timestamp"))
    got = {}
    for x in found.collect():
        got.setdefault(x["site"], set()).add((x["id"], x["url"].removeprefix(x["site"])))
    assert {("broken-link", "/gone"), ("missing-from-sitemap", "/extra"), ("noindex", "/hidden/"), ("sitemap-lastmod-missing", ""), ("sitemap-not-indexable", ""), ("duplicate-title", "/"), ("orphan-page", "/hidden/")} <= got[a]
    ids = {k: {i for i, _ in v} for k, v in got.items()}
    assert not {"no-sitemap", "robots-missing", "llms-missing", "title-missing", "unreachable"} & ids[a]
    assert ("page-status", "/next") in got[b] and {"no-sitemap", "robots-missing", "llms-missing"} <= ids[b] and "nothing-crawlable" not in ids[b]
    assert ids[c] == {"unreachable"}
    assert "nothing-crawlable" in ids[d] and "unreachable" not in ids[d]
    summary = {x["site"]: (x["pages"], x["ignored"]) for x in runs.collect()}
    assert summary[a] == (3, 1) and summary[b][0] == 1


def test_audit_with_side_tables(spark):
    a = "https://a.test"
    r = log(
        spark,
        (a, "/", 200, None, page("/p", "/gone1", "/gone2", "https://z.test/dead")),
        (a, "/p", 200, None, page("/")),
        (a, "/gone1", 404, None, ""),
        (a, "/gone2", 404, None, ""),
        (a, "/probe", 200, None, page("/")),
        (a, "/old", 200, None, page("/")),
    )
    dead = spark.createDataFrame([(a, "GET", "https://z.test/dead", 99, 410, HTML, "", None, 10, None, datetime.datetime(2026, 1, 1))], responses.RESPONSES)
    side = {
        "responses": r.unionByName(dead),
        "probes": spark.createDataFrame([(a, f"{a}/probe")], "site string, url string"),
        "certificates": spark.createDataFrame([("a.test", datetime.datetime(2026, 2, 5))], "host string, not_after timestamp"),
        "expect_rules": spark.createDataFrame([(a, 1, "/p", "Article")], "site string, rule_no int, url_glob string, type string"),
        "psi_payloads": spark.createDataFrame([(a, a, "mobile", None, "timeout")], "site string, url string, strategy string, payload string, error string"),
        "redirect_map": spark.createDataFrame([(a, 1, "/old /p 301"), (a, 2, "/x* /p"), (a, 3, "/old2 /p")], "site string, line_no int, line string"),
        "site_limits": spark.createDataFrame([(a, 1)], "site string, min_words int"),
    }
    found, _ = audit.audit(side, F.lit("2026-02-01").cast("timestamp"), page_budget=2, include_external=True, caps={"link-sweep-capped": 1, "redirect-map-capped": 1})
    got = {(x["id"], x["detail"]) for x in found.collect()}
    ids = {i for i, _ in got}
    assert {"soft-404", "tls-expiring", "schema-expected", "psi-failed", "redirect-not-applied", "redirect-pattern-skipped", "external-broken", "truncated"} <= ids
    assert {("link-sweep-capped", "1"), ("redirect-map-capped", "1")} <= got and "thin-content" not in ids
