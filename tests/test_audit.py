"""Rules, joins and iterative operators on small tables: each rule has a case that fires and one that doesn't."""

import pytest
from pyspark.sql import functions as F

from gossamer.functions import text, urls
from gossamer.operators import cross_rules, features, findings, graph, page_rules, response_rules, sampling, site_files, structured_data
from gossamer.sources import responses

HEAD = '<meta charset=utf-8><meta name=viewport content="width=device-width"><title>A title that is long enough</title>'


def crawl(spark, *bodies, status=200, headers=None):
    rows = [("https://a.test", "GET", f"https://a.test/p{i}", i, status, headers or {"content-type": "text/html"}, b, None, 10, None, None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, responses.RESPONSES)


def ids(spark, body, **kw):
    r = crawl(spark, body, **kw)
    return [x["id"] for x in page_rules.page_findings(r, features.page_features(r)).collect()]


@pytest.mark.parametrize(
    ("tag", "name", "value"),
    [('<img alt="x">', "alt", "x"), ("<img alt='y'>", "alt", "y"), ("<img alt=z>", "alt", "z"), ("<img alt>", "alt", ""), ("<img>", "alt", None), ('<img data-src="x">', "src", None), ('<img :src="x">', "src", None), ('<a title="Tea &amp; &lt;b">', "title", "Tea & <b")],
)
def test_attribute(spark, tag, name, value):
    assert spark.createDataFrame([(tag,)], "t string").select(text.attribute(F.col("t"), name)).first()[0] == value


def test_lengths_and_words(spark):
    d = spark.createDataFrame([("a😀", "one two — 3", "日本語のテキスト です")], "u string, w string, j string")
    assert tuple(d.select(text.units(F.col("u")), text.words(F.col("w")), text.words(F.col("j"))).first()) == (3, 3, 5)


@pytest.mark.parametrize(
    ("ref", "want"),
    [("/x", "https://a.test/x"), ("../x", "https://a.test/x"), ("y", "https://a.test/d/y"), ("?q", "https://a.test/d/p?q"), ("//h.test/z", "https://h.test/z"), ("HTTPS://Ex.com:443", "https://ex.com/"), ("/für", "https://a.test/f%C3%BCr")],
)
def test_resolve(spark, ref, want):
    d = spark.createDataFrame([("https://a.test/d/p", ref)], "b string, r string")
    assert d.select(urls.resolve(F.col("b"), F.col("r"))).first()[0] == want


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        (" ../../../x ", "https://a.test/x"), ("..", "https://a.test/"), ("./%2E%2e/é?ü=a b#c d", "https://a.test/%C3%A9?%C3%BC=a%20b#c%20d"), ("#f", "https://a.test/d/p?k=1#f"), ("", "https://a.test/d/p?k=1"),
        ("https://bücher.test/", "https://xn--bcher-kva.test/"), ("http:\\\\b.test\\c", "http://b.test/c"), ("http://U:p@B.test:8080", "http://U:p@b.test:8080/"), ("mailto:x@y", "mailto:x@y"), ("/a😀b", "https://a.test/a%F0%9F%98%80b"), (None, None),
    ],
)
def test_resolve_hard(spark, ref, want):
    d = spark.createDataFrame([("https://a.test/d/p?k=1#frag", ref)], "b string, r string")
    out = d.select(urls.resolve(F.col("b"), F.col("r")).alias("o"))
    assert out.first()[0] == want and "Python" not in out._jdf.queryExecution().toString()


def test_relative_canonical_and_alternates(spark):
    """A page that names itself by a relative address is its own canonical page and alternate."""
    r = crawl(spark, f'<html lang=en>{HEAD}<link rel=canonical href="/p0"><link rel=alternate hreflang=en href="./p0"><link rel=alternate hreflang=de href="//a.test/p1">', '<html lang=de><link rel=canonical href="gone"><link rel=alternate hreflang=de href="../p1"><link rel=alternate hreflang=en href="p0">')
    f = features.page_features(r)
    got = {(x["seq"], x["id"]) for x in page_rules.page_findings(r, f).collect()}
    assert not got & {(0, "canonical-other"), (0, "hreflang-no-self"), (1, "hreflang-no-self"), (0, "canonical-missing")} and (1, "canonical-other") in got
    assert [(x["url"][-1], x["reason"]) for x in findings.not_indexable(r, f).collect()] == [("1", "canonical-other")]
    assert cross_rules.one_way_alternates(f).count() == 0
    log = spark.createDataFrame([("https://a.test", "https://a.test/gone", 404, False, None)], "site string, url string, status int, noindex boolean, canonical string")
    assert [(x["id"], x["detail"]) for x in response_rules.canonical_findings(f, log).collect()] == [("canonical-dead", "https://a.test/gone")]


def test_structured_data_with_repeated_keys_and_depth(spark):
    deep = '{"@type":"Event","x":' * 40 + "1" + "}" * 40
    r = crawl(spark, '<script type="application/ld+json">{"@type":"Article","@type":"Recipe","name":"n"}</script>', f'<script type="application/ld+json">[{deep}]</script>', '<script type="application/ld+json">{"a":</script>')
    f = features.page_features(r)
    got = [(x["seq"], x["id"]) for x in page_rules.page_findings(r, f).collect()]
    assert (0, "jsonld-invalid") not in got and (2, "jsonld-invalid") in got
    nodes = structured_data.jsonld_nodes(f).collect()
    assert [x["types"] for x in nodes if x["seq"] == 0] == [["Recipe"]] and sum(x["seq"] == 1 for x in nodes) == 40


def test_links_of_a_page_once_each(spark):
    r = crawl(spark, '<a href="/x" rel="nofollow">1</a><main><a href="./x">2</a><a href="https://b.test">3</a></main><a href="/x">4</a>')
    got = {x["href"]: (x["pos"], x["in_main"], x["nofollow"], x["kind"]) for x in features.page_links(r).collect()}
    assert got == {"https://a.test/x": (0, True, True, "internal"), "https://b.test/": (1, True, False, "external")}
    assert "Exchange" not in features.page_links(r)._jdf.queryExecution().toString()


def test_page_rules(spark):
    good = f'<html lang=en><head>{HEAD}<link rel=canonical href="https://a.test/p0"></head><body><h1>H</h1><h2>h</h2><img src=a.png width=1 height=1 srcset=x alt="A cat"></body></html>'
    got = ids(spark, good)
    for rule in ("title-missing", "title-short", "h1-missing", "viewport-missing", "canonical-missing", "lang-missing", "charset-missing", "img-alt", "heading-skip", "noindex"):
        assert rule not in got
    assert {"desc-missing", "thin-content", "og-missing"} <= set(got)
    bad = ids(spark, '<meta name=robots content="index"><h1>a</h1><h4>b</h4><img src=x>', headers={"content-type": "text/html", "x-robots-tag": "noindex, nofollow"})
    assert {"x-robots-noindex", "robots-conflict", "nofollow-page", "title-missing", "heading-skip", "img-alt", "img-dimensions", "charset-missing"} <= set(bad)
    assert ids(spark, "x" * 6000, headers={"content-type": "text/html", "server": "s"}).count("uncompressed") == 1
    assert ids(spark, "", status=302) == ["sitemap-redirect"] and ids(spark, "", status=500) == ["page-status"]


def test_code_is_not_markup(spark):
    r = crawl(spark, """<div data-code="<img src=x>"></div><script>var a = '<a href="/no">n</a>'</script><a href="/yes#f">y</a><a href="#z">z</a>""")
    f = features.page_features(r).first()
    assert f["images"] == []
    assert [x["href"] for x in features.page_links(r).collect()] == ["https://a.test/yes#f"]


def test_anchor_names(spark):
    r = crawl(spark, '<a href="/1">Text</a><a href="/2"><img alt="Alt"></a><a href="/3" aria-label="Lab"></a><a href="/4"><svg><title>Svg</title></svg></a><a href="/5"></a><a href="/p0">self</a>')
    assert [x["name"] for x in features.page_anchors(r).orderBy("pos").collect()] == ["Text", "Alt", "Lab", "Svg", ""]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/ok\nDisallow: /*.pdf$\nAllow: /t\nDisallow: /t\nUser-agent: googlebot\nDisallow:\nDisallow: /g # c\n"
    rules = site_files.robots_rules(spark.createDataFrame([("s", body)], "site string, body string"))
    paths = spark.createDataFrame([("s", p) for p in ("/x/1", "/x/ok/2", "/a.pdf", "/a.pdfx", "/t", "/g", "/y")], "site string, path string")
    star = {r["path"]: r["allowed"] for r in site_files.robots_verdicts(paths, rules, "nobody").collect()}
    assert star == {"/x/1": False, "/x/ok/2": True, "/a.pdf": False, "/a.pdfx": True, "/t": True, "/g": True, "/y": True}
    own = {r["path"]: r["allowed"] for r in site_files.robots_verdicts(paths, rules).collect()}
    assert own["/g"] is False and own["/x/1"] is True


def test_redirect_map(spark):
    lines = [("s", 1, "# comment"), ("s", 2, "/a /b 301!"), ("s", 3, "/c"), ("s", 4, "/d 302")]
    got = [tuple(r)[2:] for r in site_files.redirect_rules(spark.createDataFrame(lines, "site string, line_no int, line string")).orderBy("line_no").collect()]
    assert got == [("/a", "/b", 301), ("/c", None, None), ("/d", None, 302)]


def test_corridor_depth_and_route(spark):
    links = spark.createDataFrame([("s", i, i + 1, i) for i in range(5)], "site string, src int, dst int, ord int")
    homes = spark.createDataFrame([("s", 0)], "site string, k int")
    depths = graph.click_depth(links, homes)
    got = {r["k"]: (r["depth"], r["via"]) for r in depths.collect()}
    assert got[5] == (5, 4) and got[0] == (0, None) and len(got) == 6
    assert graph.routes(depths, spark.createDataFrame([("s", 5), ("s", 9)], "site string, k int")).first()["route"] == [0, 1, 2, 3, 4, 5]


def test_ignore_rules_by_site_and_shared(spark, monkeypatch):
    rows = [(s, f"https://{s}/{p}", 1, "warn", i, "", "") for s in ("a", "b") for p in ("x", "y") for i in ("slow", "noindex")]
    table = spark.createDataFrame(rows, findings.SCHEMA)
    rules = spark.createDataFrame([(None, "slow", "/x"), ("a", "noindex", None), ("a", "slow", "/x"), ("b", "other", None)], "site string, id string, url_glob string")
    gone = {("a", "x", "slow"), ("b", "x", "slow"), ("a", "x", "noindex"), ("a", "y", "noindex")}
    for sent in (10_000, 0):
        monkeypatch.setattr(findings, "SENT_RULES", sent)
        silent = [(r["site"], r["url"][-1], r["id"]) for r in findings.apply_ignores(table, rules, "left_semi").collect()]
        assert sorted(silent) == sorted(gone)
        assert {(r["site"], r["url"][-1], r["id"]) for r in findings.apply_ignores(table, rules).collect()} == {(s, u[-1], i) for s, u, _, _, i, _, _ in rows} - gone


def test_long_corridor_has_no_bound(spark):
    links = spark.createDataFrame([("s", i, i + 1, 0) for i in range(60)], "site string, src int, dst int, ord int")
    homes = spark.createDataFrame([("s", 0)], "site string, k int")
    assert graph.click_depth(links, homes).agg(F.max("depth")).first()[0] == 60
    assert graph.click_depth(links, homes, 7).agg(F.max("depth")).first()[0] == 7


def test_chains_prefer_get_and_the_latest(spark):
    log = spark.createDataFrame([("s", "a", "HEAD", 404, None, 9), ("s", "a", "GET", 301, "b", 1), ("s", "b", "GET", 200, None, 1), ("s", "b", "GET", 410, None, 2)], "site string, url string, method string, status int, location string, seq int")
    got = graph.redirect_chains(spark.createDataFrame([("s", "a"), ("s", "z")], "site string, url string"), log).collect()
    assert {r["start"]: (r["final_url"], r["final_status"], len(r["hops"])) for r in got} == {"a": ("b", 410, 2), "z": ("z", None, 1)}


def test_sample_and_globs(spark):
    d = spark.range(30).withColumn("g", F.lit(1))
    assert [r["id"] for r in sampling.spread_sample(d, 3, ["g"], ["id"]).orderBy("id").collect()] == [0, 10, 20]
    for glob, path, want in (("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a/**", "/a/b/c", True), ("/a.b", "/aXb", False)):
        assert spark.createDataFrame([(glob, path)], "g string, p string").select(F.rlike("p", urls.glob_pattern(F.col("g")))).first()[0] is want


def test_every_rule_has_a_category(spark):
    r = crawl(spark, "<p>x")
    got = findings.categorized(page_rules.page_findings(r, features.page_features(r)))
    assert got.where("category = 'Other'").count() == 0


def test_findings_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"site": "s", "findings": [{"url": "u", "seq": 1, "level": "warn", "id": "slow", "title": "t", "detail": ""}]}')
    assert findings.read_findings(spark, str(tmp_path / "a.json")).first()["id"] == "slow"
    (tmp_path / "c.json").write_text('{"site": "s",\n "findings": [{"url": "u",\n "id": "slow"}]}')
    assert findings.read_findings(spark, str(tmp_path / "c.json"), whole_files=True).first()["id"] == "slow"
    rows = [(f"s{i % 3}", f"u{i}", i, "warn", "slow", 'a "title"', "x\ny") for i in range(500)]
    table = spark.createDataFrame(rows, findings.SCHEMA)
    for kind in ("json", "parquet"):
        findings.write_findings(table, str(tmp_path / kind), kind, "2026-01-01")
    again = findings.read_findings(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, again.select(table.columns).collect())) == sorted(rows)
    assert spark.read.text(str(tmp_path / "json")).count() <= 3 * findings.DOCUMENTS
    assert {r["change"] for r in findings.diff(again, table).collect()} == {"unchanged"}
    (tmp_path / "d.json").write_text("not json")
    with pytest.raises(ValueError, match="not a findings"):
        findings.read_findings(spark, str(tmp_path / "d.json"))
    (tmp_path / "b.json").write_text('{"site": "s"}')
    with pytest.raises(ValueError, match="not a findings"):
        findings.read_findings(spark, str(tmp_path / "b.json"))


def test_tag_maps_equal_single_reads(spark):
    """One pass over a tag gives what a search for each attribute gives, on odd tags too."""
    import random

    rnd = random.Random(1)
    parts = """alt="a"|alt='b'|alt=c|alt|ALT = "d &amp; e"|data-alt="f"|:alt="g"|[alt]='h'|title='say alt="k" now'|title="the alt of it"|title="alt=x"|x_alt=1|alt=""|src="/a.png?alt=1"|src|/|alt="i|alt=|alt\n=\n"j"|é|\"""".split("|")
    tags = ["<img " + " ".join(rnd.sample(parts, rnd.randrange(0, 5))) + rnd.choice([">", " >", "/>"]) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in tags], "t string").withColumn("m", F.expr(text.attributes("t", ("alt", "src", "title"))))
    for name in ("alt", "src", "title"):
        rows = d.select("t", text.read(F.col("m"), name).alias("a"), text.attribute(F.col("t"), name).alias("b")).collect()
        assert [r for r in rows if r.a != r.b] == []


def test_counts_within_a_page_take_time_in_proportion(spark):
    """A page with thousands of images and links, many of them alike."""
    import time

    images = "".join(f'<img src="/i{k}.png" alt="Picture of {k % 900}" width=1 height=1>' for k in range(2000)) + '<picture><source srcset="/i7.png 2x"></picture>'
    anchors = "".join(f'<a href="/p{k % 9000}" rel={"nofollow" if k % 9000 == 1 else "x"}>t</a>' for k in range(16000))
    r = crawl(spark, f"{HEAD}<nav>{anchors}</nav><main>{images}<a href=/p5>5</a></main>")
    f = features.page_features(r)
    start = time.time()
    found = page_rules.page_findings(r, f).collect()
    assert time.time() - start < 12  # most of it compiles the plan
    assert sum(x["id"] == "img-alt-duplicate" for x in found) == 200
    assert [x["detail"] for x in found if x["id"] == "internal-nofollow"] == ["https://a.test/p1"]
    assert next(x["detail"] for x in found if x["id"] == "img-srcset") == "1999"
    links = features.page_links(r)
    start = time.time()
    rows = links.collect()
    assert time.time() - start < 12
    assert len(rows) == 9000 and [x["href"] for x in rows if x["in_main"]] == ["https://a.test/p5"] and [x["pos"] for x in rows if x["nofollow"]] == [1]


@pytest.mark.parametrize(
    ("body", "fires"),
    [
        ('<main><a href="https://a.test/p0#respond" rel=nofollow>x</a><a href="p0#c" rel=nofollow>x</a></main>', set()),
        ('<main><a href="/elsewhere/#section" rel="noopener nofollow">x</a></main>', {"internal-nofollow"}),
        ('<main><a href="//a.test/x">x</a></main>', set()),
        ('<main><a href="sms:+123">x</a><a href="//other.test/a.test">x</a></main>', {"no-editorial-links"}),
        ('<main><a href="sms:+123" rel=nofollow>x</a><a href="/y">y</a></main>', set()),
        ('<main><a href="https://other.test/" rel=nofollow>x</a><a href="/a" rel=nofollowing>y</a></main>', set()),
    ],
)
def test_links_are_judged_where_they_lead(spark, body, fires):
    assert {x for x in ids(spark, HEAD + body) if x in ("internal-nofollow", "no-editorial-links")} == fires
