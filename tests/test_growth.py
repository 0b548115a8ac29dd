"""What a query's tasks hold and how often it reads its input, as the input grows."""

from pyspark.sql import functions as F

import __spark_entry__
from gossamer.operators import graph, response_rules

SF = "/root/testdata/sf0.01"

def largest_share(df) -> float:
    """The part of df's rows that its largest partition has."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)

def test_tasks_follow_the_rows(spark):
    assert [graph.tasks(spark, n, 10) for n in (0, 40, 41, 1000)] == [4, 4, 5, 100]

def test_pages_of_site_probes_are_dealt(spark, monkeypatch):
    """Customers are one row group of one file; their pages and answers aren't one task."""
    given, whole = [], response_rules.trailing_slash_findings
    monkeypatch.setattr(response_rules, "trailing_slash_findings", lambda *tables: given.extend(tables) or whole(*tables))
    __spark_entry__.queries()["site_probes"](spark, SF)
    assert [largest_share(df) < 0.5 for df in given] == [True, True]


def test_routes_and_depths_of_many_levels(spark, monkeypatch):
    """Links that were followed are dropped on the way, and a page on many ways is met once each way; results are those of the whole graph."""
    rows = [("s", f"p{k}", f"p{k + 1}", k) for k in range(12)] + [("s", "p0", "q1", 50), ("s", "q1", "p3", 51), ("s", "p5", "p1", 52)] + [("t", "p0", "p1", 0)]
    links = spark.createDataFrame(rows, "site string, src string, dst string, ord long")
    homes = spark.createDataFrame([("s", "p0"), ("t", "p0")], "site string, k string")
    dropped, whole = [], graph._unfollowed
    monkeypatch.setattr(graph, "_unfollowed", lambda *a: dropped.append(a[2]) or whole(*a))
    monkeypatch.setattr(graph, "TASK_ROWS", 2)
    depths = graph.click_depth(links, homes)
    got = {(r.site, r.k): (r.depth, r.via) for r in depths.collect()}
    expected = {("s", "p0"): (0, None), ("s", "p1"): (1, "p0"), ("s", "q1"): (1, "p0"), ("s", "p2"): (2, "p1"), ("s", "p3"): (2, "q1"), ("t", "p0"): (0, None), ("t", "p1"): (1, "p0")}
    assert got == expected | {("s", f"p{k}"): (k - 1, f"p{k - 1}") for k in range(4, 13)} and len(dropped) > 1
    written, keep = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, *a, **b: written.append(out := keep(df, *a, **b)) or out)
    asked = depths.where("depth > 3").select("site", "k")
    routes = {r.k: r.route for r in graph.routes(depths, asked).collect()}
    assert routes == {f"p{k}": ["p0", "q1", *(f"p{i}" for i in range(3, k + 1))] for k in range(5, 13)}
    # 11 levels, each met up and down
    assert sum(df.count() for df in written) <= 3 * 12


def scans(df, name: str) -> int:
    """How often a plan reads the table of a name."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_links_and_sweep_of_broken_links_are_computed_once(spark):
    assert scans(__spark_entry__.queries()["broken_links"](spark, SF), "l_orderkey") == 0


def test_links_of_a_crawl_meet_targets_once(spark):
    """Redirects, files and robots are told of each target, before links meet targets."""
    from gossamer.operators import crawl

    links = spark.createDataFrame([("https://s", "internal", "https://s/a", k, f"https://s/b{k}#x") for k in range(4)], "site string, kind string, src_url string, pos int, href string")
    chains = spark.createDataFrame([("https://s", f"https://s/b{k}", f"https://s/b{k}/", 200 if k else None) for k in range(4)], "site string, start string, final_url string, final_status int")
    verdicts = spark.createDataFrame([("https://s", "/b1", False), ("https://s", "/b2", True)], "site string, path string, allowed boolean")
    edges = crawl.link_edges(links, chains, verdicts)
    assert sorted((r.src, r.dst, r.pos, r.url) for r in edges.collect()) == [("https://s/a", f"https://s/b{k}", k, f"https://s/b{k}/") for k in (2, 3)]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_sites_of_site_files_are_dealt(spark, monkeypatch):
    from gossamer.operators import site_files

    given, whole = [], site_files.robots_findings
    monkeypatch.setattr(site_files, "robots_findings", lambda *tables: given.extend(tables[:3]) or whole(*tables))
    __spark_entry__.queries()["site_files_rules"](spark, SF)
    assert [largest_share(df) < 0.5 for df in given] == [True] * 3
