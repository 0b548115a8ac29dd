"""Sinks by site and rules on feeds."""

import random

from pyspark.sql import functions as F

from gossamer.operators import cross_rules, features, findings, graph, page_rules
from gossamer.sources import responses
from gossamer.streaming import settling, sites

from .test_audit import HEAD


def log(spark, rows):
    full = [(s, "GET", f"{s}{p}", k, 200, {"content-type": "text/html"}, body, None, 10, None, None) for k, (s, p, body) in enumerate(rows)]
    return spark.createDataFrame(full, responses.RESPONSES)


def test_sites_replace_only_themselves(spark, tmp_path):
    rows = lambda site, n: spark.createDataFrame([(site, f"u{k}", k, "warn", "slow", "t", "d") for k in range(n)], findings.SCHEMA)
    runs = lambda *s: spark.createDataFrame([(x, 7) for x in s], "site string, pages long")
    for kind in ("parquet", "json"):
        path = str(tmp_path / kind)
        findings.write_findings(rows("a", 3).unionByName(rows("b", 2)), path, kind, "1", runs("a", "b"))
        findings.write_findings(rows("b", 5), path, kind, "2", runs("b"))
        findings.write_findings(rows("c", 0), path, kind, "3", runs("c"))
        count = lambda: {r.site: r.n for r in findings.read_findings(spark, path, kind=kind).groupBy("site").agg(F.count("*").alias("n")).collect()}  # noqa: E731, B023
        assert count() == {"a": 3, "b": 5}
        findings.write_findings(rows("a", 0), path, kind, "4", runs("a"))
        assert count() == {"b": 5}
    told = {r.site: (r.date, r.meta["pages"]) for r in findings.read_runs(spark, str(tmp_path / "json")).collect()}
    assert told == {"a": ("4", 7), "b": ("2", 7), "c": ("3", 7)}


def test_latest_without_moving_bodies(spark, tmp_path):
    rnd = random.Random(1)
    rows = [("s", rnd.choice(["GET", "HEAD", None]), f"u{rnd.randrange(40)}", k, 200, None, f"b{k}", None, 1, None, rnd.choice([None, "2026-01-01", "2026-01-02"])) for k in range(300)]
    table = spark.createDataFrame(rows, responses.RESPONSES.replace("fetched_at timestamp", "fetched_at string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    table.repartition(3).write.parquet(str(tmp_path / "log"))
    late = responses.read_latest(spark, str(tmp_path / "log"))
    assert sorted(r.body for r in late.collect()) == sorted(r.body for r in responses.latest(table).collect())
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_a_feed_ends_with_the_findings_of_the_table(spark, tmp_path):
    rows = [("https://a.test", "/", HEAD + '<a href="/1">x</a>'), ("https://a.test", "/1", HEAD), ("https://b.test", "/", "<p>"), ("https://b.test", "/1", HEAD), ("https://c.test", "/", HEAD), ("https://a.test", "/2", HEAD), ("https://c.test", "/1", "<title>y</title>")]

    def judge(r):
        f = features.page_features(r)
        links = features.page_links(r)
        homes = r.select("site", F.concat("site", F.lit("/")).alias("url")).distinct()
        cross = cross_rules.duplicates(f, "title", "duplicate-title").unionByName(cross_rules.orphans(f, links, homes))
        return page_rules.page_findings(r, f).unionByName(cross, allowMissingColumns=True).drop("evidence"), r.groupBy("site").agg(F.count("*").alias("pages"))

    whole = log(spark, rows)
    seen = []
    for k, (a, b) in enumerate(((0, 3), (3, 4), (4, 7))):
        whole.where(F.col("seq").between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(responses.RESPONSES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        spy = lambda r: (seen.append(sorted(x.site for x in r.select("site").distinct().collect())), judge(r))[1]
        sites.judge_changed_sites(feed, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state"), judge=spy, once=True).awaitTermination()
    key = ["site", "url", "seq", "level", "id", "detail"]
    got = sorted(map(str, findings.read_findings(spark, str(tmp_path / "out"), kind="parquet").select(key).collect()))
    assert got == sorted(map(str, judge(whole)[0].select(key).collect()))
    # a site without news isn't judged again
    assert seen == [["https://a.test", "https://b.test"], ["https://b.test"], ["https://a.test", "https://c.test"]]


def test_settling_on_a_feed_equals_the_table(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"u{rnd.randrange(12)}", k, f"2026-01-01 {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}", rnd.choice("ab")) for k in range(0, 9000, 53)]
    table = spark.createDataFrame(rows, "url string, seq long, t string, fingerprint string").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")
    # three files; rows of each lie in any order, and some come a file late but within the delay
    dealt = table.withColumn("part", F.least(F.lit(2), F.floor((F.col("seq") + F.when(F.col("seq") % 7 == 0, 300).otherwise(0)) / 3000)).cast("int"))
    for k in range(3):
        dealt.where(F.col("part") == k).drop("part").orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", 10**9, "x")], "url string, seq long, fingerprint string").withColumn("fetched_at", F.lit("2027-01-01").cast("timestamp"))
    end.select("url", "seq", "fingerprint", "fetched_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = settling.settled(feed).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, r.settled_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    expected = sorted((r.url, r.settled_at) for r in graph.settled(table, "url", "fetched_at", "fingerprint").collect())
    assert got == expected and len(got) > 8
