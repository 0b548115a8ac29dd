"""Own rules: findings of DataFrame rules and of Python rules, and failures that stay where they happen."""

import pytest
from pyspark.sql import functions as F

from gossamer.rules.registry import Rules

from .test_audit import HEAD, crawl


def row(tables, **kw):
    values = {"level": "warn", "id": "own", "title": "t", "detail": "d", **kw}
    return tables["features"].select("site", "url", "seq", *(F.lit(v).alias(k) for k, v in values.items()))


@pytest.fixture
def tables(spark):
    from gossamer.operators import features

    return {"features": features.page_features(crawl(spark, HEAD, "<title>SHOUT</title>", "<title></title>"))}


def test_rules_and_failures(spark, tables):
    rules = Rules()
    rules.rule("own")(lambda t: row(t).where("seq < 2").withColumn("evidence", F.lit("e")))
    rules.rule("many")(lambda t: row(t, id="many-a").unionByName(row(t, id="many-b")))
    rules.rule("raises")(lambda t: 1 / 0)
    rules.rule("unknown-column")(lambda t: row(t, id="unknown-column").where("nothing = 1"))
    rules.rule("no-detail")(lambda t: row(t, id="no-detail").drop("detail"))
    rules.rule("wrong-type")(lambda t: row(t, id="wrong-type", detail=1))
    rules.rule("wrong-level")(lambda t: row(t, id="wrong-level", level="fatal"))
    rules.rule("other-id")(lambda t: row(t, id="noindex"))
    rules.rule("fails-late")(lambda t: row(t, id="fails-late").withColumn("seq", F.expr("cast(concat('x', url) as bigint)")))

    @rules.page_rule("shout", columns=["title", "h1"])
    def shout(page):
        if page["title"] and page["title"].isupper():
            yield "info", "The title shouts", page["title"]
            yield "warn", "Again", None

    @rules.page_rule("breaks", columns=["title"])
    def breaks(page):
        return [("info", "first letter", page["title"][0])]

    found, failed = rules.run(tables)
    got = sorted((r.id, r.seq, r.level, r.detail, r.evidence) for r in found.collect())
    assert got == sorted(
        [("own", k, "warn", "d", "e") for k in (0, 1)]
        + [(f"many-{x}", k, "warn", "d", None) for x in "ab" for k in range(3)]
        + [("shout", 1, "info", "SHOUT", None), ("shout", 1, "warn", "", None), ("breaks", 0, "info", "A", None), ("breaks", 1, "info", "S", None)]
    )
    errors = {r.rule: r.error for r in failed.collect()}
    assert set(errors) == {"raises", "unknown-column", "no-detail", "wrong-type", "wrong-level", "other-id", "fails-late", "breaks"}
    assert errors["raises"].startswith("ZeroDivisionError") and errors["breaks"].startswith("1 pages: IndexError") and "no column detail" in errors["no-detail"]


def test_names_and_plans(spark, tables):
    rules = Rules()
    rules.rule("a")(lambda t: row(t, id="a"))
    with pytest.raises(ValueError, match="name"):
        rules.rule("a")(lambda t: row(t))
    assert Rules().run(tables)[0].count() == 0
    from gossamer.rules.registry import run_python

    plan = run_python(tables["features"], "x", ["title"], lambda page: ())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" in plan


def test_audit_runs_them_and_leaves_only_what_it_returns(spark):
    import os

    from gossamer.operators import graph
    from gossamer.plans import audit

    rules = Rules()
    rules.rule("own")(lambda t: row(t).where("seq = 0"))
    rules.rule("raises")(lambda t: t["nothing"])
    ignored = spark.createDataFrame([("https://a.test", "thin-content", None)], "site string, id string, url_glob string")
    log = crawl(spark, HEAD + '<a href="/p1">x</a>', HEAD).withColumn("url", F.replace("url", F.lit("/p0"), F.lit("/")))
    root = os.path.dirname(graph.scratch(spark, "x"))
    before = set(os.listdir(root))
    found, runs = audit.audit({"responses": log, "ignore_rules": ignored}, F.lit("2026-01-01").cast("timestamp"), rules=rules)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == set(audit.KEPT)
    rows = found.select("id", "level").collect()
    ids = [r.id for r in rows]
    assert ids.count("own") == 1 and "thin-content" not in ids and ("rule-failed", "error") in {tuple(r) for r in rows}
    assert runs.first()["pages"] == 2
