"""Patterns by their literal beginning against plain matching of every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gossamer.operators import pattern_index, site_files


def plain(pattern, path, end):
    if end:
        regex = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", pattern)) + r"\Z"
    else:
        body = pattern[:-1] if pattern.endswith("$") else pattern
        regex = ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if pattern.endswith("$") else "")
    return re.match(regex, path, re.S) is not None


@pytest.mark.parametrize(("end", "sent"), [(False, 100), (True, 100), (False, 0), (True, 0)])
def test_every_pair(spark, monkeypatch, end, sent):
    monkeypatch.setattr(pattern_index, "SENT", sent)
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice(["/", "a", "b", ".", "+", "(", "x" * 30]) for _ in range(rnd.randrange(n)))
    paths = [(rnd.choice("st"), "/" + text(8)) for _ in range(150)] + [("s", ""), ("u", "/a"), ("s", "/a$b")]
    patterns = sorted({(rnd.choice("st"), rnd.choice(["", "/", "*", "/a", "**/"]) + text(4) + rnd.choice(["", "*", "**", "$", "*b", "*$"]) + text(2)) for _ in range(60)})
    got = pattern_index.matches(spark.createDataFrame(paths, "site string, path string"), spark.createDataFrame(patterns, "site string, pattern string"), ["site"], end=end)
    expected = [(s, p, q) for s, p in paths for t, q in patterns if s == t and plain(q, p, end)]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 40


def test_rows_in_proportion(spark):
    """10,000 rules and 200,000 paths of one site: no regular expression for any pair that the beginning rules out, and no shuffle but that of distinct paths."""
    rules = spark.range(10_000).selectExpr("'s' as site", "0 as group_no", "'*' as agent", "id % 2 = 0 as allow", "concat('/d', id, '/*.x') as path")
    paths = spark.range(200_000).selectExpr("'s' as site", "concat('/d', id % 20000, '/', id, if(id % 3 = 0, '.x', '.y')) as path")
    keyed = paths.withColumn("k", F.explode(pattern_index._beginnings(F.col("path"), [4, 5, 6, 7])))
    assert keyed.count() <= 4 * 200_000
    v = site_files.robots_verdicts(paths, rules)
    assert v.where("not allowed").count() == sum(1 for i in range(200_000) if i % 3 == 0 and i % 20000 < 10_000 and i % 2)


def test_no_patterns_and_nulls(spark):
    p = spark.createDataFrame([("s", "/a"), ("s", None), (None, "/b")], "site string, path string")
    none = spark.createDataFrame([], "site string, pattern string")
    assert pattern_index.matches(p, none, ["site"]).count() == 0
    assert pattern_index.best(p, none, ["site"], F.col("pattern"), F.col("pattern")).count() == 3
