"""Paths against many patterns with wildcards: the literal beginning of a pattern is an equi key, so a path meets few patterns.

A pattern's key is what stands before its first wildcard, KEY characters of it at most. Keys have so few lengths that these are known to all: a path
brings its beginnings of these lengths, and meets the patterns that have them as keys. Only where more than the key is to be
compared is a regular expression tried, and only on those pairs. Rows are in proportion to paths and matches, not to paths times patterns.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import graph

#: Characters of a key; and so, with 0, the lengths that keys can have are KEY + 1 at most.
KEY = 48
#: Patterns, and characters of them, that are sent to all executors; more meet the paths by a shuffle.
SENT, SENT_CHARS = 100_000, 16_000_000


def indexed(patterns: DataFrame, pattern: str = "pattern", end: bool = False) -> DataFrame:
    """patterns with _key, _regex and _plain: whether a path that begins with the key (or, anchored, is the key) matches.

    end=True: a pattern matches whole paths, `*` stops at a slash and `**` doesn't. Otherwise it matches beginnings of paths, `*` is anything and
    a `$` at its end is the path's end.
    """
    p = F.col(pattern)
    anchored = F.lit(True) if end else p.endswith("$")
    body = p if end else F.regexp_replace(p, r"\$$", "")
    if end:
        regex = urls.glob_pattern(p)
    else:
        literal = F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1")
        regex = F.concat(F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))
    head = F.substring_index(body, "*", 1)
    only = (F.length(head) == F.length(body)) & ~anchored & (F.length(head) <= KEY)
    return patterns.withColumns({"_key": F.substring(head, 1, KEY), "_plain": only, "_regex": regex})


def matches(paths: DataFrame, patterns: DataFrame, by: list[str], pattern: str = "pattern", end: bool = False, path: str = "path", how: str = "inner") -> DataFrame:
    """Rows of paths with the columns of each pattern that matches; `by` are columns of both that must be equal too. how="left": a path that nothing matches stays, too."""
    index = indexed(patterns, pattern, end)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(pattern)), F.lit(0)).alias("chars"), F.collect_set(F.length("_key")).alias("lengths")).first()
    small = size["n"] <= SENT and size["chars"] <= SENT_CHARS
    if not small:
        index = graph.kept(index, "patterns")
    keyed = paths.withColumn("_start", F.explode_outer(_beginnings(F.col(path), sorted(size["lengths"]))))
    index = index.select(*(F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in index.columns))
    same = [F.col(c) == F.col(f"_by_{c}") for c in by] + [F.col("_start") == F.col("_key"), F.when(F.col("_plain"), True).otherwise(F.rlike(path, F.col("_regex")))]
    met = keyed.join(index.hint("broadcast" if small else "merge"), functools.reduce(operator.and_, same), how)
    return met.select(*paths.columns, *(c for c in patterns.columns if c not in by))


def _beginnings(path: Column, lengths: list[int]) -> Column:
    given = F.array(*map(F.lit, lengths)) if lengths else F.expr("cast(array() as array<int>)")
    return F.transform(F.filter(given, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def best(paths: DataFrame, patterns: DataFrame, by: list[str], value: Column, order: Column, pattern: str = "pattern", end: bool = False) -> DataFrame:
    """(by, path, best): of the distinct paths, the value of the matching pattern that comes last by `order`; NULL where none matches.

    Paths are dealt once, to be distinct; all that a path meets is then where it is.
    """
    return matches(paths.select(*by, "path").distinct(), patterns, by, pattern, end, how="left").groupBy(*by, "path").agg(F.max_by(value, order).alias("best"))
