"""A registry of rules: named functions from the tables of an audit to findings.

    rules = Rules()

    @rules.rule("own-footer")
    def footer(tables):                      # DataFrames in, a DataFrame of findings out
        return tables["features"].where(...).select("site", "url", "seq", F.lit("warn").alias("level"), ...)

    @rules.page_rule("own-title", columns=["title"])
    def title(page):                         # plain Python, for each page: (level, title, detail) of each finding
        if page["title"] and page["title"].isupper():
            yield "info", "The title shouts", page["title"]

    findings, failures = rules.run(tables)

A Python rule runs as an Arrow table function over batches of the columns it names, where pages are: nothing is shuffled.

Rules are checked and isolated. A rule must give the columns of findings in their types and a known level, and no id but its own (or one that begins with
it and a dash). Each is written by itself, so one that can't be planned, breaks the schema or fails while it runs is a row of
failures (rule, error) and the others are not affected. A Python rule that fails on a page is a failure with the number of pages; its other pages count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.operators import findings as found
from gossamer.operators import graph

#: Columns of a rule's findings, and one that may be left out.
SCHEMA = {"site": "string", "url": "string", "seq": "bigint", "level": "string", "id": "string", "title": "string", "detail": "string"}
OPTIONAL = {"evidence": "string"}
FAILURES = "rule string, error string"
FAILED = "!failed"


class Rules:
    def __init__(self):
        self.rules: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}

    def add(self, name: str, f: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        if not name or name in self.rules:
            raise ValueError(f"a rule needs a name of its own: {name!r}")
        self.rules[name] = f

    def rule(self, name: str):
        """Register a function from tables to findings."""

        def add(f):
            self.add(name, f)
            return f

        return add

    def page_rule(self, name: str, columns: list[str], table: str = "features"):
        """Register a generator of (level, title, detail) over pages, each a dict of these columns and url."""

        def add(f):
            self.add(name, lambda tables: run_python(tables[table], name, columns, f))
            return f

        return add

    def run(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(findings, failures) of all rules over tables."""
        spark, parts, failures = next(iter(tables.values())).sparkSession, [], []
        for name, f in self.rules.items():
            try:
                kept = graph.kept(checked(f(tables), name), "rule")
                wrong = kept.where(f"level not in {tuple(found.LEVELS)} and level <> '{FAILED}'").select("level").limit(1).collect()
                if wrong:
                    raise ValueError(f"not a level: {wrong[0][0]}")
            except Exception as e:  # whatever a rule does must not keep the others from running
                failures.append((name, _message(e)))
                continue
            parts.append(kept.where(F.col("level") != FAILED))
            broken = kept.where(F.col("level") == FAILED).agg(F.count("*").alias("n"), F.min("detail").alias("error")).first()
            if broken["n"]:
                failures.append((name, f"{broken['n']} pages: {broken['error']}"))
        none = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in {**SCHEMA, **OPTIONAL}.items()))
        return reduce(DataFrame.unionByName, parts, none), spark.createDataFrame(failures, FAILURES)


def _message(e: Exception) -> str:
    text = e.getMessage() if isinstance(e, PySparkException) and e.getMessage() else str(e)
    return f"{type(e).__name__}: {text}".splitlines()[0][:500]


def checked(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of findings alone, whose ids are checked where they are read."""
    have = dict(df.dtypes)
    for column, kind in SCHEMA.items():
        if column not in have:
            raise ValueError(f"no column {column}")
        if have[column] != kind and not (column == "seq" and have[column] == "int"):
            raise ValueError(f"column {column} is {have[column]}, not {kind}")
    own = (F.col("id") == name) | F.startswith("id", F.lit(name + "-"))
    guarded = F.when(F.coalesce(own, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not an id of this rule: "), F.coalesce("id", F.lit("NULL")))))
    rest = [F.col(c).cast(k).alias(c) for c, k in SCHEMA.items() if c != "id"]
    return df.select(*rest, guarded.alias("id"), F.col("evidence").cast("string") if "evidence" in have else F.lit(None).cast("string").alias("evidence"))


def run_python(pages: DataFrame, name: str, columns: list[str], f: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """Findings of a Python rule: an Arrow table function over batches of pages. A page on which it fails is a row of level FAILED."""
    keys = ["site", "url", "seq"]

    class PageRule:
        def eval(self, batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in SCHEMA}
            for page in batch.to_pylist(maps_as_pydicts="lossy"):
                try:
                    rows = [(level, title, None if detail is None else str(detail)) for level, title, detail in f(page) or ()]
                except Exception as e:  # one page's failure isn't another's
                    rows = [(FAILED, "", f"{type(e).__name__}: {e}"[:500])]
                for level, title, detail in rows:
                    for c, v in zip(SCHEMA, (page["site"], page["url"], page["seq"], level, name, title, detail or ""), strict=True):
                        out[c].append(v)
            kinds = {"string": pa.string(), "bigint": pa.int64()}
            yield pa.table([pa.array(out[c], kinds[k]) for c, k in SCHEMA.items()], names=list(SCHEMA))

    run = F.arrow_udtf(PageRule, returnType=", ".join(f"{c} {k}" for c, k in SCHEMA.items()))
    given = pages.select(*keys[:2], F.col("seq").cast("long").alias("seq"), *(c for c in columns if c not in keys))
    return run(given.asTable())


def describe(spark: SparkSession, rules: Rules) -> DataFrame:
    """(rule): what is registered."""
    return spark.createDataFrame([(n,) for n in rules.rules], "rule string")
