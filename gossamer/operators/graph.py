"""Iterative operators over all sites at once: click depth and redirect chains; and settling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_HOPS = 5


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir. Only where driver and executors are one process, an own one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for open_ in _scopes:
        open_.paths.append((name, path))
    return path


_scopes: list[scope] = []


class scope:  # noqa: N801
    """With it, tables written to the shared folder are deleted at the end, but for those of the names to keep; after an exception, all."""

    def __init__(self, spark: SparkSession, keep: tuple[str, ...] = ()):
        self.spark, self.keep, self.paths = spark, keep, []

    def __enter__(self) -> scope:
        _scopes.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scopes.remove(self)
        for name, path in self.paths:
            if kind is not None or name not in self.keep:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few short columns that are sent to all executors.
SENT = 100_000


def few(df: DataFrame, rows: int = SENT) -> DataFrame:
    """df for a join: sent to all executors if it is counted to have so few rows, else shuffled, with the other side, for a merge."""
    return df.hint("broadcast" if df.limit(rows + 1).count() <= rows else "merge")


#: Rows of a few short columns that one task sorts or joins.
TASK_ROWS = 1_000_000


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks to deal so many rows to, so that a task's share doesn't grow with the table; no fewer than a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def kept(df: DataFrame, name: str = "table", path: str | None = None, by: str | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read from it: computed once, read by column, without lineage. by: a column with few values, of which a filter reads only its own."""
    path = path or scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A table that grows by levels, bucketed by its keys into as many buckets as a shuffle has partitions.

    What is bucketed alike meets without a shuffle, and a join with other rows shuffles those alone. The catalogue knows the table only
    while it grows; its files lie in the shared folder. ordered=True, for a table of one level: buckets are sorted by the keys, and a merge
    join takes them as they are.
    """

    ORDERING = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, name: str, keys: list[str], ordered: bool = False):
        self.spark, self.keys, self.depth, self.ordered = spark, keys, -1, ordered
        self.before = spark.conf.get(self.ORDERING)
        if ordered:
            spark.conf.set(self.ORDERING, "true")
        self.path = scratch(spark, name)
        self.name = "gossamer_" + self.path.rsplit("/", 1)[-1].replace("-", "_")

    def append(self, df: DataFrame) -> DataFrame:
        """Write rows as the next level, and read them."""
        self.depth += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("depth", F.lit(self.depth)).write.mode("append").format("parquet").partitionBy("depth").bucketBy(n, *self.keys)
        dealt = dealt.sortBy(*self.keys) if self.ordered else dealt
        dealt.option("path", self.path).saveAsTable(self.name)
        return self.read().where(F.col("depth") == self.depth)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """All rows, read by path; the catalogue forgets the table."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.conf.set(self.ORDERING, self.before)
        return self.spark.read.schema(schema).parquet(self.path)


def click_depth(links: DataFrame, homes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(site, k, depth, via): length of the shortest path of links from home, breadth first, and the page before on it.

    links: site, src, dst, and ord, which breaks ties of the predecessor; homes: site, k. A round extends all
    sites by a level, until no site has a new page; its level is one more folder of the table of pages seen. Links and pages seen
    are bucketed alike, so a round shuffles what it finds and nothing else. Once the pages found are many beside the links left, links that
    were followed or lead to pages seen are dropped: what all rounds read is in proportion to the links, not to links times rounds.
    """
    spark, key = links.sparkSession, dict(links.dtypes)["src"]
    seen = Buckets(spark, "levels", ["site", "k"])
    edges = _edges(spark, links.where("src <> dst").groupBy("site", "src", "dst").agg(F.min("ord").alias("ord")))
    try:
        frontier = seen.append(homes.select("site", "k", F.lit(None).cast(key).alias("via")).dropDuplicates(["site", "k"]))
        left, found, since = edges.read().count(), 0, 0
        while (n := frontier.count()) and (max_depth is None or seen.depth < max_depth):
            found += n
            if left > TASK_ROWS and found > left / 3:
                edges, old = _edges(spark, _unfollowed(edges.read(), seen.read().where(F.col("depth") >= since), seen.depth)), edges
                old.close()
                left, found, since = edges.read().count(), 0, seen.depth + 1
            frontier = seen.append(next_level(frontier, edges.read(), seen.read().where(F.col("depth") >= since)))
    finally:
        edges.close()
        levels = seen.close()
    return levels.select("site", "k", "depth", "via")


def _edges(spark: SparkSession, rows: DataFrame) -> Buckets:
    out = Buckets(spark, "edges", ["site", "src"], ordered=True)
    out.append(rows.select("site", "src", "dst", "ord").repartition("site", "src"))
    return out


def _unfollowed(edges: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """Edges but for those from pages seen above `depth`, which were followed, and those to pages seen, which lead to nothing new."""
    rest = edges.join(seen.where(F.col("depth") < depth).select("site", F.col("k").alias("src")).hint("merge"), ["site", "src"], "left_anti")
    return rest.join(seen.select("site", F.col("k").alias("dst")).hint("merge"), ["site", "dst"], "left_anti")


def next_level(frontier: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(site, k, via) of pages that the frontier links to and that weren't seen. Only the rows that links make of the frontier are shuffled."""
    step = frontier.select("site", F.col("k").alias("src")).join(edges.select("site", "src", "dst", "ord").hint("merge"), ["site", "src"])
    step = step.groupBy("site", F.col("dst").alias("k")).agg(F.min_by("src", F.struct("ord", "src")).alias("via"))
    return step.join(seen.select("site", "k").hint("merge"), ["site", "k"], "left_anti").select("site", "k", "via")


def routes(depths: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, k, route) of pages (site, k): the keys on the way from home.

    Level by level: first up, which pages are on any way; then down, where a page's route is its predecessor's and itself. So a page is
    met once each way, however many pages lie behind it.
    """
    asked = kept(depths.select("site", "k", "depth").join(pages.select("site", "k").hint("merge"), ["site", "k"], "left_semi"), "asked", by="depth")
    deepest = asked.agg(F.max("depth")).first()[0]
    ways, above = [], None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        wanted = asked.where(F.col("depth") == d).select("site", "k", F.lit(True).alias("asked"))
        if above is not None:
            wanted = wanted.unionByName(above.select("site", F.col("via").alias("k"), F.lit(False).alias("asked")))
        wanted = wanted.groupBy("site", "k").agg(F.max("asked").alias("asked"))
        above = kept(depths.where(F.col("depth") == d).select("site", "k", "via").join(wanted.hint("merge"), ["site", "k"]), "ways")
        ways.insert(0, above)
    out = pages.select("site", "k", F.array("k").alias("route")).limit(0)
    down = None
    for d, way in enumerate(ways):
        if d == 0:
            down = way.select("site", "k", "asked", F.array("k").alias("route"))
        else:
            before = down.select("site", F.col("k").alias("via"), "route")
            down = kept(way.join(before.hint("merge"), ["site", "via"]).select("site", "k", "asked", F.concat("route", F.array("k")).alias("route")), "routes")
        out = out.unionByName(down.where("asked").select("site", "k", "route"))
    return out


def _one_answer(responses: DataFrame) -> DataFrame:
    """(site, url, status, location): of several responses to an address that to GET, then the latest."""
    have = set(responses.columns)
    order = [F.coalesce(F.col("method") == "GET", F.lit(False))] if "method" in have else []
    order += [F.col(c) for c in ("fetched_at", "seq") if c in have]
    order += [-F.col("status").cast("int"), F.coalesce("location", F.lit(""))]
    one = responses.groupBy("site", "url").agg(F.max_by(F.struct(F.col("status").cast("int").alias("status"), "location"), F.struct(*order)).alias("r"))
    return one.select("site", "url", "r.status", "r.location")


def redirect_chains(starts: DataFrame, responses: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(site, start, hops, final_url, final_status) following locations, `hops` at most. starts: site, url; responses: site, url, status, location.

    An address without a response ends its chain with a NULL status: not judged. When the hops run out, the address last
    asked is final. Chains that have ended take no part in the rounds that follow.
    """
    log = kept(_one_answer(responses), "answers")
    going = starts.select("site", F.col("url").alias("start"), "url", F.expr("cast(array() as array<struct<url:string,status:int>>)").alias("hops")).distinct()
    ended = []
    for k in range(hops):
        j = going.join(log.hint("merge"), ["site", "url"], "left")
        j = j.select("site", "start", "url", F.concat("hops", F.array(F.struct(F.col("url").alias("url"), F.col("status").alias("status")))).alias("hops"), "status", "location")
        j = kept(j.withColumn("moved", F.coalesce(F.col("status").between(300, 399) & F.col("location").isNotNull() & F.lit(k < hops - 1), F.lit(False))), "chains")
        ended.append(j.where("not moved").select("site", "start", "hops", F.col("url").alias("final_url"), F.col("status").alias("final_status")))
        going = j.where("moved").select("site", "start", F.col("location").alias("url"), "hops")
        if k < hops - 1 and going.isEmpty():
            break
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def settled(observations: DataFrame, key: str = "url", order: str = "ts", fingerprint: str = "fingerprint", times: int = 3) -> DataFrame:
    """(key, settled_at): when a fingerprint was first seen `times` in a row."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.col(fingerprint) != F.lag(fingerprint).over(w)).cast("int"), F.lit(0))
    runs = observations.withColumn("run", changed).withColumn("island", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = runs.withColumn("nth", F.row_number().over(Window.partitionBy(key, "island").orderBy(order)))
    return nth.where(F.col("nth") == times).groupBy(key).agg(F.min(order).alias("settled_at"))
