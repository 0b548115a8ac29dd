"""Crawl tables derived from the given tables, for data that they don't hold themselves: whole tables, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Markup of the page of document n; every part depends on n by arithmetic alone.
MARKUP = """
concat('<!DOCTYPE html><html', if(n % 5 = 0, '', ' lang="en"'), '><head>',
  if(n % 7 = 0, '', '<meta charset="utf-8">'),
  '<title>', repeat('t', cast(n % 80 as int)), '</title>',
  '<meta name="description" content="', repeat('d', cast(n % 200 as int)), '">',
  if(n % 11 = 0, '<meta name="robots" content="noindex, nofollow">', if(n % 11 = 1, '<meta name=robots content=nofollow>', '')),
  case n % 6 when 0 then '' when 1 then '<meta name="viewport" content="width=600">'
    when 2 then '<meta name="viewport" content="width=device-width, user-scalable=no">'
    when 3 then '<meta name="viewport" content="width=device-width, maximum-scale=1.5">'
    else '<meta name="viewport" content="width=device-width, initial-scale=1">' end,
  case n % 8 when 0 then '' when 1 then '<link rel="canonical" href="/a"><link rel="canonical" href="/b">'
    when 2 then '<link rel="canonical" href="/elsewhere">' when 3 then concat('<link rel="canonical" href="./', n, '">') else concat('<link rel="canonical" href="', url, '">') end,
  case n % 9 when 0 then '' when 1 then '<meta property="og:title" content="x">'
    when 2 then '<meta property="og:title" content="x"><meta property="og:description" content="x"><meta property="og:image" content="/i.webp">'
    else '<meta property="og:title" content="x"><meta property="og:description" content="x"><meta property="og:image" content="https://cdn.example/i.png"><meta property="og:image:width" content="9">' end,
  if(n % 23 = 0, '<meta http-equiv="refresh" content="0; url=/next">', ''),
  case n % 12 when 0 then concat('<link rel="alternate" hreflang="en_GB" href="', url, '">') when 1 then '<link rel="alternate" hreflang="de" href="https://other.example/">'
    when 2 then concat('<link rel="alternate" hreflang="de-AT" href="../', substring_index(url, '/', -2), '">') else '' end,
  if(n % 14 = 0, '<script src="http://cdn.example/x.js"></script>', ''),
  case n % 10 when 0 then '<script type="application/ld+json">{bad</script>' when 1 then '<script type="application/ld+json">{"name":"x"}</script>'
    when 2 then '<script type="application/ld+json">{"@type":"Product","offers":{"@type":"Offer"}}</script>'
    when 3 then '<script type="application/ld+json">{"@graph":[{"@type":"Article"},{"@type":["Event","Recipe"],"name":"x","location":""}]}</script>' else '' end,
  '</head><body><nav><a href="/home" rel="nofollow">Home</a></nav><main>', repeat('<h1>Head</h1>', cast(n % 4 as int)),
  '<h2>Sub</h2>', if(n % 3 = 0, '<h4>Deep</h4>', '<h3>Next</h3>'),
  case n % 5 when 0 then '<img src="/i.png" width="1" height="1">' when 1 then '<img src="/i.png" alt="IMG_1234.jpg" width="1">'
    when 2 then '<img src="/i.svg" alt=" Photo " width="1" height="1">' when 3 then '<img src="/i.png" srcset="/i2.png 2x" alt="A cat" title="A cat" width=1 height=1><img alt="A cat"><img alt="a  cat">'
    else '<img src="/i.png" alt="" title="t" width="1" height="1" srcset="x">' end,
  if(n % 20 = 9, concat('<img src="/l.svg" alt="', repeat('long ', 30), '" width="1" height="1">'), ''), if(n % 499 = 3, repeat('<!-- pad -->', 90000), ''),
  if(n % 2 = 0, '<a href="/more">Read more</a>', ''), '<p>', repeat('word ', cast(n % 600 as int)), '</p></main></body></html>')
"""


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few bytes of a document make a whole page here, so rows are dealt before markup is made from them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return crawl_of(table(spark, sf_dir, "documents").select("doc_id", "source").repartition(tasks))


def crawl_of(documents: DataFrame) -> DataFrame:
    """A response for each document, which may also come as a stream: page n of the site of its source."""
    d = documents.select(F.col("doc_id").alias("n"), "source")
    d = d.withColumn("site", F.concat(F.lit("https://"), "source", F.lit(".example"))).withColumn("url", F.expr("concat(site, case n % 16 when 0 then '/Page' when 1 then '/a_b' when 2 then '/a%20b' else '/p' end, '/', n)"))
    headers = F.expr("""map_from_entries(filter(array(struct('content-type' as key, 'text/html' as value), if(n % 13 = 0, struct('x-robots-tag' as key, if(n % 2 = 0, 'all', 'noindex') as value), null),
        if(n % 2 = 0, struct('content-encoding' as key, 'gzip' as value), null)), x -> x is not null))""")
    status = F.expr("case when n % 17 = 0 then 301 when n % 19 = 0 then 404 else 200 end")
    return d.select("site", F.lit("GET").alias("method"), "url", F.col("n").alias("seq"), status.alias("status"), headers.alias("headers"), F.expr(MARKUP).alias("body"), F.lit("/moved").alias("location"), F.expr("cast(n % 10 * 100 + 50 as int)").alias("ms"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("fetched_at"))


def findings_snapshot(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """Findings derived from orders, one for each order of a customer's site; snapshot 1 leaves out some of 0 and has some more."""
    o = table(spark, sf_dir, "orders")
    kept = F.col("o_orderkey") % 5 != which
    return o.where(kept).select(
        F.concat(F.lit("https://c"), F.col("o_custkey") % 50, F.lit(".example")).alias("site"),
        F.concat(F.lit("https://c"), F.col("o_custkey") % 50, F.lit(".example/p/"), "o_orderkey").alias("url"),
        F.col("o_orderkey").alias("seq"),
        F.expr("element_at(array('error','warn','info'), cast(o_orderkey % 3 as int) + 1)").alias("level"),
        F.expr("element_at(array('noindex','title-short','slow','img-alt','og-webp','own-rule'), cast(o_orderkey % 6 as int) + 1)").alias("id"),
        F.lit("t").alias("title"),
        F.lit("").alias("detail"),
    )
