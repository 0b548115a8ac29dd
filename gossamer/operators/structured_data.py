"""JSON-LD: nodes at any depth, required properties, expected types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.operators import graph, pattern_index

# Properties that a rich result of a type needs
REQUIRED = {
    "Article": ["headline"],
    "BlogPosting": ["headline"],
    "BreadcrumbList": ["itemListElement"],
    "Event": ["location", "name", "startDate"],
    "FAQPage": ["mainEntity"],
    "LocalBusiness": ["address", "name"],
    "NewsArticle": ["headline"],
    "Organization": ["name"],
    "Recipe": ["image", "name"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
}
# Properties that hold addresses of images
IMAGE_KEYS = ["contentUrl", "image", "logo", "thumbnailUrl"]
PRODUCT_NAME, PRODUCT_ONE_OF = "name", ["aggregateRating", "offers", "review"]


def repeated_keys(spark) -> None:
    """From now on the session reads JSON objects that repeat a key as browsers do: the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def jsonld_nodes(features: DataFrame) -> DataFrame:
    """(site, url, seq, block, path, types, keys, node): every typed node that isn't a mere reference.

    All pages descend a level in each round, until none has objects or lists below; each level is a table of its own.
    """
    repeated_keys(features.sparkSession)
    blocks = features.select("site", "url", "seq", F.posexplode("jsonld").alias("block", "raw")).select("site", "url", "seq", "block", F.lit("$").alias("path"), F.try_parse_json(F.trim("raw")).alias("node"))
    inner = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")
    level = graph.kept(blocks.where("node is not null"), "jsonld")
    walk = level
    while True:
        # an array lists values by place, an object by key
        parts = level.select("site", "url", "seq", "block", "path", F.explode(_parts()).alias("key", "value"))
        level = graph.kept(parts.where(F.col("value").isNotNull() & inner).select("site", "url", "seq", "block", F.concat_ws("/", "path", "key").alias("path"), F.col("value").alias("node")), "jsonld")
        if level.isEmpty():
            break
        walk = walk.unionByName(level)
    kind = F.schema_of_variant("node")
    members = F.map_keys(F.try_variant_get("node", "$", "map<string,variant>"))
    types = F.coalesce(F.try_variant_get("node", "$['@type']", "array<string>"), F.array(F.try_variant_get("node", "$['@type']", "string")))
    typed = walk.where(kind.startswith("OBJECT<")).withColumn("keys", members).withColumn("types", F.filter(types, lambda t: t.isNotNull()))
    return typed.where((F.size("types") > 0) & ~(F.array_contains("keys", "@id") & (F.size("keys") <= 2))).select("site", "url", "seq", "block", "path", "types", "keys", "node")


def _parts():
    """A map of the members of an object, or of the items of a list by their place."""
    members = F.try_variant_get("node", F.lit("$"), "map<string,variant>")
    items = F.try_variant_get("node", F.lit("$"), "array<variant>")
    places = F.transform(F.sequence(F.lit(1), F.size(items)), lambda k: (k - 1).cast("string"))
    return F.coalesce(members, F.when(F.size(items) > 0, F.map_from_arrays(places, items)))


def incomplete_nodes(nodes: DataFrame) -> DataFrame:
    """schema-incomplete: one row for each page, its distinct shortfalls joined."""
    spark = nodes.sparkSession
    needs = spark.createDataFrame([(t, p) for t, ps in REQUIRED.items() for p in ps] + [("Product", PRODUCT_NAME)], "type string, property string")
    value = F.try_variant_get("node", F.lit("$"), "map<string,variant>")
    full = nodes.withColumn("present", F.filter(F.map_entries(value), lambda e: ~F.coalesce(F.to_json(e["value"]).isin("null", '""', "[]"), F.lit(True))))
    full = full.select("site", "url", "seq", F.explode("types").alias("type"), F.transform("present", lambda e: e["key"]).alias("present"))
    short = full.join(F.broadcast(needs), "type").where(~F.array_contains("present", F.col("property"))).select("site", "url", "seq", F.concat_ws(".", "type", "property").alias("what"))
    shown = F.arrays_overlap("present", F.array(*map(F.lit, PRODUCT_ONE_OF)))
    bare = full.where((F.col("type") == "Product") & ~shown).select("site", "url", "seq", F.lit("Product." + "|".join(PRODUCT_ONE_OF)).alias("what"))
    g = short.unionByName(bare).groupBy("site", "url", "seq").agg(F.array_join(F.array_sort(F.collect_set("what")), ", ").alias("detail"))
    return g.select("site", "url", "seq", F.lit("warn").alias("level"), F.lit("schema-incomplete").alias("id"), F.lit("Structured data lacks properties").alias("title"), "detail")


def missing_types(features: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """schema-expected: pages on a glob (rules: site, url_glob, type) without the type."""
    pages = features.select("site", "url", "seq", urls.path(F.col("url")).alias("path"))
    want = pattern_index.matches(pages, rules.select("site", "type", "url_glob").distinct(), ["site"], "url_glob", end=True)
    have = nodes.select("site", "url", F.explode("types").alias("type")).distinct()
    gone = want.select("site", "url", "seq", "type").distinct().join(have.hint("merge"), ["site", "url", "type"], "left_anti")
    declared = have.groupBy("site", "url").agg(F.array_join(F.slice(F.array_sort(F.collect_set("type")), 1, 10), ", ").alias("declared"))  # the types of one page
    gone = gone.join(declared.hint("merge"), ["site", "url"], "left")
    detail = F.concat(F.col("type"), F.lit("; has "), F.coalesce("declared", F.lit("none")))
    return gone.select("site", "url", "seq", F.lit("error").alias("level"), F.lit("schema-expected").alias("id"), F.lit("Expected structured data is missing").alias("title"), detail.alias("detail"))


def schema_images(nodes: DataFrame) -> DataFrame:
    """(site, url, seq, target): absolute addresses of images that nodes name, as text, as objects with a url, or as lists of these."""
    one = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.url", "string"))
    named = F.array(*(F.try_variant_get("node", f"$.{k}", "variant") for k in IMAGE_KEYS))
    values = nodes.select("site", "url", "seq", F.explode(named).alias("v")).where("v is not null")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return values.select("site", "url", "seq", F.explode(items).alias("v")).select("site", "url", "seq", one(F.col("v")).alias("target")).where(F.col("target").rlike("(?i)^https?:")).distinct()
