"""Findings on stored performance payloads: one JSON document for each measured page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Good and poor thresholds of the two laboratory metrics, and the score's levels
METRICS = {"psi-lcp": ("largest-contentful-paint", 2500.0, 4000.0), "psi-cls": ("cumulative-layout-shift", 0.1, 0.25)}
FIELDS = {"psi-field-lcp": "LARGEST_CONTENTFUL_PAINT_MS", "psi-field-cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE", "psi-field-inp": "INTERACTION_TO_NEXT_PAINT"}
SAVINGS_MS = 250


def performance_findings(payloads: DataFrame, strategy: str | None = None) -> DataFrame:
    """payloads: site, url, payload (JSON), error; and strategy (mobile, desktop), of which one is judged if asked for. A payload without one is mobile."""
    if strategy is not None and "strategy" in payloads.columns:
        payloads = payloads.where(F.coalesce("strategy", F.lit("mobile")) == strategy)
    v = F.try_parse_json("payload")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    score = F.floor(get("$.lighthouseResult.categories.performance.score", "double") * 100 + 0.5)

    def row(ok, level, rule, detail):
        return F.when(ok, F.struct(level.alias("level"), rule.alias("id"), detail.cast("string").alias("detail")))

    rows = [row(score < 90, F.when(score < 50, "error").otherwise("warn"), F.lit("psi-score"), score)]
    for rule, (audit, good, poor) in METRICS.items():
        value = get(f"$.lighthouseResult.audits['{audit}'].numericValue", "double")
        rows.append(row(value > good, F.when(value > poor, "error").otherwise("warn"), F.lit(rule), value))
    slow = [get(f"$.loadingExperience.metrics.{name}.category", "string") for name in FIELDS.values()]
    rows += [row(c == "SLOW", F.lit("error"), F.lit(rule), c) for rule, c in zip(FIELDS, slow, strict=True)]
    rows.append(row(get("$.loadingExperience.metrics", "variant").isNull(), F.lit("info"), F.lit("psi-no-field-data"), F.lit("")))
    ok = payloads.where("error is null")
    found = ok.select("site", "url", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select("site", "url", "f.*")
    audits = F.from_json(get("$.lighthouseResult.audits", "string"), "map<string,struct<details:struct<overallSavingsMs:double>>>")
    saved = ok.select("site", "url", F.explode(audits).alias("audit", "a")).where(F.col("a.details.overallSavingsMs") >= SAVINGS_MS)
    found = found.unionByName(saved.select("site", "url", F.lit("warn").alias("level"), F.lit("psi-opportunity").alias("id"), F.col("audit").alias("detail")))
    failed = payloads.where("error is not null").select("site", "url", F.lit("info").alias("level"), F.lit("psi-failed").alias("id"), F.col("error").alias("detail"))
    return found.unionByName(failed).select("site", "url", F.lit(None).cast("long").alias("seq"), "level", "id", F.lit("Performance").alias("title"), "detail")
