"""Options of sites: shared values that a site may override, and ignore rules that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.operators.page_rules import LIMITS

RULE = ["site", "id", "url_glob"]


def site_limits(sites: DataFrame, shared: dict | None = None) -> DataFrame:
    """(site, limits): the site's own value, else the shared one, else the default. sites: site and any limits."""
    values = {**LIMITS, **{k: v for k, v in (shared or {}).items() if v is not None}}
    unknown = set(values) - set(LIMITS)
    if unknown:
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    own = lambda k: F.coalesce(F.col(k), F.lit(values[k])) if k in sites.columns else F.lit(values[k])
    return sites.select("site", *(own(k).cast("int").alias(k) for k in LIMITS)).dropDuplicates(["site"])


def ignore_rules(own: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(site, id, url_glob): a site's rules, and the shared ones (id, url_glob) under a NULL site, which holds everywhere."""
    if shared is None:
        return own.select(*RULE).distinct()
    return own.select(*RULE).unionByName(shared.select(F.lit(None).cast("string").alias("site"), "id", "url_glob")).distinct()
