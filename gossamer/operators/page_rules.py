"""Rules on single pages: one projection that yields all findings of a page, and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.functions.text import collapsed, first, let, trimmed, units
from gossamer.operators import structured_data

#: Limits that a site may override: see site_limits.
LIMITS = {"title_min": 15, "title_max": 60, "desc_min": 70, "desc_max": 160, "min_words": 300, "max_ms": 800, "max_click_depth": 4}
COMPRESSIBLE, HUGE, ALT_MAX, ALT_DUPLICATES = 5 * 1024, 1024 * 1024, 125, 3

# What an alt text says when nobody wrote one
ALT_FILENAME = r"(?i)\.(jpe?g|png|gif|webp|svg|avif)$"
ALT_SERIAL = r"(?i)^(img|dsc|dscn|pxl|photo|image|screenshot|untitled)[-_ ]?\d+$"
ALT_PLACEHOLDER = ["alt", "alt text", "banner", "graphic", "icon", "image", "image of", "img", "logo", "no alt", "none", "photo", "photo of", "picture", "placeholder", "spacer", "thumbnail", "untitled"]
LANGUAGE_TAG = r"(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|\d{3}))?$"

FINDING = "struct<level:string,id:string,title:string,detail:string>"


def finding(level: str, rule: str, title: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(rule).alias("id"), F.lit(title).alias("title"), (F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def _if(condition: Column, level: str, rule: str, title: str, detail: Column | str = "") -> Column:
    return F.array(F.when(condition, finding(level, rule, title, detail)))


def _each(items: Column, level: str, rule: str, title: str, detail=lambda x: x.cast("string")) -> Column:
    return F.transform(items, lambda x: finding(level, rule, title, detail(x)))


def _viewport() -> Column:
    """Directives of the viewport; later ones win."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce("viewport", F.lit(""))), "[;,]"), trimmed), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("k"), trimmed(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(F.filter(pairs, lambda p: p["k"] == n), F.lit(-1))["v"]))


def _image_rules() -> list[Column]:
    img = F.col("pictured")
    hidden = lambda x: F.coalesce(x["role"].isin("presentation", "none"), F.lit(False))
    alt = lambda x: x["plain_alt"]
    named = lambda x: (alt(x).rlike(ALT_FILENAME)) | alt(x).rlike(ALT_SERIAL)
    blank = lambda x: alt(x).isin(ALT_PLACEHOLDER)
    count = lambda f: F.size(F.filter(img, f))
    rule = lambda f, level, rule, title: _if(count(f) > 0, level, rule, title, count(f))
    fine = F.filter(img, lambda x: (alt(x) != "") & ~named(x) & ~blank(x))
    # equal alt texts are neighbours once sorted: one that stands so many places on, too, is met so often
    alike = lambda alts: F.array_distinct(F.filter(alts, lambda a, i: F.get(alts, i + ALT_DUPLICATES - 1) == a))
    repeated = let(F.array_sort(F.transform(fine, alt)), alike)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return [
        rule(lambda x: x["alt"].isNull() & ~hidden(x) & ~x["alt_bound"], "error", "img-alt", "Images lack an alt attribute"),
        rule(lambda x: (alt(x) != "") & named(x), "warn", "img-alt-filename", "Alt texts are file names"),
        rule(lambda x: blank(x), "warn", "img-alt-placeholder", "Alt texts are placeholders"),
        _each(repeated, "info", "img-alt-duplicate", "Several images share an alt text"),
        rule(lambda x: has(x["title"]) & has(x["alt"]) & (trimmed(x["title"]) == trimmed(x["alt"])), "info", "img-title-duplicates-alt", "Image titles repeat the alt text"),
        rule(lambda x: has(x["title"]) & ((x["alt"] == "") | hidden(x)), "info", "img-title-on-decorative", "Decorative images have a title"),
        rule(lambda x: units(F.coalesce(x["alt"], F.lit(""))) > ALT_MAX, "info", "img-alt-long", "Alt texts are very long"),
        rule(lambda x: has(x["src"]) & (~has(x["width"]) | ~has(x["height"])), "warn", "img-dimensions", "Images lack width or height"),
        rule(lambda x: has(x["src"]) & ~has(x["srcset"]) & ~x["in_picture"] & ~x["src"].rlike(r"(?i)\.svg(\?|$)"), "info", "img-srcset", "Images come in one size"),
    ]


def _rules() -> list[Column]:
    c = F.col
    none = lambda s: F.coalesce(s, F.lit("")) == ""
    low = lambda s: F.lower(F.coalesce(s, F.lit("")))
    header = c("headers")["x-robots-tag"]
    token = lambda s, t: low(s).rlike(rf"(^|[\s,:]){t}([\s,]|$)")
    both = F.concat_ws(",", "robots", header)
    says = lambda s, t: F.when(token(s, f"no{t}") | token(s, "none"), F.lit("no")).when(token(s, t) | token(s, "all"), F.lit("yes"))
    conflicts = F.filter(F.array(*(F.when(says(c("robots"), t) != says(header, t), F.lit(t)) for t in ("index", "follow"))), lambda x: x.isNotNull())
    og = lambda k: c("og")[k]
    image = og("og:image")
    vp = c("viewport_map")
    scale = first(F.coalesce(vp["maximum-scale"], F.lit("")), r"^\d+(?:\.\d+)?").cast("double")
    path = urls.path(c("url"))
    skip = F.filter(F.transform("heading_levels", lambda x, i: F.struct(x.alias("to"), F.when(i > 0, F.element_at("heading_levels", F.greatest(i, F.lit(1)))).alias("from"))), lambda p: p["to"] - p["from"] > 1)
    own = F.filter("hreflang", lambda x: urls.bare(x["href"]) == urls.bare(c("url")))
    mine = F.try_element_at(own, F.lit(1))["lang"]
    primary = lambda s: F.lower(F.split(F.coalesce(s, F.lit("")), "-")[0])
    insecure = F.filter("subresources", lambda u: u.rlike("(?i)^http://") & ~u.rlike(r"(?i)^http://(localhost|127\.0\.0\.1)([:/]|$)"))
    encoding = c("headers")["content-encoding"]
    known_headers = F.size("headers") > 1
    return [
        _if(low(c("robots")).contains("noindex"), "error", "noindex", "The page asks not to be indexed", c("robots")),
        _if(low(header).contains("noindex"), "error", "x-robots-noindex", "A header asks not to index the page", header),
        _if(token(both, "nofollow"), "warn", "nofollow-page", "No link of the page is to be followed", both),
        _if(F.size(conflicts) > 0, "warn", "robots-conflict", "Meta element and header contradict each other", F.array_join(conflicts, ", ")),
        _if(low(c("refresh")).rlike("url ?="), "warn", "meta-refresh", "The page redirects by meta refresh", c("refresh")),
        _if(none(c("title")), "error", "title-missing", "No title"),
        _if(~none(c("title")) & (units(c("title")) > c("title_max")), "warn", "title-long", "Long title", units(c("title"))),
        _if(~none(c("title")) & (units(c("title")) < c("title_min")), "warn", "title-short", "Short title", units(c("title"))),
        _if(none(c("description")), "warn", "desc-missing", "No description"),
        _if(~none(c("description")) & (units(c("description")) > c("desc_max")), "warn", "desc-long", "Long description", units(c("description"))),
        _if(~none(c("description")) & (units(c("description")) < c("desc_min")), "info", "desc-short", "Short description", units(c("description"))),
        _if(F.size("h1") == 0, "error", "h1-missing", "No main heading"),
        _if(F.size("h1") > 1, "warn", "h1-multiple", "Several main headings", F.array_join(F.slice("h1", 1, 3), " | ")),
        _if(none(c("lang")), "warn", "lang-missing", "No language declared"),
        _if(none(c("viewport")), "error", "viewport-missing", "No viewport"),
        _if(vp["user-scalable"].isin("no", "0") | (scale < 2), "warn", "viewport-locked", "Readers can't zoom in", c("viewport")),
        _if(vp["width"].rlike(r"^\d+$"), "warn", "viewport-fixed-width", "The viewport has a fixed width", c("viewport")),
        _if(F.size("canonical") == 0, "warn", "canonical-missing", "No canonical address"),
        _if(F.size("canonical") > 1, "error", "canonical-multiple", "Several canonical addresses", F.size("canonical")),
        _if((F.size("canonical") == 1) & (urls.bare(F.try_element_at("canonical", F.lit(1))) != urls.bare(c("url"))), "info", "canonical-other", "The canonical address is another page", F.try_element_at("canonical", F.lit(1))),
        *(_if(none(og(k)), "warn", "og-missing", "Open Graph is incomplete", k) for k in ("og:title", "og:description", "og:image")),
        _if(~none(image) & ~image.rlike("(?i)^(https?:)?//"), "error", "og-image-relative", "The shared image has no absolute address", image),
        _if(image.rlike(r"(?i)\.webp($|\?)"), "warn", "og-webp", "The shared image is WebP", image),
        _if(~none(image) & none(og("og:image:width")), "info", "og-no-dimensions", "The shared image's size isn't given", image),
        _each(F.filter("hreflang", lambda x: (F.lower(x["lang"]) != "x-default") & ~x["lang"].rlike(LANGUAGE_TAG)), "error", "hreflang-invalid", "Not a language tag", lambda x: x["lang"]),
        _if((F.size("hreflang") > 0) & (F.size(own) == 0), "warn", "hreflang-no-self", "Alternates leave out the page itself"),
        _if(~none(c("lang")) & mine.isNotNull() & (F.lower(mine) != "x-default") & (primary(mine) != primary(c("lang"))), "warn", "hreflang-lang-mismatch", "Alternate and page name different languages", mine),
        *_image_rules(),
        _if(c("words") < c("min_words"), "warn", "thin-content", "Little text", c("words")),
        _if(F.size("nofollow_internal") > 0, "info", "internal-nofollow", "Internal links aren't to be followed", F.array_join(F.slice("nofollow_internal", 1, 3), " ")),
        _if(~c("internal_in_main"), "info", "no-editorial-links", "The text links nowhere on the site"),
        _if(F.size(skip) > 0, "warn", "heading-skip", "A heading level is skipped", F.try_element_at(skip, F.lit(1))["to"]),
        _if(path.rlike("[A-Z]"), "warn", "url-uppercase", "The path has capitals", path),
        _if(path.contains("_"), "info", "url-underscore", "The path has underscores", path),
        _if(path.rlike(r"%20|\s"), "warn", "url-space", "The path has spaces", path),
        _if(c("charset").isNull() & ~low(c("headers")["content-type"]).contains("charset="), "warn", "charset-missing", "No character set declared"),
        _if(c("url").rlike("(?i)^https:") & (F.size(insecure) > 0), "error", "mixed-content", "A secure page loads insecure parts", F.array_join(F.slice(insecure, 1, 3), " ")),
        _if(known_headers & (c("html_units") > COMPRESSIBLE) & none(encoding), "warn", "uncompressed", "The page isn't compressed", c("html_units")),
        _if(c("html_units") > HUGE, "info", "huge-html", "Very much markup", c("html_units")),
        _if(c("ms") > c("max_ms"), "info", "slow", "Slow answer", c("ms")),
        *_jsonld_rules(),
    ]


def _jsonld_rules() -> list[Column]:
    """Rules on the top level of JSON-LD blocks. A block followed by more than white space isn't valid."""
    parsed = lambda b: F.try_parse_json(trimmed(b))
    valid = lambda b: parsed(b).isNotNull() & trimmed(b).rlike(r"(?s)^[\[{\"].*[\]}\"]$|^(true|false|null|-?\d[\d.eE+-]*)$")
    typed = lambda b: F.try_variant_get(parsed(b), "$['@type']", "string").isNotNull() | F.try_variant_get(parsed(b), "$['@graph']", "array<variant>").isNotNull() | F.try_variant_get(parsed(b), "$[0]", "variant").isNotNull()
    return [
        _each(F.filter("jsonld", lambda b: ~valid(b)), "error", "jsonld-invalid", "Structured data can't be read", lambda b: F.substring(b, 1, 80)),
        _each(F.filter("jsonld", lambda b: valid(b) & ~typed(b)), "warn", "jsonld-no-type", "Structured data without a type", lambda b: F.substring(b, 1, 80)),
    ]


def with_limits(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Each site's limits, or the defaults. limits: site and any of the columns of LIMITS, one row for a site."""
    if limits is None:
        return features.withColumns({k: F.lit(v) for k, v in LIMITS.items()})
    have = [k for k in LIMITS if k in limits.columns]
    joined = features.join(limits.select("site", *(F.col(k).alias(f"_{k}") for k in have)), "site", "left")
    return joined.withColumns({k: F.coalesce(F.col(f"_{k}"), F.lit(v)) if k in have else F.lit(v) for k, v in LIMITS.items()}).drop(*(f"_{k}" for k in have))


def page_findings(responses: DataFrame, features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(site, url, seq, level, id, title, detail). A redirected or failed page has that one finding and no other."""
    structured_data.repeated_keys(responses.sparkSession)
    failed = responses.where(~F.col("status").between(200, 299))
    redirected = F.col("status").between(300, 399)
    stopped = failed.select("site", "url", "seq", F.when(redirected, finding("error", "sitemap-redirect", "A listed address redirects", F.col("location"))).otherwise(finding("error", "page-status", "The page doesn't answer well", F.col("status"))).alias("f"))
    pages = with_limits(features, limits)
    alt = lambda x: F.lower(collapsed(F.coalesce(x["alt"], F.lit(""))))
    pictured = F.transform("images", lambda x: F.struct(*(x[k].alias(k) for k in ("src", "alt", "width", "height", "srcset", "role", "title", "alt_bound", "in_picture")), alt(x).alias("plain_alt")))
    pages = pages.withColumns({"canonical": F.col("canonical_refs"), "viewport_map": _viewport(), "pictured": pictured})
    found = pages.select("site", "url", "seq", F.explode(F.filter(F.concat(*_rules()), lambda f: f.isNotNull())).alias("f"))
    return stopped.unionByName(found).select("site", "url", "seq", "f.level", "f.id", "f.title", "f.detail")
