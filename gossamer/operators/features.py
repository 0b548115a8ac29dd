"""Page features: one narrow job over responses, and the tables of links and anchors.

Only ok HTML responses have features. No column holds the body, so it never reaches a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import urls
from gossamer.functions.text import attribute, attributes, collapsed, decoded, first, let, plain, read, trimmed, units, words

# What counts as a script or style, an address in a tag's attribute, a picture, a named link
# (a pattern begins with what need not be tried in both cases, as it is tried at each character of a page)
SCRIPTS = r"(?s)<(?i:script.*?</script|style.*?</style)>"
TITLE = r"(?s)<(?i:title)[^>]*>(.*?)</(?i:title)>"


def _sections(responses: DataFrame) -> DataFrame:
    ok = responses.where((F.col("status").between(200, 299)) & F.lower(F.col("headers")["content-type"]).contains("text/html"))
    html = F.regexp_replace(F.coalesce("body", F.lit("")), r'="[^"]*<[a-zA-Z][^">]*>[^"]*"', '=""')
    d = ok.withColumn("html", html).withColumn("html_parts", _parts("html", rf"script|style|{LOADING}\b"))
    d = d.withColumn("markup", F.when(_any("html_parts", "script|style"), F.regexp_replace("html", SCRIPTS, " ")).otherwise(F.col("html")))
    section = lambda name: F.coalesce(first(F.col("markup"), rf"(?s)<(?i:{name}).*?</(?i:{name})>"), F.col("markup"))
    d = d.withColumns({"head": first(F.col("markup"), r"(?s)<(?i:head)\b.*?</(?i:head)>"), "main": section("main")})
    return d.withColumns({"markup_parts": _parts("markup", r"picture|(?:meta|link|img|a|h[12])\b"), "main_parts": _parts("main", r"(?:a|h[1-6])\b")})


def _parts(source: str, names: str) -> Column:
    """What stands between one < and the next, where it begins with one of these names: a page is cut once and not searched for each of them."""
    return F.expr(rf"filter(split({source}, '<'), (p, i) -> i > 0 and rlike(p, r'^(?i:{names})'))")


def _any(parts: str, names: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(f"^(?i:{names})"))


#: Attributes that are read from a kind of tag.
META, LINK, LOADED, ANCHOR = ("name", "http-equiv", "property", "content", "charset"), ("rel", "href", "hreflang"), ("src", "href", "rel"), ("href", "rel")
LOADING = "(?:img|script|iframe|video|audio|source|embed|track|input|object|link)"
IMAGE = ("src", "alt", "width", "height", "srcset", "loading", "role", "title")


def _tags(source: str, name: str, names: tuple[str, ...]) -> Column:
    """All tags of a name, each with a map of these attributes. The source itself is searched only where a tag of this name has a < in it or doesn't end."""
    cut = f"if(exists(own, p -> not contains(p, '>')), regexp_extract_all({source}, r'<(?i:{name})\\b[^>]*>', 0), transform(own, p -> concat('<', substring_index(p, '>', 1), '>')))"
    found = rf"transform(array(filter({source}_parts, p -> rlike(p, r'^(?i:{name})\b'))), own -> {cut})[0]"
    return F.expr(f"transform({found}, t -> {attributes('t', names)})")


def _headings(name: str) -> Column:
    """What stands in the elements of a name."""
    return F.when(_any("markup_parts", rf"{name}\b"), F.regexp_extract_all("markup", F.lit(rf"(?s)<(?i:{name})\b[^>]*>(.*?)</(?i:{name})>"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))


def _is(tag: Column, name: str, value: str) -> Column:
    return F.lower(F.coalesce(read(tag, name), F.lit(""))) == value


def _meta(key: str, value: str) -> Column:
    """Content of the first meta element with this key."""
    return read(F.try_element_at(F.filter("metas", lambda t: _is(t, key, value)), F.lit(1)), "content")


def _meta_map(key: str, prefix: str) -> Column:
    """Later elements win."""

    def as_map(pairs: Column) -> Column:
        names = F.array_distinct(pairs["k"])
        last = lambda n: F.try_element_at(F.filter(pairs, lambda p: p["k"] == n), F.lit(-1))["v"]
        return F.when(F.size(names) == F.size(pairs), F.map_from_arrays(pairs["k"], pairs["v"])).otherwise(F.map_from_arrays(names, F.transform(names, last)))

    hit = F.filter("metas", lambda t: F.coalesce(read(t, key), F.lit("")).startswith(prefix))
    return let(F.transform(hit, lambda t: F.struct(read(t, key).alias("k"), read(t, "content").alias("v"))), as_map)


def _images() -> Column:
    def image(tag: Column) -> Column:
        names = [read(tag, a).alias(a) for a in IMAGE]
        src = read(tag, "src")
        inside = (F.col("pictures") != "") & (src != "") & F.col("pictures").contains(src)
        return F.struct(*names, tag["tag"].rlike(r"(?i)[:\[]alt\b").alias("alt_bound"), F.coalesce(inside, F.lit(False)).alias("in_picture"))

    return F.transform(_tags("markup", "img", IMAGE), image)


def page_features(responses: DataFrame) -> DataFrame:
    """One row for each ok HTML response: everything that the rules read from its markup."""
    return _features(_sections(responses))


def page_tables(responses: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """page_features and page_links of one pass over bodies; keep(df) writes what both are read from."""
    wide = keep(_features(_with_links(_sections(responses)), ["page_links"]))
    return wide.drop("page_links"), _exploded(wide)


def _features(d: DataFrame, more: list[str] | None = None) -> DataFrame:
    d = d.withColumn("metas", _tags("markup", "meta", META)).withColumn("links", _tags("markup", "link", LINK))
    # all pictures in one text, so that an image is looked for once
    d = d.withColumn("pictures", F.when(_any("markup_parts", "picture"), F.array_join(F.regexp_extract_all("markup", F.lit(r"(?s)<(?i:picture).*?</(?i:picture)>"), F.lit(0)), "\u0001")).otherwise(F.lit("")))
    rel = lambda value: F.filter("links", lambda t: _is(t, "rel", value))
    d = d.withColumn("refs", _references(rel)).withColumn("refs", F.filter("refs", lambda r: r["href"].isNotNull() | (r["kind"] == "alternate")))
    of_kind = lambda kind: F.filter("refs", lambda r: r["kind"] == kind)
    charset = F.filter(F.transform("metas", lambda t: read(t, "charset")), lambda c: c.isNotNull())
    is_link = lambda t: t["tag"].rlike("(?i)^<link")
    loaded = F.filter(_tags("html", LOADING, LOADED), lambda t: ~is_link(t) | F.coalesce(read(t, "rel"), F.lit("")).rlike(r"(?i)stylesheet"))
    return d.select(
        "site",
        "url",
        "seq",
        "status",
        "headers",
        "ms",
        trimmed(first(first(F.col("markup"), TITLE), TITLE, 1)).alias("title"),
        _meta("name", "description").alias("description"),
        _meta("name", "robots").alias("robots"),
        _meta("http-equiv", "refresh").alias("refresh"),
        _meta("name", "viewport").alias("viewport"),
        attribute(first(F.col("markup"), r"<(?i:html)\b[^>]*>"), "lang").alias("lang"),
        F.coalesce(F.try_element_at(charset, F.lit(1)), F.when(F.col("head").rlike("(?i)charset="), F.lit("declared"))).alias("charset"),
        of_kind("canonical")["href"].alias("canonical_refs"),
        F.transform(of_kind("alternate"), lambda r: F.struct(r["lang"].alias("lang"), r["href"].alias("href"))).alias("hreflang"),
        _meta_map("property", "og:").alias("og"),
        _meta_map("name", "twitter:").alias("twitter"),
        F.transform(_headings("h1"), plain).alias("h1"),
        F.transform(_headings("h2"), plain).alias("h2"),
        F.transform(F.filter("main_parts", lambda p: p.rlike(r"^[hH][1-6]\b")), lambda p: F.substring(p, 2, 1).cast("int")).alias("heading_levels"),
        _images().alias("images"),
        F.when(_any("html_parts", r"script\b"), F.regexp_extract_all("html", F.lit(r"(?s)<(?i:script\b[^>]*application/ld\+json)[^>]*>(.*?)</(?i:script)>"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)")).alias("jsonld"),
        words(F.regexp_replace("main", "<[^>]+>", " ")).alias("words"),
        units(F.coalesce("body", F.lit(""))).cast("long").alias("html_units"),
        F.filter(F.transform(loaded, lambda t: F.coalesce(read(t, "src"), F.when(is_link(t), read(t, "href")))), lambda u: u.isNotNull()).alias("subresources"),
        *_link_counts(of_kind),
        *(more or []),
    )


def _hrefs(source: str) -> Column:
    found = F.transform(_tags(source, "a", ANCHOR), lambda t: F.struct(read(t, "href").alias("href"), read(t, "rel").alias("rel")))
    return F.filter(found, lambda a: (F.coalesce(a["href"], F.lit("")) != "") & ~a["href"].rlike(urls.NOT_A_PAGE))


def _nofollow(a: Column) -> Column:
    return F.coalesce(a["rel"], F.lit("")).rlike(r"(?i)(^|\s)nofollow(\s|$)")


def _references(rel) -> Column:
    """What a page refers to, as (kind, lang, absolute href): resolved in one place, as that is a long expression."""
    some = lambda tags, kind, lang=None: F.transform(tags, lambda t: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if lang is None else lang(t)).alias("lang"), (t["href"] if kind in ("main", "nofollow") else read(t, "href")).alias("href")))
    alternates = F.filter(rel("alternate"), lambda t: F.coalesce(read(t, "hreflang"), F.lit("")) != "")
    refs = F.concat(some(rel("canonical"), "canonical"), some(alternates, "alternate", lambda t: read(t, "hreflang")), some(_hrefs("main"), "main"), some(F.filter(_hrefs("markup"), _nofollow), "nofollow"))
    return F.transform(refs, lambda r: F.struct(r["kind"].alias("kind"), r["lang"].alias("lang"), F.when(r["href"] != "", urls.resolve(F.col("url"), r["href"])).alias("href")))


def _link_counts(of_kind) -> list[Column]:
    """Whether the main part links to a page of the origin; and the pages of the origin, other than this one, that links with nofollow lead to."""
    home = urls.origin(F.col("url"))
    barred = F.array_distinct(F.transform(F.filter(of_kind("nofollow"), lambda r: F.startswith(r["href"], home)), lambda r: F.substring_index(r["href"], "#", 1)))
    return [
        F.exists(of_kind("main"), lambda r: F.startswith(r["href"], home)).alias("internal_in_main"),
        F.filter(barred, lambda u: urls.bare(u) != urls.key(F.col("url"))).alias("nofollow_internal"),
    ]


def page_links(responses: DataFrame, strict_origin: bool = False) -> DataFrame:
    """(site, src_url, src_seq, pos, href, kind, in_main, nofollow): each target once for a page; pos: its place among the page's targets, from 0. Narrow: nothing is shuffled.

    Distinct targets, those of the main part and those with nofollow are sorted together, so that the marks of a target are its neighbours.
    """
    return _exploded(_with_links(_sections(responses)), strict_origin)


def _with_links(d: DataFrame) -> DataFrame:
    """d with page_links: the page's distinct targets, each with its place and marks."""
    full = lambda refs: F.transform(refs, lambda a: F.struct(urls.resolve(F.col("url"), a["href"]).alias("href"), _nofollow(a).alias("nofollow")))
    d = d.withColumns({"every_link": full(_hrefs("markup")), "main_link": full(_hrefs("main"))})
    distinct = lambda refs: F.array_compact(F.array_distinct(refs["href"]))
    marked = lambda refs, mark: F.transform(distinct(refs), lambda h, i: F.struct(h.alias("href"), F.lit(mark).alias("mark"), i.alias("pos")))
    d = d.withColumn("marks", F.array_sort(F.concat(marked(F.col("every_link"), 0), marked(F.col("main_link"), 1), marked(F.filter("every_link", lambda a: a["nofollow"]), 2))))
    has = lambda x, i, mark: F.exists(F.slice("marks", i + 2, F.lit(2)), lambda y: (y["href"] == x["href"]) & (y["mark"] == mark))
    told = F.filter(F.transform("marks", lambda x, i: F.when(x["mark"] == 0, F.struct(x["href"], x["pos"], has(x, i, 1).alias("in_main"), has(x, i, 2).alias("nofollow")))), lambda x: x.isNotNull())
    return d.withColumn("page_links", told)


def _exploded(d: DataFrame, strict_origin: bool = False) -> DataFrame:
    # explode would have Spark test first that there are links, and for that work out their marks anew at each link
    one = d.select("site", F.col("url").alias("src_url"), F.col("seq").alias("src_seq"), F.explode_outer("page_links").alias("a")).where("a is not null").select("site", "src_url", "src_seq", "a.*")
    inside = (urls.origin(F.col("href")) == F.col("site")) if strict_origin else F.startswith("href", "site")
    return one.select("site", "src_url", "src_seq", "href", "pos", "in_main", "nofollow", F.when(inside, "internal").otherwise("external").alias("kind"))


def page_anchors(responses: DataFrame) -> DataFrame:
    """(site, src_url, src_seq, pos, href, name): named internal anchors; links of a page to itself are left out."""
    pairs = F.regexp_extract_all("markup", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    d = _sections(responses).select("site", F.col("url").alias("src_url"), F.col("seq").alias("src_seq"), F.posexplode(pairs).alias("pos", "a"))
    d = d.withColumns({"inner": F.regexp_replace("a", r"(?is)^<a\b[^>]*>|</a>$", ""), "tag": first(F.col("a"), r"(?is)^<a\b[^>]*>")})
    d = d.withColumn("img", first(F.col("inner"), r"(?i)<img\b[^>]*>"))
    d = d.withColumns({"tag": F.expr(attributes("tag", ("href", "aria-label", "aria-labelledby", "title"))), "img": F.expr(attributes("img", ("alt", "title")))})
    inner, tag, img = F.col("inner"), F.col("tag"), F.col("img")
    some = lambda c: F.when(c != "", c)
    believed = img["tag"].rlike(r"(?i)[:\[]alt\b") | tag["tag"].rlike(r"(?i)[:\[](attr\.)?aria-?label\b") | read(tag, "aria-labelledby").isNotNull() | inner.rlike(r"(?i)aria-label(ledby)?=")
    name = F.coalesce(
        some(decoded(plain(inner))),
        some(read(img, "alt")),
        some(read(tag, "aria-label")),
        some(read(tag, "title")),
        some(decoded(plain(first(inner, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))),
        some(read(img, "title")),
        F.when(F.coalesce(believed, F.lit(False)), F.lit("…")),
        F.lit(""),
    )
    href = read(tag, "href")
    d = d.where((href != "") & ~href.rlike(urls.NOT_A_PAGE)).select("site", "src_url", "src_seq", "pos", urls.resolve(F.col("src_url"), href).alias("href"), F.substring(name, 1, 300).alias("name"))
    d = d.where(F.startswith("href", "site")).withColumn("href", F.regexp_replace("href", "#.*$", ""))
    return d.where(urls.bare(F.col("href")) != urls.key(F.col("src_url")))


def anchor_phrase(name: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", " "))
