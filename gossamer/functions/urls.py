"""Column expressions over URLs: origin, path, comparison keys, resolution, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions.text import let

NOT_A_PAGE = r"(?i)^(#|mailto:|tel:|javascript:|data:)"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1))


def path(url: Column) -> Column:
    """Path without query and fragment; a slash if there is none."""
    p = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def bare(url: Column) -> Column:
    """Without one trailing slash."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/$", "")


def key(url: Column) -> Column:
    """Without fragment, then without one trailing slash."""
    return bare(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""))


def _encoded(s: Column, safe: str) -> Column:
    """s with the UTF-8 bytes of every character outside the set `safe` percent-encoded."""

    def encode(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
        written = F.transform(runs, lambda r: F.when(r.rlike(f"^[{safe}]"), r).otherwise(F.regexp_replace(F.hex(F.encode(r, "UTF-8")), "(..)", "%$1")))
        return F.when(s.rlike(f"[^{safe}]"), F.array_join(written, "")).otherwise(s)

    return let(s, encode)


def _without_dots(p: Column) -> Column:
    """A path without its dot segments; those at its end leave a slash."""

    def tidy(p: Column) -> Column:
        last = F.regexp_like(p, F.lit(r"(?i)/(\.|%2e){1,2}$"))
        step = lambda acc, x: F.when(x.rlike(r"(?i)^(\.|%2e){2}$"), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(r"(?i)^(\.|%2e)$"), acc).otherwise(F.concat(acc, F.array(x)))
        parts = let(F.split(p, "/"), lambda x: F.slice(x, F.lit(2), F.size(x)))
        kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
        joined = let(kept, lambda k: F.concat(F.when(F.size(k) > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(k, "/")))
        return F.when(F.regexp_like(p, F.lit(r"(?i)/(\.|%2e){1,2}(/|$)")), F.concat(joined, F.when(last, F.lit("/")).otherwise(F.lit("")))).otherwise(p)

    return let(p, tidy)


# Characters that stay as they are in a path, a query and a fragment
PATH_SAFE, QUERY_SAFE, FRAGMENT_SAFE = r"!$-;=@-_a-z|~", r"!$-&(-;=?-_`a-~", r"!#-;=?-_a-~"


def normal(url: Column) -> Column:
    """An absolute http(s) address in normal form: case and script of its host, default port, dot segments, percent-encoding. NULL if there is no host."""

    def written(x: Column) -> Column:
        port = F.when((x["port"] == "") | ((x["scheme"] == "http") & (x["port"] == "80")) | ((x["scheme"] == "https") & (x["port"] == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), x["port"]))
        # java.net.IDN writes a host of another script in ASCII; a CASE branch, so that other hosts don't meet it
        host = F.when(x["host"].rlike(r"[^\x00-\x7F]"), F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), x["host"])).otherwise(x["host"])
        path = F.when(x["path"] == "", F.lit("/")).otherwise(_encoded(_without_dots(x["path"]), PATH_SAFE))
        return F.when(x["host"] != "", F.concat(x["scheme"], F.lit("://"), x["user"], host, port, path, _encoded(x["query"], QUERY_SAFE), _encoded(x["fragment"], FRAGMENT_SAFE)))

    def split(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u, r"^([a-zA-Z]+)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)

        def fields(authority: Column) -> Column:
            place = F.regexp_replace(authority, "^.*@", "")
            return F.struct(
                F.lower(part(1)).alias("scheme"),
                F.regexp_extract(authority, "^(.*@)", 1).alias("user"),
                F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
                F.regexp_extract(place, r":(\d+)$", 1).alias("port"),
                F.replace(part(3), F.lit("\\"), F.lit("/")).alias("path"),
                part(4).alias("query"),
                part(5).alias("fragment"),
            )

        return let(let(part(2), fields), written)

    return let(url, split)


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of a reference on a page, or NULL. Column functions only.

    References that are in normal form already, or rooted ones in it, take a short way.
    """
    plain = r"^https?://[a-z0-9.-]+/[A-Za-z0-9_~/-]*(\?[A-Za-z0-9_~=&-]*)?(#[A-Za-z0-9_~-]*)?$"
    rooted = r"^/(?!/)[A-Za-z0-9_~/-]*(\?[A-Za-z0-9_~=&-]*)?(#[A-Za-z0-9_~-]*)?$"
    tidy = ~base.rlike(r"^https?://[^/]*[A-Z:@]")

    def full(r: Column) -> Column:
        b = F.regexp_replace(base, "#.*$", "")
        at = F.regexp_replace(b, r"\?.*$", "")
        root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
        folder = F.when(at == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(at, "[^/]*$", ""))
        return (
            F.when(r.rlike(r"(?i)^https?:[/\\]{2}"), F.regexp_replace(r, r"^([a-zA-Z]+):[/\\]+", "$1://"))
            .when(r.rlike(r"^[a-zA-Z][\w+.-]*:"), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.lit("//"), F.regexp_replace(r, r"^[/\\]+", "")))
            .when(r.rlike(r"^[/\\]"), F.concat(root, r))
            .when(r == "", b)
            .when(r.startswith("?"), F.concat(at, r))
            .when(r.startswith("#"), F.concat(b, r))
            .otherwise(F.concat(folder, r))
        )

    def absolute(ref: Column) -> Column:
        r = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
        return let(let(r, full), lambda u: F.when(u.rlike("(?i)^https?:"), normal(u)).when(u.rlike(r"^[a-zA-Z][\w+.-]*:"), u))

    return let(ref, lambda x: F.when(x.rlike(plain), x).when(x.rlike(rooted) & tidy, F.concat(origin(base), x)).otherwise(absolute(x)))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a whole path: * stops at a slash, ** doesn't, the rest is literal."""
    literal = F.regexp_replace(glob, r"([\\.+?^${}()|\[\]])", r"\\$1")
    starred = F.replace(F.replace(F.replace(literal, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.lit("^"), starred, F.lit("$"))
