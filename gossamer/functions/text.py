"""Column expressions over markup: white space, lengths, attributes, entities, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as browsers count it.
BLANK = r"(?U)\s"
#: Kana, CJK and Thai: scripts written without spaces between words.
UNSPACED = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{0E00}-\\x{0E7F}]"
# The entities that are decoded, in order
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def units(s: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice. Text in ASCII isn't searched for them."""
    return F.when(F.octet_length(s) == F.length(s), F.length(s)).otherwise(F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]")))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{BLANK}+|{BLANK}+$", "")


def collapsed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, rf"{BLANK}+", " "))


def plain(s: Column) -> Column:
    """Text without tags, white space collapsed."""
    return collapsed(F.regexp_replace(s, "<[^>]+>", " "))


def decoded(s: Column) -> Column:
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def first(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or NULL without a match. The text behind a whole match (group 0, which must not be empty) isn't searched."""
    if group == 0:
        return let(F.regexp_extract(s, pattern, 0), lambda x: F.when(x != "", x))
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(group)), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag: NULL when absent, '' when it stands without a value."""
    start = rf"(?i)(?<![-:\[\w]){name}"
    quoted, single, bare = first(tag, rf'{start}\s*=\s*"([^"]*)"', 1), first(tag, rf"{start}\s*=\s*'([^']*)'", 1), first(tag, rf"{start}\s*=\s*([^\s\"'`=<>]+)", 1)
    return F.coalesce(decoded(F.coalesce(quoted, single, bare)), F.when(tag.rlike(rf"{start}(?=[\s/>])"), F.lit("")))


# Fixed value: a name that isn't part of a longer or bound one, and a value in double quotes, single quotes or none
TOKEN = r"""(?i)(?<![-:\[\w])[a-z][a-z0-9-]*(?:\s*=\s*(?:"[^"]*"|\x27[^\x27]*\x27|[^\s"\x27`=<>]+)|(?=[\s/>]))"""

#: Double quotes within single ones, or a value apart from its equals sign: what one pass may take for something else.
ODD = r"""=\x27[^\x27]*"|=\s+[^\s"\x27]"""
_BLANKS = r"' \t\n\u000b\f\r'"


def let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def attributes(tag: str, names: tuple[str, ...]) -> str:
    """SQL for a tag with its attributes, read in one pass: a struct of the tag and a map of these names to values, as attribute() gives them.

    Of one name, double-quoted values come first, then single-quoted, bare and valueless ones. The tag itself is searched for a name only where the
    pass can't tell: where the tag is odd; or where the name stands within a value, too, and wasn't found with double quotes.
    Written as SQL text, as a plan has many of these and text is analysed once.
    """
    decode = "{}"
    for entity, char in ENTITIES:
        decode = f"replace({decode}, '{entity}', '{char.replace(chr(39), chr(92) + chr(39))}')"
    entry = f"""transform(array(named_struct('name', lower(substring_index(token, '=', 1)), 'value', trim(LEADING {_BLANKS} FROM substring(token, length(substring_index(token, '=', 1)) + 2)))), x ->
      named_struct('k', trim(TRAILING {_BLANKS} FROM x.name), 'form', case when x.value like '"%' then 0 when x.value like "'%" then 1 when contains(token, '=') then 2 else 3 end, 'at', at,
        'v', transform(array(if(x.value like '"%' or x.value like "'%", substring(x.value, 2, length(x.value) - 2), x.value)), v -> if(contains(v, '&'), {decode.format("v")}, v))[0]))[0]"""
    start = r"concat(r'(?i)(?<![-:\[\w])', n)"
    found = lambda rest: f"try_element_at(regexp_extract_all({tag}, concat({start}, r'{rest}'), 1), 1)"
    value = f"coalesce({found(r'\s*=\s*"([^"]*)"')}, {found(r'\s*=\s*\x27([^\x27]*)\x27')}, {found(r'\s*=\s*([^\s"\x27`=<>]+)')})"
    alone = r"r'(?=[\s/>])'"
    search = f"coalesce({decode.format(value)}, if(rlike({tag}, concat({start}, {alone})), '', null))"
    listed = f"array({', '.join(repr(n) for n in names)})"
    times = f"(length({tag}) - length(replace(seen.low, n, ''))) / length(n)"
    one = f"""if(not contains(seen.low, n), null, transform(array(array_min(filter(seen.es, e -> e.k = n))), e ->
      case when not seen.odd and e is not null and (e.form = 0 or {times} = 1) then e.v else {search} end)[0])"""
    entries = f"transform(regexp_extract_all({tag}, r'{TOKEN}', 0), (token, at) -> {entry})"
    facts = f"named_struct('low', lower({tag}), 'odd', rlike({tag}, r'{ODD}'), 'es', {entries})"
    return f"named_struct('tag', {tag}, 'map', transform(array({facts}), seen -> map_from_arrays({listed}, transform({listed}, n -> {one})))[0])"


def read(tag: Column, name: str) -> Column:
    """An attribute of a tag with its map."""
    return tag["map"][name]


def words(text: Column) -> Column:
    """Words of a text; of unspaced scripts, two characters count as a word. A word is counted from its first letter or digit on."""

    def counted(t: Column) -> Column:
        spaced = F.regexp_count(t, F.lit(rf"(?U)[\p{{L}}\p{{N}}&&[^{UNSPACED}]][^\s{UNSPACED}]*"))
        other = spaced + F.floor(F.regexp_count(t, F.lit(UNSPACED)) / 2 + 0.5)
        return F.coalesce(F.when(F.octet_length(t) == F.length(t), F.regexp_count(t, F.lit(r"[A-Za-z0-9]\S*"))).otherwise(other), F.lit(0)).cast("int")

    return let(text, counted)
