"""Scalar functions and predicates as native column expressions: they stay inside Catalyst and its generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_PAGES = (
    "/reports?/?$", "/research/?$", "/insights?/?$", "/resources?/?$", "/list/?$", r"/index\.html?$", "/whitepapers?/?$", r"\?page=[0-9]+",
)
#: Letters, digits and underscore of any script; the same class is written in the SQL that checks it.
WORDS = r"[\p{L}\p{N}_]+"


def _lit(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(url: Column, name: str) -> Column:
    """A part of a URL (PROTOCOL, AUTHORITY, PATH, ...); null if the URL can't be parsed."""
    return F.try_parse_url(url, F.lit(name))


def same_origin(url: Column | str, base: Column | str) -> Column:
    """http(s), equal schemes, equal authorities but for case."""
    a, b = _lit(url), _lit(base)
    scheme = F.lower(part(a, "PROTOCOL"))
    return F.coalesce(
        scheme.isin("http", "https") & (scheme == F.lower(part(b, "PROTOCOL"))) & (F.lower(part(a, "AUTHORITY")) == F.lower(part(b, "AUTHORITY"))),
        F.lit(False),
    )


def is_list_page(url: Column | str) -> Column:
    """The URL has a path and ends like an overview of other pages."""
    u = _lit(url)
    path = F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", "")
    return (path != "") & u.rlike("(?i)" + "|".join(LIST_PAGES))


def slug(url: Column | str) -> Column:
    """The last segment of the path, without query, fragment and closing slash."""
    bare = F.regexp_replace(F.regexp_replace(_lit(url), "[?#].*$", ""), "/+$", "")
    return F.element_at(F.split(bare, "/"), -1)


def name_from_url(url: Column | str, case: str = "title") -> Column:
    """A readable name: the slug without extension, dashes and underscores as spaces."""
    bare = F.regexp_replace(slug(url), r"\.(html?|php|aspx?|jsp)$", "")
    return name_case(F.trim(F.translate(bare, "-_", "  ")), case)


def name_case(name: Column, case: str = "title") -> Column:
    return {"preserve": name, "upper": F.upper(name), "lower": F.lower(name)}.get(case, title_case(name))


def title_case(name: Column) -> Column:
    """A capital behind everything that isn't a letter, all else small."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30)))
    return F.array_join(capital, "")


def safe_name(name: Column | str) -> Column:
    """A name that file systems take: control and reserved characters and spaces become underscores; 200 characters at most."""
    s = F.regexp_replace(_lit(name), r'[\x00-\x1f\\/*?:"<>|]', "_")
    s = F.rtrim(F.replace(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit(" "), F.lit("_")))
    s = F.regexp_replace(s, "[. ]+$", "")
    return F.left(F.when(s.isin("", ".", ".."), F.lit("_")).otherwise(s), F.lit(200))


def is_identifier(name: Column | str) -> Column:
    return _lit(name).rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")


def is_meaningless_image(url: Column | str, keywords: Sequence[str]) -> Column:
    """A keyword stands as a token of its own in the file's name (of the query's fileName, if there is one)."""
    if not keywords:
        return F.lit(False)
    u = _lit(url)
    asked = F.regexp_extract(u, "[?&]fileName=([^&#]+)", 1)
    name = F.lower(F.regexp_extract(F.when(asked != "", asked).otherwise(F.regexp_replace(u, "[?#].*$", "")), "([^/]*)$", 1))
    words = "|".join("\\Q" + k.replace("\\E", "") + "\\E" for k in keywords)
    return name.rlike(f"(?:^|[-_./])(?:{words})(?:$|[-_./])")


def usable_href(href: Column | str, page: Column | str | None = None) -> Column:
    """Not empty, no fragment or script, and no fragment of the page itself."""
    h = _lit(href)
    ok = F.coalesce((h != "") & ~h.startswith("#") & ~h.startswith("javascript:"), F.lit(False))
    if page is not None:
        own = F.regexp_replace(_lit(page), "/+$", "")
        ok &= ~(h.contains("#") & (F.regexp_replace(F.substring_index(h, "#", 1), "/+$", "") == own))
    return ok


def percent_decoded(text: Column) -> Column:
    """Plus signs stay plus signs."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def template(text: str, values: Mapping[str, Column]) -> Column:
    """``{name}`` for each value; names without one stay as they are."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def renamed(payload: Column, logical: str, mapping: Mapping[str, str]) -> Column:
    """A field of a variant by its logical name, under the physical name that the site uses."""
    return F.try_variant_get(payload, f"$.{mapping.get(logical, logical)}", "string")


def plural(kind: Column | str) -> Column:
    k = _lit(kind)
    return F.when(k == "industry", F.lit("industries")).otherwise(F.concat(k, F.lit("s")))


def fingerprint(text: Column | str) -> Column:
    """md5 of a text without its white space; empty for none."""
    bare = F.regexp_replace(_lit(text), r"(?U)\s+", "")
    return F.when(F.coalesce(_lit(text), F.lit("")) == "", F.lit("")).otherwise(F.md5(bare.cast("binary")))


def looks_like_code(text: Column | str) -> Column:
    """A product code: short, begins with a capital or digit, has a dash or is short and alphanumeric."""
    t = F.trim(F.regexp_replace(F.trim(_lit(text)), r"^\*+|\*+$", ""))
    begins = t.rlike(r"^[\p{Lu}\p{Nd}]")
    plain = F.replace(t, F.lit(" "), F.lit("")).rlike(r"^[\p{L}\p{N}]+$") & (F.length(t) <= 20)
    return (F.length(t) <= 50) & begins & (t.contains("-") | plain)


def without_repeated_code(title: Column | str) -> Column:
    """Drops a code at the end that an earlier code of the title already holds."""
    t = _lit(title)
    codes = F.regexp_extract_all(t, F.lit("[A-Z0-9]{2,}-[A-Z0-9]+(?:-[A-Z0-9]+)*"), F.lit(0))
    last = F.element_at(codes, -1)
    again = (F.size(codes) >= 2) & F.exists(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), lambda c: c.contains(last))
    trimmed = F.rtrim(t)
    return F.when(again & trimmed.endswith(last), F.rtrim(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(last)))).otherwise(t)


def lost_share(before: Column | str, after: Column | str) -> Column:
    """The share of distinct tokens of ``before`` that ``after`` lacks."""
    token = lambda c: F.array_distinct(F.regexp_extract_all(_lit(c), F.lit(r"\S+"), F.lit(0)))
    a = token(before)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_except(a, token(after))) / F.size(a))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= text.rlike(p)
    return out


def count_of(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_lit(text), F.lit(pattern)).cast("int")


def wiki_links(text: Column | str) -> Column:
    return F.regexp_extract_all(_lit(text), F.lit(r"\[\[(.+?)\]\]"), F.lit(1))


def images(text: Column | str) -> Column:
    return F.regexp_extract_all(_lit(text), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def links(text: Column | str) -> Column:
    """Targets of links that aren't images."""
    return F.regexp_extract_all(_lit(text), F.lit(r"(?<!!)\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
