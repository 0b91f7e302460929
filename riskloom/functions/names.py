"""Names out of texts: addresses, versions in ranges, identifiers in descriptions, products in platform names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forge_url(url: Column) -> Column:
    """Canonical https address of a repository written as git+, ssh, git@ or https; null if it is none of a forge."""
    p = r"^(?:git\+)?(?:https?://|ssh://|git://)?(?:git@)?((?:www\.)?git(?:hub|lab)\.com)[:/]([\w.-]+)/([\w.-]+?)(?:\.git)?(?:[/#?].*)?$"
    return F.when(url.rlike(p), F.concat(F.lit("https://"), F.regexp_replace(F.regexp_extract(url, p, 1), r"^www\.", ""), F.lit("/"), F.regexp_extract(url, p, 2), F.lit("/"), F.regexp_extract(url, p, 3)))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), F.lit(""))


def first_integer(ranges: Column) -> Column:
    return F.regexp_extract(ranges, "([0-9]+)", 1).try_cast("int")


def least_python(requires: Column) -> Column:
    """``x.y`` of the ``>=`` bound of a requirement, as text."""
    return F.nullif(F.regexp_extract(requires, r">=\s*([0-9]+\.[0-9]+)", 1), F.lit(""))


def symbols(text: Column) -> Column:
    """Identifiers a description names: in back ticks, then CamelCase words; the last dotted part, each once, in order."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1))
    last = F.transform(F.concat(ticked, camel), lambda x: F.substring_index(x, ".", -1))
    return F.array_distinct(last)


def product(cpe: Column) -> Column:
    """Product of a platform name: its fifth field, or the fourth where that is empty or a star."""
    parts = F.split(cpe, ":")
    p = F.get(parts, F.lit(4))
    return F.when(p.isNull() | p.isin("", "*"), F.get(parts, F.lit(3))).otherwise(p)


def prefixes(name: Column) -> Column:
    """``name`` cut at each ``_``, longest last: a prefix match becomes an equality."""
    parts = F.split(name, "_")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
