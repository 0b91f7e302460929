"""Small classifiers over texts: severities, ecosystems, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least, the order every ranking uses.
SEVERITIES = ("unknown", "none", "low", "medium", "high", "critical")


def severity_of(text: Column) -> Column:
    """A feed's severity word in the engine's words; ``moderate`` is medium, words it doesn't know are unknown."""
    t = F.lower(F.trim(text))
    return F.when(t == "moderate", "medium").when(t.isin("critical", "high", "medium", "low", "none"), t).when(t == "info", "none").otherwise("unknown")


def severity_of_score(score: Column) -> Column:
    """Bands 9, 7, 4 and above 0; null or not a number is unknown."""
    s = F.when(F.isnan(score), None).otherwise(score)
    return F.when(s.isNull(), "unknown").when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").when(s > 0, "low").otherwise("none")


def severity_rank(severity: Column) -> Column:
    """0 for unknown up to 5 for critical."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)) - 1, F.lit(0)).cast("int")


def normal_package(name: Column, ecosystem: Column) -> Column:
    """Package name as imports write it: pypi and rubygems join words by ``_``, others are only lower case."""
    return F.when(ecosystem.isin("pypi", "rubygems"), F.translate(F.lower(name), "-.", "__")).otherwise(F.lower(name))


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def hcl_string(text: Column) -> Column:
    """``text`` with backslashes and quotes escaped for a configuration file."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


#: How package names show their ecosystem, tried in this order.
NAME_RULES = (
    ("npm", r"(?i)^@[\w.-]+/[\w.-]+$"), ("maven", r"^[\w.-]+:[\w.-]+$"), ("go", r"(?i)^[a-z0-9-]+\.[a-z0-9.-]+/"), ("pypi", r"(?i)^(?:python|py)-"), ("rubygems", r"(?i)^ruby-|-rb$"),
    ("cargo", r"(?i)^(?:tokio|serde|actix|rocket|diesel)"),
)


def ecosystem_of_package(name: Column) -> Column:
    """The ecosystem a package name looks like; npm if nothing tells."""
    out = F.lit("npm")
    for ecosystem, pattern in reversed(NAME_RULES):
        out = F.when(name.rlike(pattern), ecosystem).otherwise(out)
    return out
