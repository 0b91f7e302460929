"""Advisory feeds landed as JSON texts to one shape: id, description, severity, cvss_score, cvss_vector, affected, references.

Schemas are given, never inferred; a text that can't be read gives no row. ``affected`` elements have ecosystem,
name, version_start, version_end and fixed_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import severity_of

#: What the forges call the ecosystems.
ECOSYSTEMS = {"PIP": "pypi", "NPM": "npm", "MAVEN": "maven", "GO": "go", "RUBYGEMS": "rubygems", "RUST": "cargo", "COMPOSER": "composer", "GEM": "rubygems", "PACKAGIST": "composer", "CARGO": "cargo", "PYPI": "pypi"}

GITHUB = """data struct<securityVulnerabilities: struct<nodes: array<struct<
 advisory: struct<ghsaId: string, summary: string, description: string, severity: string, cvss: struct<score: double, vectorString: string>, references: array<struct<url: string>>, publishedAt: string, updatedAt: string, identifiers: array<struct<type: string, value: string>>>,
 package: struct<ecosystem: string, name: string>, vulnerableVersionRange: string, firstPatchedVersion: struct<identifier: string>>>>>"""
GITLAB = "id string, identifier string, cve string, title string, description string, severity string, cvss_v3 string, package_slug string, affected_range string, fixed_versions array<string>, urls array<string>, published_date string"


def ecosystem(word: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ECOSYSTEMS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(word)), F.lower(word))


def range_ends(ranges: Column) -> Column:
    """Struct start, end of a comma-separated range: the last lower and the last upper bound; ``= x`` is both."""
    parts = F.transform(F.split(ranges, ","), lambda x: F.trim(x))
    bound = lambda ops: F.regexp_extract(F.try_element_at(F.filter(parts, lambda p: p.rlike(f"^({ops})\\s*[^<>=\\s]")), F.lit(-1)), f"^({ops})\\s*(.+)$", 2)
    exact = bound("==?")
    return F.struct(F.coalesce(exact, bound(">=?")).alias("start"), F.coalesce(exact, bound("<=?")).alias("end"))


def github_rows(landed: DataFrame, payload: str) -> DataFrame:
    """One row for each node: an advisory with the package it names."""
    n = landed.select(F.from_json(F.col(payload), GITHUB).alias("j")).select(F.explode("j.data.securityVulnerabilities.nodes").alias("n")).filter("n.advisory.ghsaId is not null")
    cve = F.get(F.filter("n.advisory.identifiers", lambda i: i["type"] == "CVE"), F.lit(0))["value"]
    ends = range_ends(F.col("n.vulnerableVersionRange"))
    affected = F.array(F.struct(ecosystem(F.col("n.package.ecosystem")).alias("ecosystem"), F.col("n.package.name").alias("name"), ends["start"].alias("version_start"), ends["end"].alias("version_end"), F.col("n.firstPatchedVersion.identifier").alias("fixed_version")))
    return n.select(
        F.coalesce(cve, "n.advisory.ghsaId").alias("id"), F.coalesce(F.nullif("n.advisory.description", F.lit("")), "n.advisory.summary").alias("description"), severity_of(F.col("n.advisory.severity")).alias("severity"),
        F.nullif("n.advisory.cvss.score", F.lit(0.0)).alias("cvss_score"), F.col("n.advisory.cvss.vectorString").alias("cvss_vector"), affected.alias("affected"), F.filter(F.transform("n.advisory.references", lambda r: r["url"]), lambda u: u.isNotNull()).alias("references"), F.lit("github").alias("source"),
    )


def gitlab_rows(landed: DataFrame, payload: str) -> DataFrame:
    """One row for each advisory; the last part of its slug is the package."""
    n = landed.select(F.from_json(F.col(payload), GITLAB).alias("j")).select("j.*").filter("id is not null or identifier is not null or cve is not null")
    slug = F.split("package_slug", "/")
    ends = range_ends(F.get(F.split("affected_range", r"\|\|"), F.lit(0)))
    affected = F.when(F.col("package_slug").isNotNull(), F.array(F.struct(ecosystem(F.get(slug, F.lit(0))).alias("ecosystem"), F.try_element_at(slug, F.lit(-1)).alias("name"), ends["start"].alias("version_start"), ends["end"].alias("version_end"), F.get("fixed_versions", F.lit(0)).alias("fixed_version"))))
    return n.select(
        F.coalesce("cve", "identifier", F.concat(F.lit("GITLAB-"), "id")).alias("id"), F.coalesce(F.nullif("description", F.lit("")), "title").alias("description"), severity_of(F.col("severity")).alias("severity"),
        F.lit(None).cast("double").alias("cvss_score"), F.col("cvss_v3").alias("cvss_vector"), F.coalesce(affected, F.array().cast(affected_type())).alias("affected"), F.coalesce("urls", F.array().cast("array<string>")).alias("references"), F.lit("gitlab").alias("source"),
    )


def affected_type() -> str:
    return "array<struct<ecosystem:string,name:string,version_start:string,version_end:string,fixed_version:string>>"
