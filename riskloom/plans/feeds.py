"""Queries of forge feeds: the advisories of the cve table, landed in the shape of each forge and read by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.advisories import _SEV
from riskloom.sources import feeds
from riskloom.tables import read


def _range(start, end, between: str):
    return F.concat_ws(between, F.when(start != "", F.concat(F.lit(">="), start)), F.when(end != "", F.concat(F.lit("<"), end)))


def _counted(rows: DataFrame) -> DataFrame:
    first = F.get("affected", F.lit(0))
    return rows.groupBy("source", first["ecosystem"].alias("ecosystem"), "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count(F.nullif(first["version_start"], F.lit(""))).alias("starts"), F.count(F.nullif(first["version_end"], F.lit(""))).alias("ends"), F.count(first["fixed_version"]).alias("fixed"), F.sum(F.size("references")).alias("urls"),
    )


def github_feed(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "cve", "id", "description", "severity", "cvss_score", "cvss_vector", "affected_packages", "reference_urls").filter("id is not null")
    advisory = F.struct(
        F.col("id").alias("ghsaId"), F.col("description"), F.col("severity"), F.struct(F.nullif("cvss_score", F.lit(float("nan"))).alias("score"), F.col("cvss_vector").alias("vectorString")).alias("cvss"),
        F.transform("reference_urls", lambda u: F.struct(u.alias("url"))).alias("references"), F.array(F.struct(F.lit("GHSA").alias("type"), F.col("id").alias("value"))).alias("identifiers"),
    )
    node = lambda p: F.struct(
        advisory.alias("advisory"), F.struct(F.upper(p["ecosystem"]).alias("ecosystem"), p["name"].alias("name")).alias("package"), _range(p["version_start"], p["version_end"], ", ").alias("vulnerableVersionRange"), F.struct(p["fixed_version"].alias("identifier")).alias("firstPatchedVersion"),
    )
    nodes = F.transform(F.filter("affected_packages", lambda p: p.isNotNull()), node)
    landed = t.select(F.to_json(F.struct(F.struct(F.struct(nodes.alias("nodes")).alias("securityVulnerabilities")).alias("data"))).alias("payload"))
    return _counted(feeds.github_rows(landed, "payload"))


def gitlab_feed(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "cve", "id", "description", "severity", "cvss_vector", "affected_packages", "reference_urls").filter("id is not null")
    t = t.select("*", F.explode(F.filter("affected_packages", lambda p: p.isNotNull() & p["ecosystem"].isNotNull() & p["name"].isNotNull())).alias("p"))
    landed = t.select(F.to_json(F.struct(
        F.col("id"), F.col("id").alias("cve"), F.col("description"), F.col("severity"), F.col("cvss_vector").alias("cvss_v3"), F.concat_ws("/", F.lower("p.ecosystem"), "p.name").alias("package_slug"),
        F.concat(_range(F.col("p.version_start"), F.col("p.version_end"), ","), F.lit("||=0.0.0")).alias("affected_range"), F.when(F.col("p.fixed_version").isNotNull(), F.array("p.fixed_version")).alias("fixed_versions"), F.col("reference_urls").alias("urls"),
    )).alias("payload"))
    return _counted(feeds.gitlab_rows(landed, "payload"))


QUERIES = {"github_feed": github_feed, "gitlab_feed": gitlab_feed}
_ROWS = "select id, severity, reference_urls, unnest(affected_packages) as p from cve where id is not null"
_COUNTS = f"lower(p.ecosystem) as ecosystem, {_SEV.format('severity')} as severity, count(*) as n, count(distinct id) as ids, count(nullif(p.version_start, '')) as starts, count(nullif(p.version_end, '')) as ends, count(p.fixed_version) as fixed"
SQL = {
    "github_feed": f"select 'github' as source, {_COUNTS}, sum(len(list_filter(reference_urls, lambda u: u is not null)))::bigint as urls from ({_ROWS}) where p is not null group by all",
    "gitlab_feed": f"select 'gitlab' as source, {_COUNTS}, sum(coalesce(len(reference_urls), 0))::bigint as urls from ({_ROWS}) where p.ecosystem is not null and p.name is not null group by all",
}
