"""Queries of advisory feeds: normalising, choosing, ranking, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions import versions as V
from riskloom.functions.identifiers import SQL_IS_ID, SQL_NORM, normal_form
from riskloom.functions.labels import severity_of, severity_of_score, severity_rank
from riskloom.operators import advisories as A
from riskloom.sources.payloads import with_record
from riskloom.sources.references import with_ids
from riskloom.tables import read


def osv_normalised(spark: SparkSession, d: str) -> DataFrame:
    return A.osv_rows(read(spark, d, "osv_response"))


def osv_affected(spark: SparkSession, d: str) -> DataFrame:
    return A.osv_affected(read(spark, d, "osv_response", "rec_id", "affected"))


def osv_references(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "osv_response", "rec_id", "refs").select("rec_id", F.posexplode("refs").alias("pos", "r"))
    return t.filter("r.url is not null").select("rec_id", "pos", F.col("r.type").alias("kind"), F.col("r.url").alias("url"))


def nvd_normalised(spark: SparkSession, d: str) -> DataFrame:
    """id, first English description, vector, score and severity of each readable record, by the first metric of the
    newest scheme it has (3.1, 3.0, 2); a word for the severity stands before the score's band."""
    t = with_record(read(spark, d, "nvd_cve_log4j", "rec_id", "cve"), "cve")
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    said = F.coalesce(get("_record", "$.descriptions", "array<variant>"), F.array(get("_record", "$.descriptions", "variant")))
    english = get(A.first_where(said, lambda x: get(x, "$.lang") == "en"), "$.value")
    t = t.withColumn("_m", F.coalesce(*(get("_record", f"$.metrics.cvssMetric{v}[0]", "variant") for v in ("V31", "V30", "V2"))))
    score = get("_m", "$.cvssData.baseScore", "double")
    word = severity_of(F.coalesce(get("_m", "$.cvssData.baseSeverity"), get("_m", "$.baseSeverity")))
    return t.filter(get("_record", "$.id").isNotNull()).select(
        "rec_id", get("_record", "$.id").alias("id"), english.alias("description"), get("_m", "$.cvssData.vectorString").alias("cvss_vector"),
        score.alias("cvss_score"), F.when(word != "unknown", word).otherwise(severity_of_score(score)).alias("severity"),
    )


def severity_maps(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the severity a feed writes, what it means, and what the score's band says."""
    t = read(spark, d, "cve", "severity", "cvss_score")
    return t.groupBy("severity", severity_of(F.col("severity")).alias("mapped"), severity_of_score(F.col("cvss_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _cve(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cve")


def cve_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The most complete row of each id as written; ties go to the earlier feed, then the smaller row."""
    rows = _cve(spark, d).withColumn("points", A.completeness())
    return A.keep_best(rows, "id", F.col("points"), "source_seq", "rec_id").select("id", "rec_id", "points")


def cve_sort(spark: SparkSession, d: str) -> DataFrame:
    """The ten gravest rows of each feed: by severity, then by score, then by id."""
    t = _cve(spark, d).filter("source is not null").withColumn("feed", F.lower(F.trim("source"))).withColumn("rank", severity_rank(F.col("severity")))
    score = F.when(F.isnan("cvss_score"), None).otherwise(F.col("cvss_score"))
    w = W.partitionBy("feed").orderBy(F.col("rank").desc(), score.desc_nulls_last(), "id", "rec_id")
    return t.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("feed", "place", "rec_id", "rank")


def feed_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all feeds in one table, by source and severity."""
    a = A.osv_rows(read(spark, d, "osv_response")).select(F.lit("osv").alias("source"), "severity")
    b = _cve(spark, d).select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), severity_of(F.col("severity")).alias("severity"))
    return a.unionByName(b).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"))


def affected_counts(spark: SparkSession, d: str) -> DataFrame:
    """For each package query with a version: how many affected ranges of its package hold that version."""
    deps = read(spark, d, "package_queries", "id", "ecosystem", "package_name", "version").select(F.col("id").alias("dep_id"), F.lower("ecosystem").alias("ecosystem"), F.col("package_name").alias("name"), "version").distinct()
    ranges = A.osv_affected(read(spark, d, "osv_response", "rec_id", "affected"))
    return A.affected_counts(deps, ranges)


def cves_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that a package's queries named at its smallest version and no longer name at its greatest, counted.

    Every row with a version counts for the smallest and the greatest; an empty, missing or unreadable list names nothing.
    """
    t = with_ids(read(spark, d, "package_queries", "package_name", "version", "cve_ids").filter("version is not null"), "cve_ids", "ids")
    t = t.select("package_name", V.plain_key(F.col("version")).alias("k"), "ids")
    ends = t.groupBy("package_name").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi")
    both = t.join(ends, "package_name").filter("k = lo or k = hi").select("package_name", (F.col("k") == F.col("lo")).alias("old"), F.explode("ids").alias("x"))
    both = both.select("package_name", "old", normal_form(F.col("x")).alias("cve_id")).filter("cve_id is not null").distinct()
    old, new = both.filter("old").drop("old"), both.filter("not old").drop("old")
    return old.join(new, ["package_name", "cve_id"], "left_anti").groupBy("package_name").agg(F.count(F.lit(1)).alias("fixed"))


def osv_range_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ranges by whether they start, end and hold anything at all."""
    r = osv_affected(spark, d)
    empty = F.coalesce(V.plain_key(F.col("introduced")) >= V.plain_key(F.col("fixed")), F.lit(False))
    return r.groupBy("ecosystem", F.col("introduced").isNotNull().alias("starts"), F.col("fixed").isNotNull().alias("ends"), empty.alias("empty")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (osv_normalised, osv_affected, osv_references, nvd_normalised, severity_maps, cve_dedup, cve_sort, feed_union, affected_counts, cves_fixed, osv_range_ends)}

_SEV = "case lower(trim({0})) when 'moderate' then 'medium' when 'critical' then 'critical' when 'high' then 'high' when 'medium' then 'medium' when 'low' then 'low' when 'none' then 'none' when 'info' then 'none' else 'unknown' end"
_BAND = "case when {0} is null or isnan({0}) then 'unknown' when {0} >= 9 then 'critical' when {0} >= 7 then 'high' when {0} >= 4 then 'medium' when {0} > 0 then 'low' else 'none' end"
_VECTOR = "list_filter(coalesce(severity, []), lambda s: starts_with(s.type, 'CVSS'))[1].score"
_OSV = f"""select rec_id, coalesce(list_filter(coalesce(aliases, []), lambda a: starts_with(a, 'CVE-'))[1], id) as id, coalesce(nullif(details, ''), summary) as description,
 case when {_VECTOR} is not null then 'medium' else {_SEV.format('database_specific.severity')} end as severity, case when {_VECTOR} is not null then 5.0::double end as cvss_score, {_VECTOR} as cvss_vector,
 coalesce(len(list_filter(affected, lambda a: a.package.name is not null)), 0)::int as n_affected, coalesce(len(list_filter(refs, lambda r: r.url is not null)), 0)::int as n_references from osv_response"""
_EVENT = "list_filter(r.events, lambda e: e.{0} is not null)[-1].{0}"
_AFFECTED = f"""select rec_id, entry, ecosystem, name, {_EVENT.format('introduced')} as introduced, {_EVENT.format('fixed')} as fixed, {_EVENT.format('last_affected')} as last_affected from (
 select rec_id, entry, lower(a.package.ecosystem) as ecosystem, a.package.name as name, unnest(case when len(list_filter(a.ranges, lambda r: r is not null)) > 0 then list_filter(a.ranges, lambda r: r is not null) when len(a.versions) > 0 then [null] else [] end) as r
 from (select rec_id, unnest(affected) as a, (generate_subscripts(affected, 1) - 1)::int as entry from osv_response) where a.package.name is not null)"""
_POINTS = "(case when coalesce(description, '') <> '' then 10 else 0 end + case when cvss_score is not null then 10 else 0 end + case when coalesce(cvss_vector, '') <> '' then 5 else 0 end + case when len(affected_packages) > 0 then 10 else 0 end + case when len(reference_urls) > 0 then 5 else 0 end + case when published_date is not null then 5 else 0 end + case when modified_date is not null then 5 else 0 end)"
_RANK = "case lower(severity) when 'none' then 1 when 'low' then 2 when 'medium' then 3 when 'high' then 4 when 'critical' then 5 else 0 end"
_TRIMMED = "lower(trim(source))"
_JSON = "case when json_valid(cve) then case when json_type(cve) = 'VARCHAR' then case when json_valid(json_extract_string(cve, '$')) then json(json_extract_string(cve, '$')) end else json(cve) end end"
SQL_NVD = f"select rec_id, case when json_type(v) = 'OBJECT' then coalesce(v -> '$.vulnerabilities[0].cve', v -> '$.cve', v) end as r from (select rec_id, {_JSON} as v from nvd_cve_log4j)"
_WORD = _SEV.format("coalesce(m ->> '$.cvssData.baseSeverity', m ->> '$.baseSeverity')")
SQL = {
    "nvd_normalised": f"""with n as ({SQL_NVD}), x as (select rec_id, r, case json_type(r -> '$.descriptions') when 'ARRAY' then json_extract(r, '$.descriptions[*]') when 'OBJECT' then [r -> '$.descriptions'] else [] end as ds,
 coalesce(r -> '$.metrics.cvssMetricV31[0]', r -> '$.metrics.cvssMetricV30[0]', r -> '$.metrics.cvssMetricV2[0]') as m from n where (r ->> '$.id') is not null), y as (select *, try_cast(m ->> '$.cvssData.baseScore' as double) as score, {_WORD} as word from x)
 select rec_id, r ->> '$.id' as id, list_filter(ds, lambda e: (e ->> '$.lang') = 'en')[1] ->> '$.value' as description, m ->> '$.cvssData.vectorString' as cvss_vector, score as cvss_score, case when word <> 'unknown' then word else {_BAND.format('score')} end as severity from y""",
    "osv_normalised": _OSV,
    "osv_affected": _AFFECTED,
    "osv_references": "select rec_id, pos, r.type as kind, r.url as url from (select rec_id, unnest(refs) as r, (generate_subscripts(refs, 1) - 1)::int as pos from osv_response) where r.url is not null",
    "severity_maps": f"select severity, {_SEV.format('severity')} as mapped, {_BAND.format('cvss_score')} as band, count(*) as n from cve group by all",
    "cve_dedup": f"select id, rec_id, points from (select id, rec_id, source_seq, {_POINTS} as points from cve) qualify row_number() over (partition by id order by points desc, source_seq nulls first, rec_id) = 1",
    "cve_sort": f"select feed, place, rec_id, rank from (select {_TRIMMED} as feed, rec_id, {_RANK} as rank, row_number() over (partition by {_TRIMMED} order by {_RANK} desc, (case when isnan(cvss_score) then null else cvss_score end) desc nulls last, id, rec_id) as place from cve where source is not null) where place <= 10",
    "feed_union": f"select source, severity, count(*) as n from (select 'osv' as source, severity from ({_OSV}) union all select coalesce({_TRIMMED}, ''), {_SEV.format('severity')} from cve) group by all",
    "affected_counts": f"""with deps as (select distinct id as dep_id, lower(ecosystem) as ecosystem, package_name as name, version, {V.sql_plain_key('version')} as k from package_queries where version is not null),
 ranges as (select ecosystem, name, {V.sql_plain_key("coalesce(introduced, '0')")} as s, {V.sql_plain_key('fixed')} as e from ({_AFFECTED}))
 select dep_id, count(s) as advisories from deps left join ranges on deps.ecosystem = ranges.ecosystem and deps.name = ranges.name and s <= k and (e is null or k < e) group by dep_id, deps.ecosystem, deps.name, version""",
    "cves_fixed": rf"""with t as (select package_name, {V.sql_plain_key('version')} as k, trim(cve_ids) as w from package_queries where version is not null),
 ends as (select package_name, min(k) as lo, max(k) as hi from t group by package_name having min(k) < max(k)),
 j as (select package_name, k = lo as old, w, regexp_matches(w, '^[\[{{"]') as jsonish, case when regexp_matches(w, '^[\[{{"]') and json_valid(w) then case when json_type(w) = 'VARCHAR' then case when json_valid(json_extract_string(w, '$')) then json(json_extract_string(w, '$')) end else json(w) end end as v from t join ends using (package_name) where k = lo or k = hi),
 ids as (select package_name, old, unnest(case when w is null then [] when not jsonish then string_split_regex(w, '[,;|]') when v is null then [] else list_transform(json_extract(v, '$[*]'), lambda e: coalesce(e ->> '$.id', e ->> '$')) end) as x from j),
 pairs as (select distinct package_name, old, {SQL_NORM} as cve_id from ids where x is not null and {SQL_IS_ID})
 select package_name, count(*) as fixed from pairs o where old and not exists (select 1 from pairs n where not n.old and n.package_name = o.package_name and n.cve_id = o.cve_id) group by package_name""",
    "osv_range_ends": f"select ecosystem, introduced is not null as starts, fixed is not null as ends, coalesce({V.sql_plain_key('introduced')} >= {V.sql_plain_key('fixed')}, false) as empty, count(*) as n from ({_AFFECTED}) group by all",
}
