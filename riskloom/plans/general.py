"""Queries of the general data-processing operators (p1, p3, p5) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.orphans import INCREMENTS, OrphanState, pending, replay, snapshot
from riskloom.operators.shred import entities, shred
from riskloom.operators.timestamps import USUAL_LAG_US, candidate_zones, estimate_zones, with_instants
from riskloom.functions import timestamps as T
from riskloom.functions.identifiers import SQL_IS_ID, SQL_NORM
from riskloom.sources.payloads import with_record
from riskloom.sources.references import cache_entries, finding_references, query_references
from riskloom.session import Cuts, bounded
from riskloom.tables import read


def ntz_micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone that holds UTC, whatever zone the session has."""
    c = F.col(name)
    return (
        F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
        + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
        + F.floor(F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    )


def timestamp_rows(spark: SparkSession, d: str) -> DataFrame:
    """source_table, rec_id, origin, text, ingest_us of the four tables."""
    def rows(name: str, text: Column, column: str, at: str) -> DataFrame:
        t = read(spark, d, name, "rec_id", "origin", column, at)
        if column == "cve":
            t = with_record(t, column)
        return t.select(F.lit(name).alias("source_table"), "rec_id", "origin", text.alias("text"), ntz_micros(at).alias("ingest_us"))

    return (
        rows("nvd_cve_log4j", F.try_variant_get("_record", "$.published", "string"), "cve", "fetched_at")
        .unionByName(rows("osv_response", F.col("published"), "published", "fetched_at"))
        .unionByName(rows("gitlab_mr_renovate", F.col("created_at"), "created_at", "received_at"))
        .unionByName(rows("github_pr_dependabot", F.col("created_at"), "created_at", "received_at"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = timestamp_rows(spark, d)
    out = with_instants(rows, "text", "origin", F.col("ingest_us"), read(spark, d, "feed_origin"))
    return out.filter("_ts_utc is not null").select("source_table", "rec_id", F.col("_ts_utc").alias("utc_micros"))


def p1_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone of every origin as estimated from its local timestamps and their times of ingestion, beside the declared one."""
    feeds = read(spark, d, "feed_origin")
    rows = timestamp_rows(spark, d).filter("origin is not null")
    declared = feeds.select(F.col("origin").alias("_o"), "tz_name", "day_order").dropDuplicates(["_o"])
    rows = rows.join(bounded(declared), rows["origin"] == F.col("_o"), "left")
    rows = rows.withColumn("_r", T.read_texts(F.col("text"), F.coalesce("day_order", F.lit("ymd"))))
    # what the usual delay is, the rows that carry their zone tell: twice their median
    sure = rows.filter("_r.offset_min is not null").select((F.col("ingest_us") - F.col("_r.local_us") + F.col("_r.offset_min") * 60_000_000).alias("lag"))
    usual = sure.filter("lag >= 0").agg(F.percentile_approx("lag", 0.5).alias("m")).first()["m"]
    local = rows.filter("_r.local_us is not null and _r.offset_min is null and _r.region is null")
    found = estimate_zones(local.select(F.col("origin").alias("_ts_origin"), F.col("_r.local_us").alias("local_us"), "ingest_us"), candidate_zones(feeds), 2 * usual if usual else USUAL_LAG_US)
    return found.join(bounded(declared), found["_ts_origin"] == F.col("_o"), "left").select(
        F.col("_ts_origin").alias("origin"), F.col("_ts_zone").alias("estimated"), F.col("tz_name").alias("declared"), "violations", "n"
    )


def orphan_state(spark: SparkSession, d: str, snapshots: bool = False) -> tuple[OrphanState, DataFrame | None]:
    refs = query_references(read(spark, d, "package_queries", "id", "cve_ids", "cached_at")).unionByName(
        finding_references(read(spark, d, "reachability", "rec_id", "cve_id", "analyzed_at"), F.floor(ntz_micros("analyzed_at") / 1_000_000).cast("bigint"))
    )
    return replay(refs, cache_entries(read(spark, d, "cve_cache", "cve_id", "cached_at", "deleted_at")), snapshots=snapshots)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The orphans after the last of several increments of references, stored and deleted entries."""
    return pending(orphan_state(spark, d)[0])


def p3_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(orphan_state(spark, d)[0])


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    """Pending orphans after each increment, as they stood then."""
    return orphan_state(spark, d, True)[1]


def nvd_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency table of the references and weaknesses in nvd_cve_log4j."""
    t = read(spark, d, "nvd_cve_log4j", "rec_id", "cve")
    return shred(t.select(F.lit("nvd_cve_log4j").alias("source_table"), "rec_id", F.col("cve").alias("payload")), ["references", "weaknesses"], ["url", "type"])


def osv_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency table of the affected entries in osv_response, whole: packages, ranges, their events, versions."""
    t = read(spark, d, "osv_response", "rec_id", "affected")
    payload = F.to_json(F.struct("affected"), {"ignoreNullFields": "false"})
    return shred(t.select(F.lit("osv_response").alias("source_table"), "rec_id", payload.alias("payload")), ["affected"], ["type", "ranges", "ecosystem", "name", "introduced", "fixed", "last_affected", "versions"])


def affected_ranges(osv: DataFrame) -> DataFrame:
    """source_table, rec_id, node, parent_pos, pos, type: ranges with the place of their affected entry."""
    owners = osv.filter("label = 'affected' and kind = 'object'").select("source_table", "rec_id", F.col("node").alias("parent"), F.col("ordinal").alias("parent_pos"))
    return entities(osv, ["ranges"], ["type"]).join(owners, ["source_table", "rec_id", "parent"]).select("source_table", "rec_id", "node", "parent_pos", "pos", "type")


def p5_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the ranges in osv_response with the places of range and affected entry: the level below those of ``p5_found``."""
    osv = Cuts(spark, "nodes").cut(osv_nodes(spark, d))
    ranges = affected_ranges(osv).select("rec_id", F.col("node").alias("parent"), "parent_pos", F.col("pos").alias("range_pos"))
    events = entities(osv, ["events"], ["introduced", "fixed", "last_affected"]).filter("coalesce(introduced, fixed, last_affected) is not null")
    return events.join(ranges, ["rec_id", "parent"]).select("rec_id", F.col("parent_pos").alias("affected_pos"), "range_pos", "pos", "introduced", "fixed", "last_affected")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nvd, osv = nvd_nodes(spark, d), osv_nodes(spark, d)
    zero = F.lit(0).cast("bigint")
    lists = entities(nvd, ["references", "weaknesses"], ["url", "type"], bare={"references": "url"})
    is_ref = F.col("label") == "references"
    flat = lists.select("source_table", "rec_id", F.when(is_ref, "reference").otherwise("weakness").alias("child"), zero.alias("parent_pos"), "pos", F.when(is_ref, F.col("url")).otherwise(F.col("type")).alias("val"))
    ranges = affected_ranges(osv).select("source_table", "rec_id", F.lit("range").alias("child"), "parent_pos", "pos", F.col("type").alias("val"))
    out = flat.unionByName(ranges)
    return out.filter("val is not null and val <> ''")


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p3_found": p3_found, "p3_snapshot": p3_snapshot, "p3_history": p3_history, "p5_found": p5_found, "p5_events": p5_events}

_P3 = rf"""with q as (select id, case when cached_at >= 100000000000 then cached_at // 1000 else cached_at end as t, trim(cve_ids) as w from package_queries where cve_ids is not null),
 j as (select id, t, w, regexp_matches(w, '^[\[{{"]') as jsonish, case when regexp_matches(w, '^[\[{{"]') and json_valid(w) then case when json_type(w) = 'VARCHAR' then case when json_valid(json_extract_string(w, '$')) then json(json_extract_string(w, '$')) end else json(w) end end as v from q),
 ids as (select id, t, unnest(case when not jsonish then string_split(w, ',') when v is null then [] else list_transform(json_extract(v, '$[*]'), lambda e: coalesce(e ->> '$.id', e ->> '$')) end) as x from j),
 refs as (select distinct 'package_queries' as ref_table, id as ref_id, {SQL_NORM} as cve_id, t from ids where x is not null and {SQL_IS_ID}
 union select 'reachability', rec_id, {SQL_NORM}, epoch_us(analyzed_at) // 1000000 from (select *, cve_id as x from reachability) where x is not null and {SQL_IS_ID}),
 parents as (select {SQL_NORM} as cve_id, cached_at, deleted_at from (select *, cve_id as x from cve_cache) where {SQL_IS_ID}),
 judged as (select ref_table, ref_id, r.cve_id, t, count(p.cve_id) as n, count(*) filter (cached_at <= t and (deleted_at is null or deleted_at > t)) as live, count(*) filter (cached_at > t) as later from refs r left join parents p on r.cve_id = p.cve_id group by all),
 found as (select distinct ref_table, ref_id, cve_id, strftime(make_timestamp(t * 1000000), '%Y-%m') as period, case when n = 0 then 'missing' when later > 0 then 'late' else 'deleted' end as reason from judged where live = 0)"""
_RECORD = "case when json_type(v) = 'OBJECT' then coalesce(v -> '$.vulnerabilities[0].cve', v -> '$.cve', v) end"
_LIST = "case json_type(l) when 'ARRAY' then json_extract(l, '$[*]') when 'OBJECT' then [l] when 'VARCHAR' then [l] else [] end"
_CHILD = "(select rec_id, child, unnest(es) as e, unnest(generate_series(1, len(es))) - 1 as pos from (select rec_id, child, " + _LIST + " as es from (select rec_id, 'reference' as child, r -> '$.references' as l from r union all select rec_id, 'weakness', r -> '$.weaknesses' from r)))"
SQL: dict[str, str] = {
    "p3_found": f"{_P3} select * from found",
    "p3_snapshot": f"{_P3} select ref_table, period, reason, count(*) as orphans from found group by all",
    "p3_history": f"""{_P3.rsplit("judged as", 1)[0].rstrip().rstrip(",")}, span as (select min(cached_at) as a, max(cached_at) as b from parents),
 ends as (select i, case when i = {INCREMENTS} then 9223372036854775807 else a + (b - a) * i // {INCREMENTS} end as upto from span, generate_series(1, {INCREMENTS}) as g(i)),
 judged as (select i, ref_table, ref_id, r.cve_id, t, count(p.cve_id) as n, count(*) filter (cached_at <= t and (deleted_at is null or deleted_at > t)) as live, count(*) filter (cached_at > t) as later
 from ends join refs r on t <= upto left join parents p on r.cve_id = p.cve_id and cached_at <= upto group by all)
 select i::int as increment, ref_table, strftime(make_timestamp(t * 1000000), '%Y-%m') as period, case when n = 0 then 'missing' when later > 0 then 'late' else 'deleted' end as reason, count(distinct (ref_id, cve_id)) as orphans from judged where live = 0 group by all""",
    "p5_found": f"""with j as (select rec_id, case when json_valid(cve) then case when json_type(cve) = 'VARCHAR' then case when json_valid(json_extract_string(cve, '$')) then json(json_extract_string(cve, '$')) end else json(cve) end end as v from nvd_cve_log4j),
 r as (select rec_id, {_RECORD} as r from j),
 lists as (select 'nvd_cve_log4j' as source_table, rec_id, child, 0 as parent_pos, pos, case when child = 'reference' then case when json_type(e) = 'VARCHAR' then e ->> '$' when json_type(e -> '$.url') = 'VARCHAR' then e ->> '$.url' end when json_type(e -> '$.type') = 'VARCHAR' then e ->> '$.type' end as val from {_CHILD}),
 a as (select rec_id, unnest(affected) as a, unnest(generate_series(1, len(affected))) - 1 as parent_pos from osv_response),
 ranges as (select rec_id, parent_pos, unnest(a.ranges) as g, unnest(generate_series(1, len(a.ranges))) - 1 as pos from a)
 select * from lists where val <> '' union all select 'osv_response', rec_id, 'range', parent_pos, pos, g.type from ranges where g.type <> ''""",
    "p5_events": """with a as (select rec_id, unnest(affected) as a, unnest(generate_series(1, len(affected))) - 1 as affected_pos from osv_response),
 r as (select rec_id, affected_pos, unnest(a.ranges) as r, unnest(generate_series(1, len(a.ranges))) - 1 as range_pos from a),
 e as (select rec_id, affected_pos, range_pos, unnest(r.events) as e, unnest(generate_series(1, len(r.events))) - 1 as pos from r)
 select rec_id, affected_pos, range_pos, pos, e.introduced, e.fixed, e.last_affected from e where coalesce(e.introduced, e.fixed, e.last_affected) is not null""",
}
