"""Queries of the keyed stores: the advisory cache and the package-query cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import stores as S
from riskloom.tables import read

#: The moment that expiry is tested against and that parts early from late queries: the start of 2023 in epoch seconds.
AS_OF = 1_672_531_200


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cve_cache").distinct()


def _queries(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "package_queries")
    second = lambda c: F.when(F.col(c) >= 100_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c)).cast("bigint").alias(c)
    return t.select("id", F.lower("ecosystem").alias("ecosystem"), "package_name", "version", "cve_ids", second("cached_at"), second("expires_at")).distinct()


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What the advisory cache holds for each key after all writes: the row written last."""
    s = S.latest(_cache(spark, d).select("cve_id", "source", "cached_at", "expires_at"), ["cve_id"], ["cached_at", "expires_at", "source"])
    return s.select("cve_id", "source", "cached_at", "expires_at")


def cache_valid(spark: SparkSession, d: str) -> DataFrame:
    return S.valid(cache_upsert(spark, d), AS_OF - 86_400 * 30)


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache_upsert(spark, d).groupBy("source").agg(*S.stats(None, AS_OF - 86_400 * 30))


def package_cache(spark: SparkSession, d: str) -> DataFrame:
    """The package-query cache after all writes: the last answer for each (ecosystem, package, version), where a missing version is a key."""
    s = S.latest(_queries(spark, d).select("ecosystem", "package_name", "version", "id", "cached_at", "expires_at"), ["ecosystem", "package_name", "version"], ["cached_at", "id"])
    return s.select("ecosystem", "package_name", "version", "id", "cached_at")


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered and not answered by the cache: distinct keys of late queries against those before, null-safe."""
    q = _queries(spark, d)
    known = q.filter(F.col("cached_at") <= AS_OF).select(F.col("ecosystem").alias("e"), F.col("package_name").alias("p"), F.col("version").alias("v")).distinct()
    asked = q.filter(F.col("cached_at") > AS_OF).select("ecosystem", "package_name", "version").distinct()
    j = asked.join(known, (F.col("ecosystem") == F.col("e")) & (F.col("package_name") == F.col("p")) & F.col("version").eqNullSafe(F.col("v")), "left")
    return j.groupBy("ecosystem").agg(F.count_if(F.col("e").isNotNull()).alias("hits"), F.count_if(F.col("e").isNull()).alias("misses"))


def events_ttl(spark: SparkSession, d: str) -> DataFrame:
    """First event of each user and kind per day window: what a store with a day's life lets through, by day."""
    t = read(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    day = F.col("ts").cast("date")
    first = t.groupBy("user_id", "event_type", day.alias("day")).agg(F.min("event_id").alias("event_id"))
    return first.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (cache_upsert, cache_valid, cache_stats, package_cache, cache_probe, events_ttl)}

_CACHE = f"select cve_id, source, cached_at, expires_at from (select distinct * from cve_cache) qualify row_number() over (partition by cve_id order by cached_at desc, expires_at desc, source desc) = 1"
_Q = "select distinct id, lower(ecosystem) as ecosystem, package_name, version, cve_ids, case when cached_at >= 100000000000 then cached_at // 1000 else cached_at end as cached_at, case when expires_at >= 100000000000 then expires_at // 1000 else expires_at end as expires_at from package_queries"
_AT = AS_OF - 86_400 * 30
SQL = {
    "cache_upsert": _CACHE,
    "cache_valid": f"select * from ({_CACHE}) where expires_at > {_AT}",
    "cache_stats": f"select source, count(*) as total, count(*) filter (expires_at > {_AT}) as valid, count(*) filter (expires_at <= {_AT}) as expired from ({_CACHE}) group by source",
    "package_cache": f"select ecosystem, package_name, version, id, cached_at from ({_Q}) qualify row_number() over (partition by ecosystem, package_name, version order by cached_at desc, id desc) = 1",
    "cache_probe": f"with q as ({_Q}), a as (select distinct ecosystem, package_name, version from q where cached_at > {AS_OF}), k as (select distinct ecosystem as e, package_name as p, version as v from q where cached_at <= {AS_OF}) select ecosystem, count(*) filter (e is not null) as hits, count(*) filter (e is null) as misses from a left join k on ecosystem = e and package_name = p and version is not distinct from v group by ecosystem",
    "events_ttl": "select day, event_type, count(*) as kept, min(event_id) as first_id from (select user_id, event_type, ts::date as day, min(event_id) as event_id from events group by all) group by day, event_type",
}
