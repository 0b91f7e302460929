"""Timestamps of many formats and zones to one UTC instant in microseconds.

Method: a text that carries no zone is local time of its origin. The zone of an origin is estimated by aligning its
local timestamps with the times at which the rows were ingested; an origin whose zone is declared has this one as its
only candidate, any other all of the table: each candidate zone (a whole offset history, daylight-saving changes included) is charged one violation
for every row that would have been written after it was ingested or implausibly long before, and the history with
the fewest violations wins. Then the local time is converted.

Defined results: null, empty, blank and unreadable texts, impossible dates, times and offsets and unknown zone names
give no instant; a null origin is UTC with order ``ymd``; repeated rows each give their own row; an empty table gives
an empty result; further columns are kept by ``with_instants`` and its own names start with ``_ts_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import timestamps as T
from riskloom.session import Cuts, bounded, spread

#: A row is ingested within this time of its timestamp in the usual case; later rows count as violations.
USUAL_LAG_US = 2 * 3_600_000_000


def declared_zones(feeds: DataFrame) -> DataFrame:
    """One row ``_ts_origin, _ts_home, _ts_order`` for each origin, even if the table repeats one."""
    return (
        feeds.filter(F.col("origin").isNotNull())
        .groupBy(F.col("origin").alias("_ts_origin"))
        .agg(F.min("tz_name").alias("_ts_home"), F.min("day_order").alias("_ts_order"))
    )


def candidate_zones(feeds: DataFrame, default_zone: str = "UTC") -> list[str]:
    """The zones that origins may have: those of the table that the JVM knows (it knows some six hundred, which bounds the list)."""
    known = F.split(F.lit(",".join(T.zone_names(feeds.sparkSession))), ",")
    return sorted({r[0] for r in feeds.select("tz_name").filter(F.array_contains(known, F.col("tz_name"))).distinct().collect()} | {default_zone})


def estimate_zones(rows: DataFrame, candidates: list[str], usual_lag_us: int = USUAL_LAG_US) -> DataFrame:
    """Zone of each origin by least violations.

    ``rows``: ``_ts_origin``, ``local_us`` (texts without a zone only), ``ingest_us``, and ``zones`` where an origin has
    candidates of its own (a declared one has a single one). Result: ``_ts_origin``, ``_ts_zone``, ``violations``,
    ``n``; ties go to the smaller total delay, then to the name. Rows of one origin, quarter of an hour and delay in whole
    minutes are counted together first, as zones change at quarters and their offsets are whole minutes; each such group
    is charged once to every candidate, so there is no limit to these, and sums meet in the map step.
    """
    bare = rows.filter("local_us is not null and ingest_us is not null and _ts_origin is not null")
    zones = F.col("zones") if "zones" in rows.columns else F.array(*map(F.lit, candidates))
    quarter, minute = 900_000_000, 60_000_000
    delay = F.floor((F.col("ingest_us") - F.col("local_us")) / minute).cast("bigint")
    groups = bare.groupBy("_ts_origin", zones.alias("zones"), F.floor(F.col("local_us") / quarter).cast("bigint").alias("q"), delay.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    each = groups.select("_ts_origin", "q", "d", "n", F.explode("zones").alias("zone"))
    local = F.col("q") * quarter
    lag = F.col("d") + ((local - T.to_utc_micros(local, F.col("zone"))) / minute).cast("bigint")
    bad = (F.col("lag") < 0) | (F.col("lag") > usual_lag_us // minute)
    found = each.withColumn("lag", lag).groupBy("_ts_origin", "zone").agg(
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("v"), F.sum(F.when(bad, 0).otherwise(F.col("lag") * F.col("n"))).alias("l"), F.sum("n").alias("n")
    )
    best = found.groupBy("_ts_origin").agg(F.min(F.struct("v", "l", "zone")).alias("_b"), F.max("n").alias("n"))
    return best.select("_ts_origin", F.col("_b.zone").alias("_ts_zone"), F.col("_b.v").alias("violations"), "n")


def with_instants(df: DataFrame, text: str, origin: str, ingested: Column | None, feeds: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """``df`` with ``_ts_utc`` (microseconds since 1970 UTC, null if the text names no instant)."""
    declared = bounded(declared_zones(feeds))
    base = spread(df).withColumn("_ts_origin", F.col(origin)).join(declared, "_ts_origin", "left")
    ingest = F.lit(None).cast("bigint") if ingested is None else ingested
    base = base.withColumn("_ts_ingest", ingest).withColumn("_ts_read", T.read_texts(F.col(text), F.coalesce("_ts_order", F.lit("ymd"))))
    base = base.withColumns({f"_ts_{b}": F.col(f"_ts_read.{a}") for a, b in (("count_us", "count"), ("local_us", "local"), ("offset_min", "offset"), ("region", "region"))})
    zone = F.coalesce("_ts_home", F.lit(default_zone))
    bare = F.col("_ts_offset").isNull() & F.col("_ts_region").isNull() & F.col("_ts_count").isNull()
    if ingested is not None:
        # texts are read once, for the estimate and for the conversion; a declared origin has its zone as the only candidate
        base = Cuts(df.sparkSession, "instants").cut(base.drop("_ts_read"))
        every = F.split(F.lit(",".join(candidate_zones(feeds, default_zone))), ",")
        zones = F.when(F.col("_ts_home").isNotNull(), F.array("_ts_home")).otherwise(every)
        rows = base.filter(bare).select("_ts_origin", F.col("_ts_local").alias("local_us"), F.col("_ts_ingest").alias("ingest_us"), zones.alias("zones"))
        guess = estimate_zones(rows, []).select("_ts_origin", F.col("_ts_zone").alias("_ts_guess"))
        base = base.join(bounded(guess), "_ts_origin", "left")
        zone = F.coalesce("_ts_guess", "_ts_home", F.lit(default_zone))
    names = T.zone_names(df.sparkSession)
    region, local = F.col("_ts_region"), F.col("_ts_local")
    known = F.array_contains(F.split(F.lit(",".join(names)), ","), region)  # folded to one constant
    by_zone = F.when(region.isNull(), zone).when(known, region)
    base = base.withColumn("_ts_by", F.when(F.col("_ts_offset").isNull(), by_zone))
    utc = (
        F.when(F.col("_ts_count").isNotNull(), F.col("_ts_count"))
        .when(F.col("_ts_offset").isNotNull(), local - F.col("_ts_offset") * 60_000_000)
        .otherwise(T.to_utc_micros(local, F.col("_ts_by")))
    )
    return base.withColumn("_ts_utc", utc).select(*df.columns, "_ts_utc")
