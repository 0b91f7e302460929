"""Advisory feeds to one shape, the best row of each advisory, and dependencies against affected ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.labels import severity_of, severity_of_score
from riskloom.functions.versions import plain_key, range_key

#: Score of an entry that has a vector but whose score isn't computed.
VECTOR_SCORE = 5.0


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def osv_rows(osv: DataFrame) -> DataFrame:
    """rec_id, id, description, severity, cvss_score, cvss_vector, n_affected, n_references of each record.

    id: the first alias that is a CVE, else the record's own. A CVSS entry stands before the database's word.
    """
    alias = first_where(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.startswith("CVE-"))
    vector = first_where(F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>")), lambda s: s["type"].startswith("CVSS"))["score"]
    score = F.when(vector.isNotNull(), F.lit(VECTOR_SCORE))
    return osv.select(
        "rec_id", F.coalesce(alias, "id").alias("id"), F.coalesce(F.nullif("details", F.lit("")), "summary").alias("description"),
        F.when(vector.isNotNull(), severity_of_score(score)).otherwise(severity_of(F.col("database_specific.severity"))).alias("severity"),
        score.alias("cvss_score"), vector.alias("cvss_vector"),
        F.coalesce(F.size(F.filter("affected", lambda a: a["package"]["name"].isNotNull())), F.lit(0)).alias("n_affected"),
        F.coalesce(F.size(F.filter("refs", lambda r: r["url"].isNotNull())), F.lit(0)).alias("n_references"),
    )


def last_event(events: Column, field: str) -> Column:
    """The value of the last event that has ``field``."""
    return F.try_element_at(F.filter(events, lambda e: e[field].isNotNull()), F.lit(-1))[field]


def osv_affected(osv: DataFrame) -> DataFrame:
    """rec_id, entry, ecosystem, name, introduced, fixed, last_affected: one row for each range of an affected entry.

    An entry without ranges but with versions gives one open row.
    """
    e = osv.select("rec_id", F.posexplode("affected").alias("entry", "a")).filter("a.package.name is not null")
    e = e.select("rec_id", "entry", F.lower("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), F.col("a.versions").alias("versions"), F.filter("a.ranges", lambda r: r.isNotNull()).alias("ranges"))
    r = e.select("*", F.explode_outer("ranges").alias("r")).filter("r is not null or size(versions) > 0")
    ev = F.col("r.events")
    return r.select("rec_id", "entry", "ecosystem", "name", last_event(ev, "introduced").alias("introduced"), last_event(ev, "fixed").alias("fixed"), last_event(ev, "last_affected").alias("last_affected"))


def completeness() -> Column:
    """Points for what an advisory row tells."""
    has = lambda c: (F.col(c).isNotNull()) & (F.col(c) != "")
    parts = [
        F.when(has("description"), 10), F.when(F.col("cvss_score").isNotNull(), 10), F.when(has("cvss_vector"), 5), F.when(F.size("affected_packages") > 0, 10),
        F.when(F.size("reference_urls") > 0, 5), F.when(F.col("published_date").isNotNull(), 5), F.when(F.col("modified_date").isNotNull(), 5),
    ]
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return total


def keep_best(rows: DataFrame, key: str, score: Column, *ties: str) -> DataFrame:
    """One row for each key: the highest score, then the smallest ``ties``. Spark keeps one row a task before the shuffle."""
    order = W.partitionBy(key).orderBy(score.desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def affected_counts(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """dep_id, advisories: in how many ranges (ecosystem, name, introduced, fixed) the dependency's version lies.

    ``dependencies``: dep_id, ecosystem, name, version. Pairs are never formed: starts and ends of ranges and the
    versions are put in one order, and the number of ranges a version lies in is a running sum of +1 and -1. It runs
    over distinct versions within (package, major version), with the sum of all smaller majors from a table of one row
    each, and is joined back to the dependencies, so that a package with a great part of all rows costs no more than
    its versions. An open end never closes; an empty range holds nothing.
    """
    start, end = plain_key(F.coalesce("introduced", F.lit("0"))), plain_key("fixed")
    marks = ranges.filter("ecosystem is not null and name is not null").select("ecosystem", "name", start.alias("s"), end.alias("e"))
    marks = marks.filter(F.col("e").isNull() | (F.col("s") < F.col("e")))
    step = F.explode(F.array(F.struct(F.col("s").alias("k"), F.lit(1).alias("d")), F.struct(F.col("e").alias("k"), F.lit(-1).alias("d"))))
    steps = marks.select("ecosystem", "name", step.alias("x")).filter("x.k is not null").groupBy("ecosystem", "name", F.col("x.k").alias("k")).agg(F.sum("x.d").alias("d"))
    asked = dependencies.filter("version is not null").select("dep_id", "ecosystem", "name", "version")
    versions = asked.select("ecosystem", "name", "version").distinct().withColumn("k", plain_key(F.col("version"))).withColumn("d", F.lit(0).cast("bigint"))
    rows = steps.select("ecosystem", "name", F.lit(None).cast("string").alias("version"), "k", "d").unionByName(versions)
    rows = rows.withColumn("major", F.coalesce(F.get("k", F.lit(0)), F.lit(-1).cast("bigint")))
    majors = rows.groupBy("ecosystem", "name", "major").agg(F.sum("d").alias("m"))
    before = W.partitionBy("ecosystem", "name").orderBy("major").rowsBetween(W.unboundedPreceding, -1)
    majors = majors.select("ecosystem", "name", "major", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("carry"))
    upto = W.partitionBy("ecosystem", "name", "major").orderBy("k").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("n", F.sum("d").over(upto)).filter("version is not null").join(majors, ["ecosystem", "name", "major"])
    found = out.select(F.col("ecosystem").alias("_e"), F.col("name").alias("_n"), F.col("version").alias("_v"), (F.col("n") + F.col("carry")).alias("advisories"))
    same = asked["ecosystem"].eqNullSafe(found["_e"]) & asked["name"].eqNullSafe(found["_n"]) & (asked["version"] == found["_v"])
    return asked.join(found, same, "left").select("dep_id", F.coalesce("advisories", F.lit(0).cast("bigint")).alias("advisories"))


__all__ = ["affected_counts", "completeness", "keep_best", "last_event", "osv_affected", "osv_rows", "range_key"]
