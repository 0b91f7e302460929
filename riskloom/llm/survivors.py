"""Best representative of each duplicate group, field by field.

Every record is ranked for every field: usable values first by trust, then by recency, then by the smallest record
number, by a window in that order of which the first row is kept. Spark takes the first row of each group within
every map task before the shuffle (a window group limit), so a group of any size arrives as one row per task.

Defined results: records whose identifier names nothing belong to no group; a source without rank comes after all
ranked ones; null times come last; ties go to the smallest ``rec_id``; a field that no record can supply is -1;
repeated rows count as records; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.identifiers import normal_form, trimmed
from riskloom.llm.descriptions import says_something
from riskloom.session import bounded


def survivors(records: DataFrame, group: str, rec_id: str, fields: dict[str, Column], trust: str, recency: str) -> DataFrame:
    """One row for each group of two or more records: ``group`` and, for each field, the record that supplies it or -1.

    ``fields``: by result column, whether the record's value is usable. ``trust``: rank, 1 first, null last.
    """
    names = list(fields)
    flags = F.array(*(F.struct(F.lit(i).alias("field"), F.coalesce(use, F.lit(False)).alias("usable")) for i, use in enumerate(fields.values())))
    rows = records.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(rec_id).alias("_r"), F.col(trust).alias("_t"), F.col(recency).alias("_m"), F.inline(flags))
    order = W.partitionBy("_g", "field").orderBy(F.col("_t").asc_nulls_last(), F.col("_m").desc_nulls_last(), F.col("_r").asc())
    best = rows.filter("usable").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_g", "field", "_r")
    sizes = records.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_g")
    picked = best.groupBy("_g").agg(*(F.max(F.when(F.col("field") == i, F.col("_r"))).alias(x) for i, x in enumerate(names)))
    out = sizes.join(picked, "_g", "left")
    return out.select(F.col("_g").alias(group), *(F.coalesce(x, F.lit(-1).cast("bigint")).alias(x) for x in names))


def advisory_survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """id, score_rec_id, desc_rec_id of the cve records: a score counts from 0 to 10, a description if it says something."""
    ranks = trust.filter("source is not null").groupBy(F.lower(trimmed(F.col("source"))).alias("_s")).agg(F.min("trust_rank").alias("_rank"))
    rows = records.select(
        normal_form(F.col("id")).alias("id"), "rec_id", "modified_date", F.lower(trimmed(F.col("source"))).alias("_s"),
        F.col("cvss_score").between(0, 10).alias("_score"), says_something(F.col("description")).alias("_desc"),
    ).join(bounded(ranks), "_s", "left")
    return survivors(rows, "id", "rec_id", {"score_rec_id": F.col("_score"), "desc_rec_id": F.col("_desc")}, "_rank", "modified_date")
