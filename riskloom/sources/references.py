"""References to advisories, out of the tables that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.identifiers import normal_form, trimmed


def with_ids(df: DataFrame, text: str, out: str = "_ids") -> DataFrame:
    """``df`` with the identifiers in a text as written: a JSON list of texts or of objects with an ``id``, such a list
    as JSON text inside a JSON text, one JSON text or object, or plain identifiers set apart by commas, semicolons or bars.

    A JSON list that is cut off can't be read and gives null, and so does null. Elements may be null. The steps are
    separate projections, so that every text is parsed once.
    """
    # nearly all are plain JSON lists without objects or lists inside, which are read in one step
    raw = F.col(text)
    listed = (F.substring(raw, 1, 1) == "[") & (F.locate("]", raw) == F.length(raw)) & ~F.contains(raw, F.lit("{"))
    df = df.withColumn("_l", F.when(listed, F.from_json(raw, "array<string>", {"allowSingleQuotes": "false"})))
    df = df.withColumn("_t", F.when(F.col("_l").isNull(), trimmed(raw)))
    jsonish = F.col("_t").rlike(r'^[\[{"]')
    df = df.withColumn("_v", F.when(jsonish, F.try_parse_json(F.when(jsonish, F.col("_t")))))
    df = df.withColumn("_s", F.when(F.schema_of_variant("_v") == "STRING", trimmed(F.try_variant_get("_v", "$", "string"))))
    df = df.withColumn("_n", F.when(F.col("_s").isNotNull(), F.try_parse_json("_s")).otherwise(F.col("_v")))
    df = df.withColumn("_i", F.coalesce(F.try_variant_get("_n", "$", "array<variant>"), F.when(F.col("_n").isNotNull(), F.array("_n"))))
    texts = F.transform("_i", lambda x: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.try_variant_get(x, "$", "string")))
    plain = F.when(~jsonish, F.col("_t")).when(~F.col("_s").rlike(r"^[\[{]"), F.col("_s"))
    return df.withColumn(out, F.coalesce("_l", F.split(plain, r"[,;|]"), texts)).drop("_l", "_t", "_v", "_s", "_n", "_i")


def query_references(queries: DataFrame) -> DataFrame:
    """ref_table, ref_id, cve_id, t of package_queries: one row for each identifier in ``cve_ids``.

    ``cached_at`` is epoch seconds, from some writers milliseconds; the size tells.
    """
    at = F.col("cached_at")
    rows = with_ids(queries.filter("cve_ids is not null and cve_ids not in ('', '[]')"), "cve_ids")
    rows = rows.select("id", F.when(F.abs(at) >= 100_000_000_000, F.floor(at / 1000)).otherwise(at).cast("bigint").alias("t"), F.explode("_ids").alias("x"))
    return rows.select(F.lit("package_queries").alias("ref_table"), F.col("id").alias("ref_id"), normal_form(F.col("x")).alias("cve_id"), "t").filter("cve_id is not null")


def finding_references(findings: DataFrame, seconds: Column) -> DataFrame:
    """ref_table, ref_id, cve_id, t of reachability; ``seconds``: its time in whole epoch seconds."""
    rows = findings.select(F.lit("reachability").alias("ref_table"), F.col("rec_id").alias("ref_id"), normal_form(F.col("cve_id")).alias("cve_id"), seconds.alias("t"))
    return rows.filter("cve_id is not null")


def cache_entries(cache: DataFrame) -> DataFrame:
    """cve_id, from_s, to_s of cve_cache."""
    return cache.select(normal_form(F.col("cve_id")).alias("cve_id"), F.col("cached_at").alias("from_s"), F.col("deleted_at").alias("to_s")).filter("cve_id is not null")
