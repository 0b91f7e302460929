"""Advisory payloads: JSON texts that may sit in a response envelope or be JSON text inside a JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_record(df: DataFrame, payload: str, out: str = "_record") -> DataFrame:
    """``df`` with the record itself as VARIANT: text inside text is read again, envelopes are opened; null if unreadable.

    The readings are separate projections so that each payload is parsed once, however often the result is used.
    """
    df = df.withColumn("_v0", F.try_parse_json(payload))
    df = df.withColumn("_v1", F.when(F.schema_of_variant("_v0") == "STRING", F.try_parse_json(F.try_variant_get("_v0", "$", "string"))).otherwise(F.col("_v0")))
    boxed = F.try_variant_get("_v1", "$.vulnerabilities[0].cve", "variant")
    return df.withColumn(out, F.coalesce(boxed, F.try_variant_get("_v1", "$.cve", "variant"), "_v1")).drop("_v0", "_v1")
