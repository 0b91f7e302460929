"""Line-oriented texts: changelog sections, rules over lines, names of interfaces, tables of update requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ordered rules over changelog lines: the first that matches a line gives its kind of change.
LINE_RULES = (
    ("breaking", r"^[-*]?\s*breaking\b|breaking change"),
    ("removed", r"\b(removed|dropped|deleted)\b|drop support"),
    ("renamed", r"\brenamed?\b|moved to"),
    ("deprecated", r"\bdeprecat"),
    ("signature", r"required argument|made asynchronous|no longer accepts|split in two"),
    ("default", r"now off unless|by default"),
    ("security", r"^[-*]?\s*security\b|cve-[0-9]"),
)
HEADER = r"^#{1,3}\s*\[?v?([0-9]+(?:\.[0-9]+)+[\w.-]*)\]?"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the lines of each text without line ends of any system."""
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))


def sections(line_rows: DataFrame, key: str) -> DataFrame:
    """Lines with the version of the header they stand under (null before the first). The window runs in one text."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.when(F.col("line").rlike(HEADER), F.regexp_extract("line", HEADER, 1))
    return line_rows.withColumn("version", F.last(head, ignorenulls=True).over(w)).withColumn("is_header", head.isNotNull())


def rule_of(line: Column) -> Column:
    """The first rule that matches, or null."""
    low = F.lower(line)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LINE_RULES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def clean_description(line: Column) -> Column:
    """A line without list, heading and link marks, at most 200 characters."""
    t = F.regexp_replace(line, r"^\s*(?:[-*+]|#+|[0-9]+\.)\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.substring(F.trim(t), 1, 200)


def api_names(line: Column) -> Column:
    """Identifiers in back ticks without call brackets, in order, each once."""
    found = F.regexp_extract_all(line, F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))
    return F.array_distinct(found)


def changes(section_rows: DataFrame, key: str) -> DataFrame:
    """key, version, kind, description: one row for each distinct description of a text, by its first line."""
    r = section_rows.filter("not is_header").withColumn("kind", rule_of(F.col("line"))).filter("kind is not null")
    r = r.withColumn("description", clean_description(F.col("line"))).filter("description <> ''")
    return r.groupBy(key, "description").agg(F.min_by("kind", "pos").alias("kind"), F.min_by("version", "pos").alias("version"), F.min("pos").alias("pos"))
