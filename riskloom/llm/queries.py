"""Queries of the language-model operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.descriptions import sql_says_something
from riskloom.llm.grouping import grouped
from riskloom.llm.leakage import leaked, overlaps
from riskloom.llm.residue import residue
from riskloom.llm.survivors import advisory_survivors
from riskloom.llm.tokens import decoder, encoded
from riskloom.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped(read(spark, d, "osv_response", "id", "aliases"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "cve", "rec_id", "id", "description", "cvss_score", "modified_date", "source")
    return advisory_survivors(records, read(spark, d, "source_trust"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(read(spark, d, "documents", "doc_id", "text"), F.col("text"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of ids of each document and whether decoding them gives the text again."""
    docs = read(spark, d, "documents", "doc_id", "text")
    ids = encoded(docs.withColumn("doc_id", F.struct("doc_id", "text")), F.col("text"))
    back = decoder(spark)(F.col("ids"))
    return ids.select("doc_id.doc_id", F.size("ids").alias("n_ids"), (back == F.coalesce("doc_id.text", F.lit(""))).alias("same"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_items", "item_id", "text"))


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps with substituted words too: windows of 13 equal words, most words that agree around a hit, and the
    longest stretch of at least 13 words of which 80 % agree; 22 of the 29 compared words or such a stretch make a row."""
    return overlaps(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_items", "item_id", "text"), least=22)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(read(spark, d, "documents", "doc_id", "text"))


QUERIES = {
    "p2_found": p2_found, "p4_found": p4_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_found": p8_found,
}
_NORM = r"upper(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\p{{Pd}}\x{{2212}}]', '-', 'g'))"
_IS_ID = "regexp_matches({0}, '^(CVE-[0-9]{{4}}-[0-9]{{4,}}|GHSA(-[0-9A-Z]{{4}}){{3}}|(PYSEC|GO|RUSTSEC)-[0-9]{{4}}-[0-9]+)$') and not regexp_matches({0}, '^[A-Z]+-0000-|^(CVE|PYSEC|GO|RUSTSEC)-[0-9]{{4}}-0+$|^GHSA(-X{{4}}){{3}}$')"
# Words without compatibility forms, which the test tables' passages don't need.
_TEXT_WORDS = r"regexp_extract_all(strip_accents(lower(regexp_replace(text, '[\p{Cf}]', '', 'g'))), '[\p{L}\p{N}]+')"
_GRAMS = "(select distinct {0}, g from (select {0}, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) as g from (select {0}, {1} as w from {2} where text is not null) where len(w) > 12))"
_BEST = "arg_min(rec_id, row(coalesce(trust_rank, 1000), -coalesce(epoch_us(modified_date), -4000000000000000), rec_id)) filter ({0})"
SQL: dict[str, str] = {
    "p2_found": f"""with recursive r as (select {_NORM.format('id')} as id, aliases from osv_response), own as (select distinct id from r where {_IS_ID.format('id')}),
 e as (select distinct id as a, {_NORM.format('x')} as b from (select id, unnest(aliases) as x from r where {_IS_ID.format('id')}) where x is not null), f as (select a, b from e where {_IS_ID.format('b')}),
 links as (select a, b from f union select b, a from f), walk(node, seen) as (select id, id from own union select walk.node, links.b from walk join links on links.a = walk.seen)
 select node as id, min(seen) as group_id from walk group by node""",
    "p7_found": f"select distinct doc_id, item_id from {_GRAMS.format('doc_id', _TEXT_WORDS, 'documents')} join {_GRAMS.format('item_id', _TEXT_WORDS, 'eval_items')} using (g)",
    "p4_found": f"""with t as (select lower(trim(source, E' \t\n')) as s, min(trust_rank) as trust_rank from source_trust group by 1),
 c as (select {_NORM.format('id')} as id, rec_id, modified_date, trust_rank, coalesce(cvss_score between 0 and 10, false) as score, {sql_says_something('description')} as said from cve left join t on lower(trim(cve.source, E' \t\n')) = t.s)
 select id, coalesce({_BEST.format('score')}, -1) as score_rec_id, coalesce({_BEST.format('said')}, -1) as desc_rec_id from c where {_IS_ID.format('id')} group by id having count(*) > 1""",
}
