"""Queries of scans: manifests and code inside documents, file listings, JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import usages
from riskloom.session import Cuts
from riskloom.sources import code, manifests
from riskloom.tables import read

_PIN = r"^([A-Za-z0-9@][\w@./:-]*)==([0-9][\w.+-]*)$"
_JSON_PIN = r'^"([^"]+)": "([0-9][^"]*)",?$'


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").filter("text is not null")


def requirements_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pinned packages in the lines of all documents: name, versions and documents."""
    t = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").rlike(_PIN))
    t = t.select("doc_id", F.lower(F.regexp_extract("line", _PIN, 1)).alias("name"), F.regexp_extract("line", _PIN, 2).alias("version"))
    return t.groupBy("name").agg(F.countDistinct("version").alias("versions"), F.countDistinct("doc_id").alias("documents"), F.max("version").alias("greatest"))


def lock_entries(spark: SparkSession, d: str) -> DataFrame:
    """Packages with their versions in the lines of JSON lockfiles: the last entry of a document counts."""
    t = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "l")).select("doc_id", "pos", F.trim("l").alias("line")).filter(F.col("line").rlike(_JSON_PIN))
    t = t.select("doc_id", "pos", F.regexp_extract("line", _JSON_PIN, 1).alias("name"), F.regexp_extract("line", _JSON_PIN, 2).alias("version"))
    last = t.groupBy("doc_id", "name").agg(F.max_by("version", "pos").alias("version"))
    return last.groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.max("version").alias("greatest"))


#: Ecosystems in the order of the scanners; the place of one is its ``source_seq``.
ECOSYSTEMS = ("npm", "pypi", "go", "rubygems", "maven", "cargo", "composer")


def dep_scan_union(spark: SparkSession, d: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Dependency rows of all seven ecosystems in one table, those in ``exclude`` left out.

    The table has no dev and direct flags; ``manifest_scan`` counts those.
    """
    t = read(spark, d, "package_queries", "ecosystem", "package_name", "version", "id")
    e = F.lower("ecosystem")
    branches = [t.filter(e == x).select(F.lit(x).alias("ecosystem"), F.lit(i).alias("source_seq"), "package_name", "version") for i, x in enumerate(ECOSYSTEMS)]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    out = out.filter(~F.col("ecosystem").isin(*exclude)) if exclude else out
    return out.groupBy("ecosystem", "source_seq").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("package_name").alias("packages"), F.count_if(F.col("version").isNull()).alias("unversioned"))


def ecosystem_detect(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose traces touch a file that shows an ecosystem, by ecosystem."""
    t = read(spark, d, "reachability", "merge_request_id", "call_trace").select("merge_request_id", F.explode("call_trace").alias("n")).filter("n is not null and merge_request_id is not null")
    files = t.select(F.col("merge_request_id").alias("repo_id"), F.substring_index("n", ":", 1).alias("path")).distinct()
    return manifests.detect(files).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("repositories"))


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    """Modules that import lines in documents name."""
    pattern = r"^(?:from ([\w.]+) import \w|import ([\w.]+)$)"
    t = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").rlike(pattern))
    name = F.concat(F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2))
    return t.select("doc_id", F.substring_index(name, ".", 1).alias("module")).groupBy("module").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("lines"))


#: Lines that show the language of a text, tried in this order; a text that can't be read as that language has no facts.
LANGUAGES = (
    (".go", r"(?m)^package \w+\s*$"), (".js", r"(?m)^(?:import .*from ['\"]|export (?:default |async |function|class|const)|(?:const|let|var) .*require\()"),
    (".py", r"(?m)^(?:def \w+\(|class \w+[(:]|from [\w.]+ import |import [\w.]+(?: as \w+)?\s*$)"), (".rb", r"(?m)^(?:require(?:_relative)? ['\"]|module [A-Z]\w*\s*$)"),
)


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all documents that hold a line of a language the scanner reads."""
    t = _docs(spark, d)
    ending = F.lit(None).cast("string")
    for end, pattern in reversed(LANGUAGES):
        ending = F.when(F.col("text").rlike(pattern), end).otherwise(ending)
    files = t.select(F.lit("documents").alias("repo_id"), F.concat(F.col("doc_id").cast("string"), ending).alias("path"), "text").filter("path is not null")
    return code.facts(files)


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    """Imports, bound names, uses, definitions, calls and exports in the documents that are code."""
    return _code(spark, d).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


def code_usages(spark: SparkSession, d: str) -> DataFrame:
    """Modules that documents import and how the imported names are used."""
    u = usages.usages(Cuts(spark, "code").cut(_code(spark, d)))
    return u.groupBy(F.substring_index("target", ".", 1).alias("module"), "how").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("path").alias("files"))


def code_exports(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).filter("kind = 'export'").groupBy("name", F.col("detail").alias("sort")).agg(F.countDistinct("path").alias("files"))


def code_reach(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in documents from which calls lead to a vulnerable symbol of the findings, by the number of calls."""
    sinks = read(spark, d, "reachability", "vulnerable_symbols").select(F.explode("vulnerable_symbols").alias("name"))
    edges = usages.call_edges(Cuts(spark, "code").cut(_code(spark, d)))
    return usages.reached(edges, sinks).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("smallest"))


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of pins, read as requirement files by the manifest scanner."""
    t = _docs(spark, d).filter(F.col("text").rlike(r"^[A-Za-z0-9@][\w@./:-]*==[0-9]"))
    files = t.select(F.col("doc_id").cast("string").alias("repo_id"), F.lit("requirements.txt").alias("path"), "text")
    return manifests.scan(files).groupBy("ecosystem", "is_dev", "is_direct").agg(F.count("name").alias("dependencies"), F.countDistinct("repo_id").alias("files"), F.count("error").alias("errors"))


def json_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the JSON properties of all events: key, count and sum of values."""
    t = read(spark, d, "events", "props").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


QUERIES = {f.__name__: f for f in (requirements_scan, lock_entries, dep_scan_union, ecosystem_detect, code_imports, code_facts, code_usages, code_exports, code_reach, manifest_scan, json_manifest)}

_LINES = r"(select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, unnest(generate_series(1, len(string_split_regex(text, '\r?\n')))) as pos from documents where text is not null)"
_IND = ", ".join(f"('{f}', '{e}')" for e, names in manifests.INDICATORS.items() for f in names)
SQL = {
    "requirements_scan": f"select name, count(distinct version) as versions, count(distinct doc_id) as documents, max(version) as greatest from (select doc_id, lower(regexp_extract(line, '{_PIN}', 1)) as name, regexp_extract(line, '{_PIN}', 2) as version from {_LINES} where regexp_matches(line, '{_PIN}')) group by name",
    "lock_entries": f"select name, count(*) as documents, max(version) as greatest from (select doc_id, name, arg_max(version, pos) as version from (select doc_id, pos, regexp_extract(trim(line, ' '), '{_JSON_PIN}', 1) as name, regexp_extract(trim(line, ' '), '{_JSON_PIN}', 2) as version from {_LINES} where regexp_matches(trim(line, ' '), '{_JSON_PIN}')) group by doc_id, name) group by name",
    "dep_scan_union": "select lower(ecosystem) as ecosystem, list_position(['npm', 'pypi', 'go', 'rubygems', 'maven', 'cargo', 'composer'], lower(ecosystem)) - 1 as source_seq, count(*) as rows, count(distinct package_name) as packages, count(*) filter (version is null) as unversioned from package_queries where lower(ecosystem) in ('npm', 'pypi', 'go', 'rubygems', 'maven', 'cargo', 'composer') group by all",
    "ecosystem_detect": f"select e as ecosystem, count(distinct merge_request_id) as repositories from (select distinct merge_request_id, string_split(n, ':')[1] as path from (select merge_request_id, unnest(call_trace) as n from reachability where merge_request_id is not null) where n is not null) join (values {_IND}) as i(f, e) on path = f group by e",
    "code_imports": r"select module, count(distinct doc_id) as documents, count(*) as lines from (select doc_id, string_split(regexp_extract(line, '^(?:from ([\w.]+) import \w|import ([\w.]+)$)', 1) || regexp_extract(line, '^(?:from ([\w.]+) import \w|import ([\w.]+)$)', 2), '.')[1] as module from " + _LINES + r" where regexp_matches(line, '^(?:from ([\w.]+) import \w|import ([\w.]+)$)')) group by module",
    "json_manifest": "select k, count(*) as n, sum(v)::bigint as total from (select unnest(map_keys(m)) as k, unnest(map_values(m)) as v from (select cast(props::json as map(varchar, bigint)) as m from events)) group by k",
}
