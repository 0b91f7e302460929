"""Queries that search advisories and match names, modules and platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import names as N
from riskloom.functions.labels import normal_package
from riskloom.operators import advisories as A
from riskloom.sources.payloads import with_record
from riskloom.tables import read

#: Rules of the classifier: name, exact words in an identifier's description, shape of a package name.
PATTERNS = (("traversal", ("path traversal", "outside the web root"), "-core$"), ("injection", ("injection",), "-sql$"), ("redirect", ("redirect",), "-router$"), ("smuggling", ("smuggling",), "-proxy$"), ("deserialisation", ("deserialisation", "serialised"), "-yaml$"))


def nvd_affected(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable platforms of the readable records: product with its bounds, counted."""
    t = with_record(read(spark, d, "nvd_cve_log4j", "rec_id", "cve"), "cve")
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(F.try_variant_get(v, path, "variant")))
    for path in ("configurations", "nodes", "cpeMatch"):
        t = t.select("rec_id", F.explode(listed("_record", f"$.{path}")).alias("_record"))
    text = lambda c: F.try_variant_get("_record", f"$.{c}", "string").alias(c)
    m = t.select("rec_id", F.struct(F.try_variant_get("_record", "$.vulnerable", "boolean").alias("vulnerable"), text("criteria"), text("versionStartIncluding"), text("versionEndExcluding")).alias("m")).filter("m.vulnerable and m.criteria is not null")
    return m.groupBy(N.product(F.col("m.criteria")).alias("product")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id").alias("records"), F.min("m.versionStartIncluding").alias("least_start"), F.count("m.versionEndExcluding").alias("ended"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Records of the cve table whose description holds a keyword, by keyword and feed."""
    t = read(spark, d, "cve", "description", "source").filter("description is not null")
    words = [w for _, ws, _ in PATTERNS for w in ws]
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("description"), w))
    return t.select("source", F.explode(hits).alias("keyword")).groupBy("keyword", F.lower(F.trim("source")).alias("feed")).agg(F.count(F.lit(1)).alias("n"))


def classify(description: Column, package: Column) -> Column:
    """First pattern of which a keyword is in the description; else the first whose package shape fits."""
    out = F.lit(None).cast("string")
    for name, _, shape in reversed(PATTERNS):
        out = F.when(package.rlike(shape), name).otherwise(out)
    for name, words, _ in reversed(PATTERNS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(description), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def cve_classify(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "cve", "description", "affected_packages")
    pattern = classify(F.coalesce("description", F.lit("")), F.coalesce(F.get("affected_packages", F.lit(0))["name"], F.lit("")))
    return t.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def reference_hosts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "cve", "rec_id", "reference_urls").select("rec_id", F.explode("reference_urls").alias("url"))
    return t.groupBy(N.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id").alias("records"))


def description_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that descriptions name, and in how many records they come first."""
    t = read(spark, d, "cve", "rec_id", "description").filter("description is not null").select("rec_id", F.posexplode(N.symbols(F.col("description"))).alias("i", "symbol"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("i") == 0).alias("first"))


def module_match(spark: SparkSession, d: str) -> DataFrame:
    """Packages (as imports write them) whose name a Python module in the documents is or begins with, by equality on prefixes."""
    pattern = r"^(?:from (\w+)(?:\.\w+)* import \w|import (\w+)$)"
    lines = read(spark, d, "documents", "text").select(F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").rlike(pattern))
    modules = lines.select(F.concat(F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)).alias("module")).distinct()
    keys = modules.select("module", F.explode(N.prefixes(F.col("module"))).alias("key"))
    packages = read(spark, d, "package_queries", "package_name", "ecosystem").select(normal_package(F.col("package_name"), F.lit("pypi")).alias("key")).distinct()
    return keys.join(packages, "key").groupBy("key").agg(F.count(F.lit(1)).alias("modules"), F.min("module").alias("smallest"))


def osv_by_package(spark: SparkSession, d: str) -> DataFrame:
    """Every package asked for with the number of affected entries that name it: keys meet counts, never rows."""
    asked = read(spark, d, "package_queries", "ecosystem", "package_name").select(F.lower("ecosystem").alias("ecosystem"), F.col("package_name").alias("name")).distinct()
    known = A.osv_affected(read(spark, d, "osv_response", "rec_id", "affected")).groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("entries"))
    return asked.join(known, ["ecosystem", "name"], "left").select("ecosystem", "name", F.coalesce("entries", F.lit(0)).alias("entries"))


QUERIES = {f.__name__: f for f in (nvd_affected, keyword_search, cve_classify, reference_hosts, description_symbols, module_match, osv_by_package)}

_WORDS = [w for _, ws, _ in PATTERNS for w in ws]
_CLASS = "case " + " ".join("when " + " or ".join(f"contains(lower(coalesce(description, '')), '{w}')" for w in ws) + f" then '{n}'" for n, ws, _ in PATTERNS) + " " + " ".join(f"when regexp_matches(coalesce(affected_packages[1].name, ''), '{p}') then '{n}'" for n, _, p in PATTERNS) + " end"
_MODULE = r"^(?:from (\w+)(?:\.\w+)* import \w|import (\w+)$)"
SQL = {
    "keyword_search": f"select keyword, lower(trim(source, ' ')) as feed, count(*) as n from (select source, description, unnest({_WORDS}) as keyword from cve where description is not null) where contains(lower(description), keyword) group by all",
    "cve_classify": f"select {_CLASS} as pattern, count(*) as n from cve group by 1",
    "reference_hosts": "select nullif(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '') as host, count(*) as n, count(distinct rec_id) as records from (select rec_id, unnest(reference_urls) as url from cve) group by 1",
    "description_symbols": r"select symbol, count(*) as records, count(*) filter (i = 1) as first from (select rec_id, unnest(s) as symbol, unnest(generate_series(1, len(s))) as i from (select rec_id, list_filter(s, lambda x, j: list_position(s, x) = j) as s from (select rec_id, list_transform(list_concat(regexp_extract_all(description, '`([A-Za-z_][\w.]*)(?:\(\))?`', 1), regexp_extract_all(description, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)), lambda x: string_split(x, '.')[-1]) as s from cve where description is not null))) group by symbol",
    "module_match": f"with m as (select distinct regexp_extract(line, '{_MODULE}', 1) || regexp_extract(line, '{_MODULE}', 2) as module from (select unnest(string_split_regex(text, '\\r?\\n')) as line from documents) where regexp_matches(line, '{_MODULE}')), p as (select distinct translate(lower(package_name), '-.', '__') as key from package_queries) select key, count(*) as modules, min(module) as smallest from m join p on module = key or starts_with(module, key || '_') group by key",
    "osv_by_package": f"select a.ecosystem, a.name, count(k.name) as entries from (select distinct lower(ecosystem) as ecosystem, package_name as name from package_queries) a left join (AFFECTED) k on a.ecosystem = k.ecosystem and a.name = k.name group by all",
}
from riskloom.plans.advisories import SQL as _ADVISORIES  # noqa: E402
from riskloom.plans.advisories import SQL_NVD  # noqa: E402

_ITEMS = "unnest(case json_type({0}) when 'ARRAY' then json_extract({0}, '$[*]') when 'OBJECT' then [{0}] else [] end)"
SQL["nvd_affected"] = f"""with c as (select rec_id, {_ITEMS.format("(r -> '$.configurations')")} as c from ({SQL_NVD})), n as (select rec_id, {_ITEMS.format("(c -> '$.nodes')")} as n from c), m as (select rec_id, {_ITEMS.format("(n -> '$.cpeMatch')")} as m from n)
 select coalesce(nullif(nullif(split_part(m ->> '$.criteria', ':', 5), ''), '*'), split_part(m ->> '$.criteria', ':', 4)) as product, count(*) as n, count(distinct rec_id) as records, min(m ->> '$.versionStartIncluding') as least_start, count(m ->> '$.versionEndExcluding') as ended from m where (m ->> '$.vulnerable') = 'true' and (m ->> '$.criteria') is not null group by 1"""

SQL["osv_by_package"] = SQL["osv_by_package"].replace("AFFECTED", _ADVISORIES["osv_affected"])
