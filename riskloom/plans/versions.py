"""Queries of version dialects, ranges and joins over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions import versions as V
from riskloom.session import bounded
from riskloom.tables import read

DIALECTS = {
    "range": (V.range_key, V.sql_range_key),
    "plain": (V.plain_key, V.sql_plain_key),
    "stripped": (V.stripped_three, V.sql_stripped_three),
    "known": (V.first_three, V.sql_first_three),
    "semver": (V.semver, V.sql_semver),
    "dotted": (V.dotted_three, V.sql_dotted_three),
    "major": (lambda c: F.array(V.major(c)), lambda x: f"[{V.sql_major(x)}]"),
}
#: Ranges that exercise every operator.
RANGES = (">=1.2,<4.5.0", "<2.0.0", "=3.1.4", "==2.5.0,!=2.5.1", ">5,<=7.10", "~=4.2", "!=1.0.0", "")


def version_query(dialect: str):
    build = DIALECTS[dialect][0]

    def query(spark: SparkSession, d: str) -> DataFrame:
        t = read(spark, d, "package_queries", "version").filter("version is not null").distinct()
        key = F.array_join(F.transform(build(F.col("version")), lambda x: x.cast("string")), ".", "null")
        return t.select("version", key.alias("version_key"))

    return query


def version_sql(dialect: str) -> str:
    key = DIALECTS[dialect][1]("version")
    return f"select version, array_to_string(list_transform({key}, lambda t: coalesce(t::varchar, 'null')), '.') as version_key from (select distinct version from package_queries where version is not null)"


def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """How often two dialects order the versions of a title's update differently."""
    t = read(spark, d, "github_pr_dependabot", "title").select(F.regexp_extract("title", r"from (\S+) to (\S+)", 1).alias("a"), F.regexp_extract("title", r"from (\S+) to (\S+)", 2).alias("b")).filter("a <> ''")
    less = {n: f(F.col("a")) < f(F.col("b")) for n, (f, _) in DIALECTS.items() if n in ("range", "plain", "known", "dotted")}
    return t.groupBy().agg(F.count(F.lit(1)).alias("pairs"), *(F.count_if(c).alias(f"up_{n}") for n, c in less.items()))


def range_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Number of version texts that each range holds."""
    t = read(spark, d, "package_queries", "version").filter("version is not null").groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    t = t.select("version", "n", F.explode(F.array(*map(F.lit, RANGES))).alias("ranges"))
    return t.groupBy("ranges").agg(F.sum(F.when(V.in_range(F.col("version"), F.col("ranges")), F.col("n")).otherwise(0)).alias("held"), F.sum("n").alias("asked"))


def kb_join(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies (order lines) affected by the signature of their package (part): equality on the package, then the range."""
    line = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    part = read(spark, d, "part", "p_partkey", "p_size")
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
    # each distinct version and each range is parsed once, before the join; the residual condition only compares arrays
    asked = line.select(F.col("l_orderkey").alias("repo"), F.col("l_partkey").alias("package"), version.alias("version"))
    keys = asked.select("version").distinct().select(F.col("version").alias("_v"), V.range_key(F.col("version")).alias("key"))
    deps = asked.join(bounded(keys), asked["version"] == keys["_v"]).select("repo", "package", "key")
    ranges = F.concat(F.lit(">=1."), F.col("p_size").cast("string"), F.lit(",<"), (2 + F.col("p_size") % 5).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    signatures = part.select(F.col("p_partkey").alias("package"), V.conditions(ranges).alias("conditions"))
    hit = deps.join(signatures, "package").filter(V.holds(F.col("key"), F.col("conditions")))
    return hit.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.sum("n").alias("affected"), F.count(F.lit(1)).alias("packages"))


_LINE_VERSION = "l_linenumber::varchar || '.' || floor(l_quantity)::int::varchar || '.' || (l_suppkey % 10)::varchar"
_PART_RANGES = "'>=1.' || p_size::varchar || ',<' || (2 + p_size % 5)::varchar || '.' || p_size::varchar"


def known_changes(spark: SparkSession, d: str) -> DataFrame:
    """Known changes (one for each part, at a version of its size) of the package of an update that lie after its old and
    up to its new version: for each change the updates that meet it.

    Packages are compared in lower case with ``_`` for ``-``. The parts go round the packages of the updates in the order of their names.
    """
    form = _FORM
    title = read(spark, d, "github_pr_dependabot", "rec_id", "title").filter(F.col("title").rlike(form))
    package = F.translate(F.lower(F.regexp_extract("title", form, 1)), "-", "_")
    updates = title.groupBy(package.alias("package"), F.regexp_extract("title", form, 2).alias("a"), F.regexp_extract("title", form, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))
    # each version is parsed once, before the join
    updates = updates.select("package", "n", "first", V.padded(V.stripped_three(F.col("a"))).alias("a"), V.padded(V.stripped_three(F.col("b"))).alias("b"))
    names = updates.select("package").distinct().withColumn("place", F.row_number().over(W.orderBy("package")) - 1)
    size = F.col("p_size").cast("string")
    changed_in = F.concat_ws(".", (F.col("p_size") % 8).cast("string"), size, F.lit("0"))
    parts = read(spark, d, "part", "p_partkey", "p_size").crossJoin(names.agg(F.count(F.lit(1)).alias("packages"))).filter("packages > 0")
    parts = parts.select("p_partkey", changed_in.alias("changed_in"), F.expr("pmod(p_partkey, packages)").alias("place"))
    changes = parts.join(names, "place").select("p_partkey", "package", "changed_in", V.padded(V.stripped_three(F.col("changed_in"))).alias("at"))
    hit = updates.join(changes, "package").filter("a < at and at <= b")
    return hit.groupBy("p_partkey", "package", "changed_in").agg(F.sum("n").alias("updates"), F.min("first").alias("first_rec_id"))


def _sql_padded(x: str) -> str:
    k = V.sql_stripped_three(x)
    return f"list_concat({k}, [0::bigint, 0::bigint, 0::bigint])[1:3]"


QUERIES = {f"version_{n}": version_query(n) for n in DIALECTS} | {
    "version_compare": version_compare, "range_predicate": range_predicate, "kb_join": kb_join, "known_changes": known_changes,
}
_FORM = r"(\S+) from (\S+) to (\S+)"
_TITLE = r"select rec_id, regexp_extract(title, 'from (\S+) to (\S+)', 1) as a, regexp_extract(title, 'from (\S+) to (\S+)', 2) as b from github_pr_dependabot"
SQL = {f"version_{n}": version_sql(n) for n in DIALECTS} | {
    "version_compare": "select count(*) as pairs, " + ", ".join(f"count(*) filter ({DIALECTS[n][1]('a')} < {DIALECTS[n][1]('b')}) as up_{n}" for n in ("range", "plain", "known", "dotted")) + f" from ({_TITLE}) where a <> ''",
    "range_predicate": f"select ranges, sum(case when {V.sql_in_range('version', 'ranges')} then n else 0 end)::bigint as held, sum(n)::bigint as asked from (select version, count(*) as n from package_queries where version is not null group by version), (select unnest({list(RANGES)}) as ranges) group by ranges",
    "kb_join": f"select repo, count(*) as affected, count(distinct package) as packages from (select l_orderkey as repo, l_partkey as package, {_LINE_VERSION} as version from lineitem) join (select p_partkey as package, {_PART_RANGES} as ranges from part) using (package) where {V.sql_in_range('version', 'ranges')} group by repo",
    "known_changes": rf"""with u as (select rec_id, translate(lower(regexp_extract(title, '{_FORM}', 1)), '-', '_') as package, regexp_extract(title, '{_FORM}', 2) as a, regexp_extract(title, '{_FORM}', 3) as b from github_pr_dependabot where regexp_matches(title, '{_FORM}')),
 names as (select package, row_number() over (order by package) - 1 as place from (select distinct package from u)),
 changes as (select p_partkey, package, changed_in from (select p_partkey, (p_size % 8)::varchar || '.' || p_size::varchar || '.0' as changed_in, p_partkey % (select count(*) from names) as place from part) join names using (place))
 select p_partkey, package, changed_in, count(*) as updates, min(rec_id) as first_rec_id from u join changes using (package) where {_sql_padded('a')} < {_sql_padded('changed_in')} and {_sql_padded('changed_in')} <= {_sql_padded('b')} group by all""",
}
