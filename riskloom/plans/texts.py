"""Queries over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.labels import hcl_string, severity_rank, slug
from riskloom.functions.versions import sql_plain_key
from riskloom.operators import texts as T
from riskloom.tables import read


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return T.lines(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def changelog_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections under headings with a version: version, first line and number of lines."""
    s = T.sections(_lines(spark, d), "doc_id").filter("version is not null")
    return s.groupBy("doc_id", "version").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n_lines"))


def changelog_rules(spark: SparkSession, d: str) -> DataFrame:
    return T.changes(T.sections(_lines(spark, d), "doc_id"), "doc_id").groupBy("kind").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("doc_id").alias("documents"), F.count("version").alias("in_section"))


def line_context(spark: SparkSession, d: str) -> DataFrame:
    """Breaking lines and whether the lines before and after them are list items too."""
    w = W.partitionBy("doc_id").orderBy("pos")
    r = _lines(spark, d).withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    item = lambda c: F.coalesce(F.col(c).startswith("- "), F.lit(False))
    r = r.filter(F.lower("line").rlike(r"^-\s*breaking"))
    return r.groupBy(item("before").alias("before_item"), item("after").alias("after_item")).agg(F.count(F.lit(1)).alias("n"))


def api_names(spark: SparkSession, d: str) -> DataFrame:
    """Interface names of the notes: in how many documents, and how often as the first name of a line."""
    r = _lines(spark, d).withColumn("names", T.api_names(F.col("line"))).filter("size(names) > 0")
    e = r.select("doc_id", F.posexplode("names").alias("i", "name"))
    return e.groupBy("name").agg(F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("i") == 0).alias("first"))


def strategy_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Changes of two strategies in one list, one row for each description of a document, the earlier strategy first."""
    s = T.sections(_lines(spark, d), "doc_id").filter("not is_header")
    breaking = s.filter(F.lower("line").rlike(r"^-\s*breaking")).select("doc_id", F.lit(1).alias("strategy"), "pos", T.clean_description(F.col("line")).alias("description"))
    ruled = s.filter(T.rule_of(F.col("line")).isNotNull()).select("doc_id", F.lit(2).alias("strategy"), "pos", T.clean_description(F.col("line")).alias("description"))
    u = breaking.unionByName(ruled)
    best = u.groupBy("doc_id", "description").agg(F.min(F.struct("strategy", "pos")).alias("b"))
    return best.groupBy(F.col("b.strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("changes"), F.sum("b.pos").alias("pos_sum"))


def version_heuristics(spark: SparkSession, d: str) -> DataFrame:
    """What a pair of versions hints at: first stable release, skipped majors, end of a pre-release."""
    t = read(spark, d, "github_pr_dependabot", "title").select(F.regexp_extract("title", r"from (\S+) to (\S+)", 1).alias("a"), F.regexp_extract("title", r"from (\S+) to (\S+)", 2).alias("b")).filter("a <> ''")
    major = lambda c: F.regexp_extract(c, r"^v?([0-9]+)", 1).try_cast("bigint")
    pre = lambda c: F.col(c).rlike("(?i)[-.](alpha|beta|rc|dev|pre)")
    hints = F.array_compact(F.array(
        F.when((major("a") == 0) & (major("b") >= 1), "first-stable"), F.when(major("b") - major("a") > 1, "skipped-major"),
        F.when(pre("a") & ~pre("b"), "left-prerelease"), F.when(F.col("b").rlike(r"\.post[0-9]"), "post-release"),
    ))
    return t.select(F.explode(hints).alias("hint")).groupBy("hint").agg(F.count(F.lit(1)).alias("n"))


def render_rules(spark: SparkSession, d: str) -> DataFrame:
    """A configuration block for each pattern: its name as a slug and the escaped ids of its three gravest advisories."""
    t = read(spark, d, "cve", "rec_id", "id", "severity", "waf_pattern_id").filter("waf_pattern_id is not null")
    w = W.partitionBy("waf_pattern_id").orderBy(severity_rank(F.col("severity")).desc(), "id", "rec_id")
    top = t.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: F.concat(F.lit('"'), hcl_string(F.trim(x["id"])), F.lit('"')))
    block = F.concat(F.lit('rule "'), slug(F.col("waf_pattern_id")), F.lit('" { ids = ['), F.array_join(ids, ", "), F.lit("] }"))
    return top.groupBy("waf_pattern_id").agg(block.alias("block"))


def render_comment(spark: SparkSession, d: str) -> DataFrame:
    """For each request of findings: its ten first packages with at most three findings each and how many more there are."""
    t = read(spark, d, "reachability", "merge_request_id", "package_name", "rec_id", "status").filter("merge_request_id is not null and package_name is not null")
    # three findings a package are kept before the shuffle; only they are ever collected
    first = t.withColumn("i", F.row_number().over(W.partitionBy("merge_request_id", "package_name").orderBy("rec_id"))).filter("i <= 3")
    first = first.groupBy("merge_request_id", "package_name").agg(F.array_sort(F.collect_list("rec_id")).alias("ids"))
    g = t.groupBy("merge_request_id", "package_name").agg(F.count(F.lit(1)).alias("n")).join(first, ["merge_request_id", "package_name"])
    w = W.partitionBy("merge_request_id").orderBy("package_name")
    g = g.withColumn("p", F.row_number().over(w)).filter("p <= 10")
    text = F.concat("package_name", F.lit(": "), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise(""))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))), lambda x: x["t"])
    return g.groupBy("merge_request_id").agg(F.array_join(rows, "; ").alias("comment"))


def confidence(spark: SparkSession, d: str) -> DataFrame:
    """Certainty of each finding from what it has: trace, symbols, a verdict; at most 1."""
    t = read(spark, d, "reachability", "rec_id", "call_trace", "vulnerable_symbols", "is_safe_to_ignore")
    score = F.lit(0.5) + F.when(F.size("call_trace") > 0, 0.3).otherwise(0.0) + F.when(F.size("vulnerable_symbols") > 0, 0.1).otherwise(0.0) + F.when(F.col("is_safe_to_ignore").isNotNull(), 0.2).otherwise(0.0)
    return t.groupBy(F.round(F.least(F.lit(1.0), score), 1).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_rec_id"))


QUERIES = {f.__name__: f for f in (changelog_sections, changelog_rules, line_context, api_names, strategy_union_dedup, version_heuristics, render_rules, render_comment, confidence)}

_LINES = r"""(select doc_id, (unnest(generate_series(1, len(ls))) - 1)::int as pos, unnest(ls) as line from (select doc_id, string_split_regex(text, '\r?\n') as ls from documents where text is not null))"""
_SECTIONS = f"(select *, last_value(v ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as version from (select *, case when regexp_matches(line, '{T.HEADER}') then regexp_extract(line, '{T.HEADER}', 1) end as v from {_LINES}))"
_RULE = "case " + " ".join(f"when regexp_matches(lower(line), '{p}') then '{n}'" for n, p in T.LINE_RULES) + " end"
_CLEAN = r"trim(regexp_replace(regexp_replace(line, '^\s*(?:[-*+]|#+|[0-9]+\.)\s+', ''), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'))[1:200]"
_PAIR = r"(select regexp_extract(title, 'from (\S+) to (\S+)', 1) as a, regexp_extract(title, 'from (\S+) to (\S+)', 2) as b from github_pr_dependabot)"
_MAJOR = "try_cast(regexp_extract({0}, '^v?([0-9]+)', 1) as bigint)"
_PRE = "regexp_matches({0}, '(?i)[-.](alpha|beta|rc|dev|pre)')"
_RANK = "case lower(severity) when 'none' then 1 when 'low' then 2 when 'medium' then 3 when 'high' then 4 when 'critical' then 5 else 0 end"
SQL = {
    "changelog_sections": f"select doc_id, version, min(pos) as first, count(*) as n_lines from {_SECTIONS} where version is not null group by all",
    "changelog_rules": f"select kind, count(*) as changes, count(distinct doc_id) as documents, count(version) as in_section from (select doc_id, description, arg_min(kind, pos) as kind, (list(version order by pos))[1] as version from (select *, {_RULE} as kind, {_CLEAN} as description from {_SECTIONS} where v is null) where kind is not null and description <> '' group by doc_id, description) group by kind",
    "line_context": f"select coalesce(starts_with(b, '- '), false) as before_item, coalesce(starts_with(a, '- '), false) as after_item, count(*) as n from (select line, lag(line) over w as b, lead(line) over w as a from {_LINES} window w as (partition by doc_id order by pos)) where regexp_matches(lower(line), '^-\\s*breaking') group by all",
    "api_names": rf"select name, count(distinct doc_id) as documents, count(*) filter (i = 0) as first from (select doc_id, unnest(names) as name, unnest(generate_series(1, len(names))) - 1 as i from (select doc_id, list_filter(names, lambda x, j: list_position(names, x) = j) as names from (select doc_id, regexp_extract_all(line, '`([A-Za-z_][\w.]*)(?:\(\))?`', 1) as names from {_LINES}))) group by name",
    "strategy_union_dedup": f"select strategy, count(*) as changes, sum(pos)::bigint as pos_sum from (select doc_id, description, strategy, pos from (select doc_id, 1 as strategy, pos, {_CLEAN} as description from {_SECTIONS} where v is null and regexp_matches(lower(line), '^-\\s*breaking') union all select doc_id, 2, pos, {_CLEAN} from {_SECTIONS} where v is null and {_RULE} is not null) qualify row_number() over (partition by doc_id, description order by strategy, pos) = 1) group by strategy",
    "version_heuristics": f"select hint, count(*) as n from (select unnest([case when {_MAJOR.format('a')} = 0 and {_MAJOR.format('b')} >= 1 then 'first-stable' end, case when {_MAJOR.format('b')} - {_MAJOR.format('a')} > 1 then 'skipped-major' end, case when {_PRE.format('a')} and not {_PRE.format('b')} then 'left-prerelease' end, case when regexp_matches(b, '\\.post[0-9]') then 'post-release' end]) as hint from {_PAIR} where a <> '') where hint is not null group by hint",
    "render_rules": f"""select waf_pattern_id, 'rule "' || regexp_replace(regexp_replace(lower(waf_pattern_id), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '" {{ ids = [' || string_agg('"' || replace(replace(trim(id, ' '), '\\', '\\\\'), '"', '\\"') || '"', ', ' order by n) || '] }}' as block from (select *, row_number() over (partition by waf_pattern_id order by {_RANK} desc, id, rec_id) as n from cve where waf_pattern_id is not null) where n <= 3 group by waf_pattern_id""",
    "render_comment": "select merge_request_id, string_agg(package_name || ': ' || array_to_string(ids, ', ') || case when n > 3 then ' and ' || (n - 3) || ' more' else '' end, '; ' order by p) as comment from (select *, row_number() over (partition by merge_request_id order by package_name) as p from (select merge_request_id, package_name, count(*) as n, (list(rec_id order by rec_id))[1:3] as ids from reachability where merge_request_id is not null and package_name is not null group by all)) where p <= 10 group by merge_request_id",
    "confidence": "select round(least(1.0::double, 0.5::double + case when len(call_trace) > 0 then 0.3::double else 0 end + case when len(vulnerable_symbols) > 0 then 0.1::double else 0 end + case when is_safe_to_ignore is not null then 0.2::double else 0 end), 1) as confidence, count(*) as n, min(rec_id) as first_rec_id from reachability group by 1",
}
assert sql_plain_key
