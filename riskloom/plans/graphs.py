"""Queries of call graphs and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import graphs as G
from riskloom.tables import read


def _reach(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "reachability", "rec_id", "package_name", "call_trace", "vulnerable_symbols", "status")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out and fan-in of every node in the recorded traces."""
    e = G.path_edges(_reach(spark, d), "call_trace")
    rows = e.select(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return rows.groupBy("node").agg(F.sum("o").alias("calls"), F.sum("i").alias("called"))


def call_trace_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Fewest calls from each node to one that ends in a render step, over the edges of all traces, against their direction."""
    e = G.path_edges(_reach(spark, d), "call_trace")
    sinks = e.filter(F.col("callee").endswith(":renderRow")).select("callee").distinct()
    return G.distances(e, sinks, reverse=True).select("node", "depth", "via")


def graph_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a graph with cycles: suppliers point to half their number, every seventh one back up."""
    s = read(spark, d, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    down = s.select(F.floor(k / 2).cast("string").alias("caller"), k.cast("string").alias("callee")).filter("caller <> callee")
    back = s.filter(k % 7 == 0).select(k.cast("string").alias("caller"), F.floor(k / 4).cast("string").alias("callee")).filter("caller <> callee")
    start = s.sparkSession.createDataFrame([("1",)], "node string")
    return G.distances(down.unionByName(back), start).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("smallest"))


def symbol_join(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose trace calls one of their vulnerable symbols, and whether the status says so, by status."""
    r = _reach(spark, d)
    called = F.transform("call_trace", lambda x: F.try_element_at(F.split(x, ":"), F.lit(-1)))
    hit = F.coalesce(F.arrays_overlap(called, "vulnerable_symbols"), F.lit(False))
    return r.groupBy("status", hit.alias("symbol_called")).agg(F.count(F.lit(1)).alias("n"))


def sink_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Packages by how many others end in the same last two dotted parts, by equality on exploded suffixes."""
    p = read(spark, d, "reachability", "package_name").filter("package_name is not null").distinct()
    s = p.select("package_name", F.explode(G.suffixes(F.translate("package_name", "/:-", "..."))).alias("suffix")).filter("instr(suffix, '.') > 0")
    return s.groupBy("suffix").agg(F.count(F.lit(1)).alias("packages"), F.min("package_name").alias("smallest")).filter("packages > 1")


def reachable_status(spark: SparkSession, d: str) -> DataFrame:
    """Packages with any finding whose trace has two or more steps."""
    r = _reach(spark, d)
    return r.groupBy("package_name").agg(F.coalesce(F.bool_or(F.size("call_trace") > 1), F.lit(False)).alias("reachable"), F.count(F.lit(1)).alias("findings"))


def enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    """Definitions (spans of order lines) around calls (every line) of an order: the first that spans each."""
    line = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey", "l_quantity")
    per = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    defs = per.select(F.col("l_orderkey").alias("file"), F.col("part").cast("string").alias("name"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("part") % 4).alias("end"), F.col("l_linenumber").alias("ord"))
    calls = per.select(F.col("l_orderkey").alias("file"), F.col("part").cast("string").alias("call"), F.col("l_linenumber").alias("line"))
    return G.innermost(defs, calls).groupBy("line").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("name").cast("bigint")).alias("name_sum"))


def module_map(spark: SparkSession, d: str) -> DataFrame:
    """File stems and the first file (in text order) that has each: what an import of that stem resolves to."""
    t = _reach(spark, d).select(F.explode(F.array_distinct("call_trace")).alias("n")).filter("n is not null")
    path = F.substring_index("n", ":", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    return t.select(path.alias("path"), stem.alias("stem")).distinct().groupBy("stem").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"))


def export_diff(spark: SparkSession, d: str) -> DataFrame:
    """Packages affected in records of one feed and in those of another: removed, added, with another number of records."""
    a = read(spark, d, "cve", "source", "affected_packages")
    rows = a.select(F.lower(F.trim("source")).alias("s"), F.explode("affected_packages").alias("p")).filter("p.name is not null").select("s", F.col("p.name").alias("name"))
    count = lambda s: rows.filter(F.col("s") == s).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return G.full_diff(count("nvd"), count("github"), "name", "n")


def peer_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the properties in the first and the last event of a user: removed, added or changed."""
    t = read(spark, d, "events", "event_id", "user_id", "event_type", "props")
    ends = t.groupBy("user_id").agg(F.min_by("props", "event_id").alias("old"), F.max_by("props", "event_id").alias("new"))
    value = lambda c: F.get_json_object(c, "$.k").cast("bigint")
    change = F.when(value("old") == value("new"), "same").when(value("old") > value("new"), "lower").otherwise("higher")
    return ends.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("users"))


QUERIES = {f.__name__: f for f in (call_edges, call_trace_bfs, graph_cycle, symbol_join, sink_suffix_match, reachable_status, enclosing_function, module_map, export_diff, peer_diff)}

_EDGES = "select distinct caller, callee from (select unnest(call_trace[1:-2]) as caller, unnest(call_trace[2:]) as callee from reachability where len(call_trace) > 1) where caller is not null and callee is not null and caller <> callee"
_NAME = "translate(package_name, '/:-', '...')"
SQL = {
    "call_edges": f"with e as ({_EDGES}) select node, sum(o)::bigint as calls, sum(i)::bigint as called from (select caller as node, 1 as o, 0 as i from e union all select callee, 0, 1 from e) group by node",
    "call_trace_bfs": f"""with recursive e as ({_EDGES}), walk(node, depth) as (select distinct callee, 0 from e where ends_with(callee, ':renderRow') union select e.caller, depth + 1 from walk join e on e.callee = walk.node where depth < 12),
 d as (select node, min(depth) as depth from walk group by node)
 select d.node, d.depth, case when d.depth > 0 then (select min(e.callee) from e join d n on n.node = e.callee where e.caller = d.node and n.depth = d.depth - 1) end as via from d""",
    "graph_cycle": """with recursive e as (select (s_suppkey // 2)::varchar as a, s_suppkey::varchar as b from supplier where s_suppkey // 2 <> s_suppkey union select s_suppkey::varchar, (s_suppkey // 4)::varchar from supplier where s_suppkey % 7 = 0 and s_suppkey // 4 <> s_suppkey),
 walk(node, depth) as (select '1', 0 union select e.b, depth + 1 from walk join e on e.a = walk.node where depth < 40), d as (select node, min(depth) as depth from walk group by node)
 select depth, count(*) as nodes, min(node) as smallest from d group by depth""",
    "symbol_join": "select status, coalesce(list_has_any(list_transform(call_trace, lambda x: string_split(x, ':')[-1]), vulnerable_symbols), false) as symbol_called, count(*) as n from reachability group by all",
    "sink_suffix_match": f"select suffix, count(*) as packages, min(package_name) as smallest from (select package_name, unnest(list_transform(generate_series(1, len(string_split({_NAME}, '.'))), lambda i: array_to_string(string_split({_NAME}, '.')[-i:], '.'))) as suffix from (select distinct package_name from reachability where package_name is not null)) where contains(suffix, '.') group by suffix having count(*) > 1",
    "reachable_status": "select package_name, coalesce(bool_or(len(call_trace) > 1), false) as reachable, count(*) as findings from reachability group by package_name",
    "enclosing_function": "with per as (select l_orderkey as f, l_linenumber as l, min(l_partkey) as p from lineitem group by all) select line, count(*) as calls, sum(name)::bigint as name_sum from (select c.f, c.p, c.l as line, arg_min(d.p, d.l) as name from per c join per d on c.f = d.f and c.l between d.l and d.l + d.p % 4 group by c.f, c.p, c.l) group by line",
    "module_map": r"select stem, min(path) as path, count(*) as files from (select distinct string_split(n, ':')[1] as path, regexp_extract(string_split(n, ':')[1], '([^/]+?)(?:\.[^./]+)?$', 1) as stem from (select unnest(call_trace) as n from reachability) where n is not null) group by stem",
    "export_diff": "with r as (select lower(trim(source)) as s, unnest(affected_packages) as p from cve), a as (select p.name as name, count(*) as n from r where s = 'nvd' and p.name is not null group by all), b as (select p.name as name, count(*) as n from r where s = 'github' and p.name is not null group by all) select coalesce(a.name, b.name) as name, case when b.name is null then 'removed' when a.name is null then 'added' else 'changed' end as change from a full join b on a.name = b.name where a.name is null or b.name is null or a.n is distinct from b.n",
    "peer_diff": "select case when o = n then 'same' when o > n then 'lower' else 'higher' end as change, count(*) as users from (select (arg_min(props, event_id)::json ->> '$.k')::bigint as o, (arg_max(props, event_id)::json ->> '$.k')::bigint as n from events group by user_id) group by 1",
}
