"""Uses of imported symbols and what they reach, out of the facts of source files (``sources.code``).

Everything is an equality join within a repository and file: uses with the names that imports bind, calls with the
definitions of their own file and of the files that imports name. A call keeps the name that it resolves to; names
that no file of the repository defines are external and are met with sinks by their dotted suffixes.

Defined results: files without facts give nothing; a name that several imports of a file bind stands for the smallest
target; repeated facts count once; a call outside of any definition belongs to ``<module>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graphs import distances, innermost, suffixes

MODULE = "<module>"
_FILE = ("repo_id", "path")


def bindings(facts: DataFrame) -> DataFrame:
    """repo_id, path, name, target: what each local name of a file stands for."""
    return facts.filter("kind = 'bind'").groupBy(*_FILE, "name").agg(F.min("detail").alias("target"))


def usages(facts: DataFrame) -> DataFrame:
    """repo_id, path, line, name, target, how: every use of an imported name."""
    uses = facts.filter("kind = 'use'").select(*_FILE, "line", "name", F.col("detail").alias("how")).distinct()
    return uses.join(bindings(facts), [*_FILE, "name"]).select(*_FILE, "line", "name", "target", "how")


def stem(path: Column) -> Column:
    """What an import of a file names: its name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def resolved_calls(facts: DataFrame) -> DataFrame:
    """repo_id, path, line, call, target: calls with the first part replaced by what it is bound to."""
    calls = facts.filter("kind = 'call'").select(*_FILE, "line", F.col("name").alias("call")).distinct()
    first = F.substring_index("call", ".", 1)
    rest = F.substring(F.col("call"), F.length(first) + 1, F.length("call"))
    names = bindings(facts).withColumnRenamed("name", "_first")
    return calls.withColumn("_first", first).withColumn("_rest", rest).join(names, [*_FILE, "_first"], "left").select(
        *_FILE, "line", "call", F.coalesce(F.concat("target", "_rest"), "call").alias("target")
    )


def call_edges(facts: DataFrame) -> DataFrame:
    """repo_id, caller, callee: distinct; nodes are ``path:definition``, callees that no file defines keep their names."""
    defs = facts.filter("kind = 'def'").select(*_FILE, "name", "line", "end_line", "ord")
    calls = resolved_calls(facts)
    file = F.concat_ws("\x01", *_FILE)
    around = innermost(
        defs.select(file.alias("file"), "name", F.col("line").alias("start"), F.col("end_line").alias("end"), "ord"),
        calls.select(file.alias("file"), F.col("target").alias("call"), "line").distinct(), first=False,
    ).select(F.col("file").alias("_f"), F.col("call").alias("_c"), F.col("line").alias("_l"), F.col("name").alias("owner"))
    calls = calls.withColumn("_file", file).join(around, (F.col("_file") == F.col("_f")) & (F.col("target") == F.col("_c")) & (F.col("line") == F.col("_l")), "left")
    calls = calls.select(*_FILE, "target", F.concat("path", F.lit(":"), F.coalesce("owner", F.lit(MODULE))).alias("caller"))
    # a definition of the same file, or of the file that the first part of the target names
    own = defs.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), F.col("name").alias("_d")).distinct()
    module = defs.select(F.col("repo_id").alias("_o"), stem(F.col("path")).alias("_m"), F.col("name").alias("_g"), F.concat("path", F.lit(":"), "name").alias("node")).groupBy("_o", "_m", "_g").agg(F.min("node").alias("there"))
    parts = F.split(F.regexp_replace("target", r"^[./]+", ""), r"[./]")
    calls = calls.withColumn("_last", F.element_at(parts, -1)).withColumn("_before", F.try_element_at(parts, F.lit(-2)))
    here = calls.join(own, (F.col("repo_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("target") == F.col("_d")), "left")
    found = here.join(module, (F.col("repo_id") == F.col("_o")) & (F.col("_before") == F.col("_m")) & (F.col("_last") == F.col("_g")), "left")
    callee = F.when(F.col("_d").isNotNull(), F.concat("path", F.lit(":"), "target")).otherwise(F.coalesce("there", "target"))
    return found.select("repo_id", "caller", callee.alias("callee")).distinct()


def reached(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """repo_id, node, depth, via: definitions from which calls lead to a sink, with fewest calls and the next node.

    ``sinks``: name, dotted. A callee meets a sink if one is a dotted suffix of the other, parts whole.
    """
    node = lambda c: F.concat_ws("\x01", "repo_id", c)
    callees = edges.select("repo_id", "callee").distinct()
    by_callee = callees.select("repo_id", "callee", F.explode(suffixes(F.col("callee"))).alias("_s"))
    names = sinks.filter("name is not null and name <> ''").select("name").distinct()
    by_sink = names.select(F.explode(suffixes(F.col("name"))).alias("_s")).filter("instr(_s, '.') > 0").distinct()
    starts = by_callee.join(names, F.col("_s") == F.col("name"), "left_semi").select("repo_id", "callee")
    starts = starts.unionByName(callees.join(by_sink, F.col("callee") == F.col("_s"), "left_semi").select("repo_id", "callee")).distinct()
    found = distances(edges.select(node("caller").alias("caller"), node("callee").alias("callee")), starts.select(node("callee").alias("n")), reverse=True)
    part = lambda c, i: F.get(F.split(F.col(c), "\x01"), F.lit(i))
    return found.select(part("node", 0).alias("repo_id"), part("node", 1).alias("node"), "depth", part("via", 1).alias("via"))
