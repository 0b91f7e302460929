"""Call graphs: resolving calls, matching sinks, and shortest traces from entry points, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import Cuts


def path_edges(traces: DataFrame, trace: str) -> DataFrame:
    """Distinct (caller, callee) of neighbouring nodes in recorded traces."""
    pairs = F.transform(F.slice(F.col(trace), 1, F.greatest(F.size(trace) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("caller"), F.get(F.col(trace), i + 1).alias("callee")))
    return traces.filter(F.size(trace) > 1).select(F.explode(pairs).alias("e")).select("e.caller", "e.callee").filter("caller is not null and callee is not null and caller <> callee").distinct()


def distances(edges: DataFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, depth, via): fewest steps from any start, and the smallest neighbour one step nearer.

    Breadth-first by levels: the frontier joins the edges, known nodes are left out, of several ways the smallest
    neighbour is kept. Each level is a table of its own in the shared folder, so lineage stays short and no level is
    written twice. Cycles end by themselves, and there are as many levels as the graph has.
    """
    cuts = Cuts(edges.sparkSession, "levels")
    a, b = ("callee", "caller") if reverse else ("caller", "callee")
    steps = cuts.cut(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct())
    level, n = cuts.counted(starts.select(F.col(starts.columns[0]).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).filter("node is not null").distinct())
    seen, depth = level, 0
    while n:
        depth += 1
        found = level.join(steps, F.col("node") == F.col("_a")).groupBy(F.col("_b").alias("node")).agg(F.min("_a").alias("via"))
        level, n = cuts.counted(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "via"))
        seen = seen.unionByName(level)
    return seen


def suffixes(name: Column) -> Column:
    """All dotted suffixes of a name, so that a suffix match becomes an equality."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))


def innermost(definitions: DataFrame, calls: DataFrame, first: bool = True) -> DataFrame:
    """The definition each call lies in: of those of its file that span its line, the first in order (the outermost).

    ``definitions``: file, name, start, end, ord; ``calls``: file, call, line.
    """
    spans = definitions.select(F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("ord").alias("_ord"))
    on = (F.col("file") == F.col("_file")) & F.col("line").between(F.col("_start"), F.col("_end"))
    j = calls.select("file", "call", "line").join(spans, on)
    pick = F.min_by if first else F.max_by
    return j.groupBy("file", "call", "line").agg(pick("_name", "_ord").alias("name"))


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): what was removed, added or changed between two versions; null values compare as values."""
    a = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_o"))
    b = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_n"))
    change = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")
