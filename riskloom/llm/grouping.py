"""Pairwise matches to groups: one group identifier for everything linked directly or over many steps.

Deterministic Borůvka hooking. Every component selects its smallest outgoing edge; with edges ordered by (smaller
end, greater end) that is the edge to its smallest neighbour, and the selected edges form trees whose only cycles
are pairs that selected the same edge, of which the smaller end becomes the root. Pointer doubling collapses each
tree to its root, edges are relabelled and made distinct, and the next round works on what is left; the number of
components with an edge at least halves in each round. The result does not depend on the order of the input.

Each step is written to the shared folder, so lineage stays short and a lost executor costs one task. Steps that
look up a label go through ``session.lookup``: a label that holds a great part of all rows (the hub of a star) is
answered by a broadcast of its own single row. Round maps shrink by half and are composed backwards.

Defined results: a pair with a null or equal ends links nothing; repeated and reversed pairs count once; an empty
table of pairs leaves every record alone in its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.functions.identifiers import normal_form
from riskloom.session import Cuts, lookup


def components(pairs: DataFrame, a: str = "a", b: str = "b", cuts: Cuts | None = None) -> DataFrame:
    """(node, label) of every node that occurs in a pair with another node; the label is the smallest node of its component."""
    cuts = cuts or Cuts(pairs.sparkSession, "boruvka")
    ends = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, left = cuts.counted(ends.distinct())
    maps: list[tuple[DataFrame, int]] = []
    while left:
        parents, n = _select(edges, cuts)
        roots = _collapse(parents, n, cuts)
        maps.append((roots, n))
        step = lookup(edges, "x", roots, "node", left, n).select(F.col("parent").alias("x"), "y")
        step = lookup(step, "y", roots, "node", left, n).select("x", F.col("parent").alias("y"))
        new, left = cuts.counted(step.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        cuts.drop(edges)
        edges = new
    if not maps:
        return edges.select(F.col("x").alias("node"), F.col("x").alias("label")).limit(0)
    label, n = maps.pop()
    while maps:  # node -> root of its round -> label of that root, from the last and smallest round back
        earlier, n_earlier = maps.pop()
        further = label.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        # a root without further edges keeps its label: give it a row of its own, so that the lookup can be an inner one
        alone = earlier.select(F.col("parent").alias("_n")).distinct().join(further, "_n", "left_anti").select("_n", F.col("_n").alias("_p"))
        known, n = cuts.counted(further.unionByName(alone))
        label, n = cuts.counted(lookup(earlier, "parent", known, "_n", n_earlier, n).select("node", F.col("_p").alias("parent")))
    least = label.groupBy(F.col("parent").alias("root")).agg(F.min("node").alias("m"))
    least, roots = cuts.counted(least.select("root", F.least("root", "m").alias("label")))
    return lookup(label, "parent", least, "root", n, roots).select("node", "label")


def _select(edges: DataFrame, cuts: Cuts) -> tuple[DataFrame, int]:
    """(node, parent): the smallest outgoing edge of each component, the smaller end of a doubly selected one as root."""
    both = edges.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(edges.select(F.col("y").alias("node"), F.col("x").alias("other")))
    chosen = both.groupBy("node").agg(F.min("other").alias("parent"))
    # an edge is selected by one of its ends or by both: groups of at most two rows
    ends = chosen.groupBy(F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi")).agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("by"))
    hooks = ends.select(
        F.explode(
            F.when(F.col("times") == 2, F.array(F.struct(F.col("lo").alias("node"), F.col("lo").alias("parent")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("parent")))).otherwise(
                F.array(F.struct(F.col("by").alias("node"), F.when(F.col("by") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("parent")))
            )
        ).alias("h")
    ).select("h.node", "h.parent")
    return cuts.counted(hooks)


def _collapse(parents: DataFrame, n: int, cuts: Cuts) -> DataFrame:
    """Pointer doubling until every node points to the root of its tree."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        seen = Observation()
        new = lookup(parents, "parent", up, "_n", n, n).select("node", F.col("_p").alias("parent"), (F.col("_p") != F.col("parent")).alias("moved"))
        new = cuts.cut(new.observe(seen, F.count_if("moved").alias("moved")))
        moved = seen.get["moved"]
        cuts.drop(parents)
        parents = new.select("node", "parent")
        parents._riskloom_path = new._riskloom_path
        if not moved:
            return parents


def grouped(records: DataFrame) -> DataFrame:
    """id, group_id: one row for each identifier that has a record (``id``, ``aliases``), linked over all aliases."""
    own = normal_form(F.col("id"))
    ids = records.select(own.alias("id")).filter("id is not null").distinct()
    pairs = records.filter(F.size("aliases") > 0).select(own.alias("a"), F.explode("aliases").alias("b")).filter("a is not null").select("a", normal_form(F.col("b")).alias("b"))
    labels = components(pairs)
    return ids.join(labels, ids["id"] == labels["node"], "left").select("id", F.coalesce("label", "id").alias("group_id"))
