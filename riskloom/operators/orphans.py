"""Orphan references: keys that are missing in the parent table, were deleted, or arrive later.

Keyed state is kept in tables of the shared folder, so no key's history is ever held by one task:

* ``parents``: the stored rows of each key, ``cve_id, from_s, to_s, version`` (live from ``from_s`` up to ``to_s``, null = open);
* ``waiting``: the references without a live parent, with their ``reason``, repeated ones repeated;
* ``resolved``: the references with one, a part for each increment with the latest time in it.

``advance`` applies an increment. New references probe the parents. A key whose parents changed has its waiting
references probed again, and those resolved ones that are not earlier than the first change, so that a deletion
reopens them; parts that end before the first change of all are not even read. ``snapshot`` counts the pending
orphans by table, period and reason; ``replay`` runs a whole history through increments and keeps their snapshots.

The probe is an as-of computation: a reference at ``t`` has a live parent exactly if, among the parents with
``from_s <= t``, the greatest ``to_s`` lies after ``t``. Keys and times are reduced to distinct pairs first, so that
of all references to one key on one day at most one a second is left. For these pairs the answer is a running maximum over parents
and times within (key, day), with the maximum of all earlier days from a small table of one row per key and day. No
task ever holds more than the seconds of a day, however many references go to one key.

Defined results: references without a key, or whose key names nothing, are no references; repeated references
count once; a null time has no live parent and none that comes later, hence ``missing`` or ``deleted``; a parent without a
time of storing exists but is never live; empty
tables give an empty result (no parents: every reference is ``missing``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.session import Cuts

OPEN = 9_223_372_036_854_775_807
NEVER = -9_000_000_000_000_000
DAY = 86_400
#: Increments of ``replay``.
INCREMENTS = 3

_REF = ("ref_table", "ref_id", "cve_id", "t")


@dataclass
class OrphanState:
    """``parents``: cve_id, from_s, to_s, version. ``waiting``: ref_table, ref_id, cve_id, t, reason. ``resolved``: parts without reason, each with its latest time."""

    parents: DataFrame
    waiting: DataFrame
    resolved: list[tuple[DataFrame, int]] = field(default_factory=list)

    @property
    def refs(self) -> DataFrame:
        """Every reference with its present reason, null if it has a live parent."""
        out = self.waiting
        for part, _ in self.resolved:
            out = out.unionByName(part.withColumn("reason", F.lit(None).cast("string")))
        return out


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``refs`` (ref_table, ref_id, cve_id, t) with ``reason``: null if a parent is live at ``t``."""
    # a row without a time of storing is there but was never live; of rows stored together the one that lives longest counts
    p = parents.filter("cve_id is not null").groupBy("cve_id", F.coalesce("from_s", F.lit(NEVER)).alias("t")).agg(
        F.max(F.when(F.col("from_s").isNull(), F.lit(NEVER)).otherwise(F.coalesce("to_s", F.lit(OPEN)))).alias("to_s")
    )
    q = refs.select("cve_id", "t").distinct()
    rows = p.withColumn("kind", F.lit(0)).unionByName(q.withColumn("to_s", F.lit(None).cast("bigint")).withColumn("kind", F.lit(1)))
    rows = rows.withColumn("day", F.coalesce(F.floor(F.col("t") / DAY).cast("bigint"), F.lit(-1).cast("bigint")))
    days = rows.groupBy("cve_id", "day").agg(F.max("to_s").alias("day_to"), F.max(F.when(F.col("kind") == 0, F.col("t"))).alias("day_from"))
    before = W.partitionBy("cve_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    # the day of a reference needs the earlier days' maximum even if no parent is of that day
    days = days.select(
        "cve_id", "day", F.max("day_to").over(before).alias("carry"), F.max("day_from").over(W.partitionBy("cve_id")).alias("last_from")
    )
    within = W.partitionBy("cve_id", "day").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.max("to_s").over(within)).filter("kind = 1").join(days, ["cve_id", "day"], "left")
    live = F.coalesce(F.greatest("upto", "carry") > F.col("t"), F.lit(False))
    reason = (
        F.when(F.col("last_from").isNull(), "missing").when(live, F.lit(None)).when(F.col("last_from") > F.col("t"), "late").otherwise("deleted")
    )
    answers = rows.select(F.col("cve_id").alias("_key"), F.coalesce("t", F.lit(NEVER)).alias("_t"), reason.alias("reason"))
    on = (refs["cve_id"] == answers["_key"]) & (F.coalesce(refs["t"], F.lit(NEVER)) == answers["_t"])
    return refs.join(answers, on).select(*(refs[c] for c in _REF), "reason")


def _judged(refs: DataFrame, parents: DataFrame, cuts: Cuts) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """The waiting and the resolved ones of ``refs``."""
    done = cuts.cut(probe(refs, parents))
    live = done.filter("reason is null").drop("reason")
    last = live.agg(F.max("t").alias("t")).first()["t"]
    return done.filter("reason is not null"), [] if last is None else [(live, last)]


def advance(state: OrphanState | None, refs: DataFrame | None, parents: DataFrame | None, cuts: Cuts | None = None) -> OrphanState:
    """The state after an increment of references and of parent rows (a deleted parent comes again with its ``to_s``).

    A parent row that comes again with a ``to_s`` replaces the row of the same ``cve_id, from_s`` (and ``version``, where the
    parents have one) whose ``to_s`` is open; a row that only arrives adds to the history.
    """
    some = refs if refs is not None else parents
    cuts = cuts or Cuts(some.sparkSession, "orphans")
    fresh = None if refs is None else refs.filter("cve_id is not null").select(*_REF)
    if parents is not None:
        parents = parents.filter("cve_id is not null").select("cve_id", "from_s", "to_s", F.col("version") if "version" in parents.columns else F.lit(None).cast("bigint").alias("version"))
    if state is None:
        known = cuts.cut(parents.distinct())
        return OrphanState(known, *_judged(fresh, known, cuts))
    known, waiting, resolved = state.parents, state.waiting, state.resolved
    todo = fresh
    if parents is not None:
        arrived = cuts.cut(parents.distinct())
        same = lambda a, b: (a["cve_id"] == b["_k"]) & a["from_s"].eqNullSafe(b["_f"]) & a["version"].eqNullSafe(b["_v"])
        as_key = lambda df: df.select(F.col("cve_id").alias("_k"), F.col("from_s").alias("_f"), F.col("version").alias("_v")).distinct()
        closing = as_key(arrived.filter("to_s is not null"))
        was_open = as_key(known.filter("to_s is null")).withColumn("_open", F.lit(True))
        # a row that closes a known one changes things from its end on, a new row from its beginning on
        first = F.when(F.col("_open") & F.col("to_s").isNotNull(), F.col("to_s")).otherwise(F.coalesce("from_s", F.lit(OPEN)))
        changed = cuts.cut(arrived.join(was_open, same(arrived, was_open), "left").groupBy("cve_id").agg(F.min(first).alias("first")))
        kept = known.filter("to_s is null").join(closing, same(known, closing), "left_anti").unionByName(known.filter("to_s is not null"))
        known = cuts.cut(kept.unionByName(arrived).distinct())
        start = changed.agg(F.min("first").alias("t")).first()["t"]
        again = waiting.join(changed, "cve_id", "left_semi").select(*_REF)
        waiting = waiting.join(changed, "cve_id", "left_anti").select(*_REF, "reason")
        resolved = []
        for part, last in state.resolved:
            if start is None or last < start:
                resolved.append((part, last))
                continue
            part = part.join(changed, "cve_id", "left").withColumn("_again", F.coalesce(F.col("t") >= F.col("first"), F.lit(False)))
            part = cuts.cut(part.select(*_REF, "_again"))
            again = again.unionByName(part.filter("_again").drop("_again"))
            resolved.append((part.filter("not _again").drop("_again"), last))
        todo = again if fresh is None else fresh.unionByName(again)
    if todo is None:
        return state
    more, parts = _judged(todo, known, cuts)
    return OrphanState(known, waiting.unionByName(more), resolved + parts)


def pending(state: OrphanState) -> DataFrame:
    """The orphans: ref_table, ref_id, cve_id, period (UTC month), reason."""
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / DAY).cast("int")), "yyyy-MM")
    return state.waiting.select("ref_table", "ref_id", "cve_id", month.alias("period"), "reason").distinct()


def snapshot(state: OrphanState) -> DataFrame:
    """Number of pending orphans by table, period and reason."""
    return pending(state).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def replay(refs: DataFrame, parents: DataFrame, increments: int = INCREMENTS, snapshots: bool = False) -> tuple[OrphanState, DataFrame | None]:
    """The state after a history in ``increments`` of equal length between the first and the last time a parent was stored,
    and, if wanted, the snapshots after each: increment, ref_table, period, reason, orphans.

    An increment brings the references of its time, the parents stored and the deletions done in it. References and
    parents without a time come with the first.
    """
    cuts = Cuts(refs.sparkSession, "orphans")
    parents = cuts.cut(parents.filter("cve_id is not null").select("cve_id", "from_s", "to_s").distinct())
    span = parents.agg(F.min("from_s").alias("a"), F.max("from_s").alias("b")).first()
    a, b = (span["a"], span["b"]) if span["a"] is not None else (0, 0)
    ends = [a + (b - a) * (i + 1) // increments for i in range(increments - 1)]

    def number(t: str):
        out = F.lit(len(ends))
        for i, end in reversed(list(enumerate(ends))):
            out = F.when(F.col(t) <= end, i).otherwise(out)
        return F.when(F.col(t).isNull(), 0).otherwise(out)

    came = parents.withColumn("_i", number("from_s")).withColumn("_j", F.when(F.col("to_s").isNull(), None).otherwise(F.greatest("_i", number("to_s"))))
    refs = cuts.cut(refs.filter("cve_id is not null").select(*_REF, number("t").alias("_i")), "_i")
    state, kept = None, None
    for i in range(increments):
        stored = came.filter(F.col("_i") == i).select("cve_id", "from_s", F.when(F.col("_j") == i, F.col("to_s")).alias("to_s"), F.col("to_s").alias("version"))
        deleted = came.filter((F.col("_j") == i) & (F.col("_i") < i)).select("cve_id", "from_s", "to_s", F.col("to_s").alias("version"))
        state = advance(state, refs.filter(F.col("_i") == i), stored.unionByName(deleted), cuts)
        if snapshots:
            counts = cuts.cut(snapshot(state).select(F.lit(i + 1).alias("increment"), "ref_table", "period", "reason", "orphans"))
            kept = counts if kept is None else kept.unionByName(counts)
    return state, kept
