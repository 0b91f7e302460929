"""Version texts as comparable keys, in the dialects that the sources use, and range predicates over them.

Keys are ``array<bigint>``, which compare element by element and then by length, so every comparison stays inside
generated code. Each builder has a twin that gives the same expression as SQL text, for checks against another engine.
A run of digits too long for BIGINT counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: markers of pre- and post-releases that the range dialect drops.
SUFFIX = r"[-_](alpha|beta|rc|dev|pre|post)\.?[0-9]*"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)).try_cast("array<bigint>")


def _or_zero(key: Column) -> Column:
    return F.when(F.size(key) > 0, key).otherwise(F.array(F.lit(0).cast("bigint")))


def range_key(version: Column) -> Column:
    """All digit runs without release markers, not padded: ``5.4`` is below ``5.4.0``. No digits: 0."""
    return _or_zero(_runs(F.regexp_replace(version, f"(?i){SUFFIX}", "")))


def plain_key(version: Column) -> Column:
    """All digit runs, not padded; no digits: empty."""
    return _runs(version)


def first_three(version: Column) -> Column:
    """The first three digit runs; no digits: 0."""
    return _or_zero(F.slice(_runs(version), 1, 3))


def stripped_three(version: Column) -> Column:
    """``first_three`` after one leading ``v`` or ``=``."""
    return first_three(F.regexp_replace(version, "^[vV=]", ""))


def semver(version: Column) -> Column:
    """major, minor, patch of a text that starts with them after one ``v`` or ``=``; null if it doesn't."""
    v = F.regexp_replace(version, "^[vV=]", "")
    part = lambda i: F.coalesce(F.regexp_extract(v, r"^([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", i).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(v.rlike("^[0-9]"), F.array(part(1), part(2), part(3)))


def dotted_three(version: Column) -> Column:
    """The all-digit ones of the first three dotted parts, zeros added to three."""
    kept = F.filter(F.slice(F.split(version, r"\."), 1, 3), lambda x: x.rlike("^[0-9]+$"))
    nums = F.transform(kept, lambda x: x.try_cast("bigint"))
    return F.slice(F.concat(nums, F.array_repeat(F.lit(0).cast("bigint"), 3)), 1, 3)


def major(version: Column) -> Column:
    """The first digit run, or null."""
    return F.regexp_extract(version, "([0-9]+)", 1).try_cast("bigint")


def is_major_upgrade(old: Column, new: Column) -> Column:
    return F.coalesce(major(new) > major(old), F.lit(False))


def conditions(ranges: Column) -> Column:
    """The comma-separated conditions of a range as structs of operator and bound; parse a range once, compare it often.

    An operator that is not one of ``>= <= > < == = !=`` is read as equality of the digit runs.
    """
    parts = F.filter(F.transform(F.split(ranges, ","), lambda c: F.trim(c)), lambda c: c != "")
    op = r"^(>=|<=|==|!=|>|<|=)?"
    return F.transform(parts, lambda c: F.struct(F.regexp_extract(c, op, 1).alias("op"), range_key(F.regexp_replace(c, op, "")).alias("bound")))


def holds(key: Column, parsed: Column) -> Column:
    """Whether the key of a version meets all parsed conditions; a null key or no condition holds nothing."""

    def one(c: Column) -> Column:
        op, bound = c["op"], c["bound"]
        return F.when(op == ">=", key >= bound).when(op == "<", key < bound).when(op == "<=", key <= bound).when(op == ">", key > bound).when(op == "!=", key != bound).otherwise(key == bound)

    return F.coalesce((F.size(parsed) > 0) & F.forall(parsed, one), F.lit(False))


def in_range(version: Column, ranges: Column) -> Column:
    """All comma-separated conditions of ``ranges`` hold; an empty or null version or range holds nothing."""
    return F.coalesce(version != "", F.lit(False)) & holds(range_key(version), conditions(ranges))


def padded(key: Column, n: int = 3) -> Column:
    """``key`` with zeros added to ``n`` parts."""
    return F.concat(key, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(n) - F.size(key))))


def after_upto(version: Column, old: Column, new: Column) -> Column:
    """old < version <= new by the padded first three runs."""
    v, a, b = (padded(stripped_three(x)) for x in (version, old, new))
    return (a < v) & (v <= b)


# --- the same as SQL text -----------------------------------------------------------------------------------------


def _sql_runs(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[0-9]+'), lambda t: try_cast(t as bigint))"


def _sql_or_zero(x: str) -> str:
    return f"(case when len({x}) > 0 then {x} when {x} is not null then [0::bigint] end)"


def sql_range_key(x: str) -> str:
    return _sql_or_zero(_sql_runs(f"regexp_replace({x}, '(?i){SUFFIX}', '', 'g')"))


def sql_plain_key(x: str) -> str:
    return _sql_runs(x)


def sql_first_three(x: str) -> str:
    return _sql_or_zero(_sql_runs(x) + "[1:3]")


def sql_stripped_three(x: str) -> str:
    return sql_first_three(f"regexp_replace({x}, '^[vV=]', '')")


def sql_semver(x: str) -> str:
    v = f"regexp_replace({x}, '^[vV=]', '')"
    part = lambda i: f"coalesce(try_cast(regexp_extract({v}, '^([0-9]+)(?:\\.([0-9]+))?(?:\\.([0-9]+))?', {i}) as bigint), 0)"
    return f"case when regexp_matches({v}, '^[0-9]') then [{part(1)}, {part(2)}, {part(3)}] end"


def sql_dotted_three(x: str) -> str:
    return f"list_concat(list_transform(list_filter(string_split({x}, '.')[1:3], lambda t: regexp_full_match(t, '[0-9]+')), lambda t: try_cast(t as bigint)), [0::bigint, 0::bigint, 0::bigint])[1:3]"


def sql_major(x: str) -> str:
    return f"try_cast(regexp_extract({x}, '([0-9]+)', 1) as bigint)"


def sql_in_range(x: str, r: str) -> str:
    conditions = f"list_filter(list_transform(string_split({r}, ','), lambda c: trim(c)), lambda c: c <> '')"
    key, bound = sql_range_key(x), sql_range_key("regexp_replace(c, '^(>=|<=|==|!=|>|<|=)', '')")
    op = "regexp_extract(c, '^(>=|<=|==|!=|>|<|=)?', 1)"
    one = f"case {op} when '>=' then {key} >= {bound} when '<=' then {key} <= {bound} when '>' then {key} > {bound} when '<' then {key} < {bound} when '!=' then {key} <> {bound} else {key} = {bound} end"
    return f"coalesce({x} <> '' and len({conditions}) > 0 and len(list_filter({conditions}, lambda c: not ({one}))) = 0, false)"
