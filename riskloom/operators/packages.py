"""Differences between two versions of a package: exports, metadata, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from riskloom.functions.versions import major

_CHANGE = "struct<kind:string,name:string,detail:string>"


def _rows(*lists: Column) -> Column:
    """One list of changes out of lists that may be null."""
    return F.flatten(F.array(*(F.coalesce(x, F.array().cast(f"array<{_CHANGE}>")) for x in lists)))


def _change(kind: str, name: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _when(test: Column, change: Column) -> Column:
    return F.when(test, F.array(change))


def export_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """package, kind, name, detail: exports (package, name, sort, parameters, returns) that were removed or changed.

    A name exported more than once counts with its greatest sort. Added exports break nothing and give no row.
    """
    side = lambda t, p: t.groupBy("package", "name").agg(F.max(F.struct("sort", "parameters", "returns")).alias(p))
    j = side(old, "o").join(side(new, "n"), ["package", "name"], "left")
    lost = F.transform(F.array_except(F.coalesce("o.parameters", F.array().cast("array<string>")), F.coalesce("n.parameters", F.array().cast("array<string>"))), lambda x: _change("removed_parameter", F.col("name"), x))
    found = _rows(
        _when(F.col("n").isNull(), _change("removed_export", F.col("name"), F.col("o.sort"))),
        F.when(F.col("n").isNotNull(), lost),
        _when(F.col("n").isNotNull() & ~F.col("o.returns").eqNullSafe(F.col("n.returns")), _change("changed_return", F.col("name"), F.col("n.returns"))),
        _when(F.col("n").isNotNull() & (F.col("o.sort") != F.col("n.sort")), _change("changed_sort", F.col("name"), F.col("n.sort"))),
    )
    return j.select("package", F.explode(found).alias("c")).select("package", "c.*")


def requirement_changes(old: Column, new: Column, kind: str) -> Column:
    """Changes between two maps of requirements: new keys, and common keys whose major version grew."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    grew = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k) | (F.coalesce(major(v) > major(F.try_element_at(a, k)), F.lit(False))))
    return F.transform(F.map_entries(grew), lambda e: _change(kind, e["key"], e["value"]))


def metadata_changes(pairs: DataFrame) -> DataFrame:
    """package, kind, name, detail of version pairs.

    ``pairs``: package; old_/new_ of: peers, engines (maps), types, main, deprecated (texts), exports (list of paths),
    size, files (numbers), dependencies (list).
    """
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    shrunk = lambda c, r: F.coalesce(F.col(f"new_{c}") < F.col(f"old_{c}") * r, F.lit(False))
    lost = lambda c: F.array_except(f"old_{c}", F.coalesce(F.col(f"new_{c}"), F.array().cast("array<string>")))
    found = _rows(
        requirement_changes(F.col("old_peers"), F.col("new_peers"), "peer"), requirement_changes(F.col("old_engines"), F.col("new_engines"), "engine"),
        _when(has("new_deprecated") & ~has("old_deprecated"), _change("deprecated", F.col("package"), F.col("new_deprecated"))),
        _when(has("old_types") & ~has("new_types"), _change("types_removed", F.col("package"))), _when(has("old_main") & has("new_main") & (F.col("old_main") != F.col("new_main")), _change("main_moved", F.col("package"), F.col("new_main"))),
        F.transform(lost("exports"), lambda x: _change("export_path_removed", x)), _when(shrunk("size", 0.7), _change("smaller", F.col("package"))), _when(shrunk("files", 0.8), _change("fewer_files", F.col("package"))),
        _when(F.coalesce(F.size(lost("dependencies")) >= 3, F.lit(False)), _change("dependencies_removed", F.col("package"), F.size(lost("dependencies")))),
    )
    return pairs.select("package", F.explode(found).alias("c")).select("package", "c.*")


@F.arrow_udf(ArrayType(StringType()))
def export_paths(exports):
    """Paths of all text leaves of a nested ``exports`` object given as JSON text, through conditions of any depth; null if it is no object."""
    import json

    import pyarrow as pa

    def paths(text):
        try:
            root = json.loads(text) if text else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(root, dict):
            return None
        out, stack = [], [((), root)]
        while stack:
            path, x = stack.pop()
            if isinstance(x, dict):
                stack += [((*path, k), y) for k, y in reversed(x.items())]
            else:
                out.append("/".join(path))
        return out

    return pa.array([paths(x) for x in exports.to_pylist()], pa.list_(pa.string()))
