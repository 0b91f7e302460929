import json

from pyspark.sql import functions as F

from riskloom.functions import labels, versions
from riskloom.operators.advisories import affected_counts
from riskloom.operators.packages import export_changes, export_paths, metadata_changes
from riskloom.sources.feeds import github_rows, gitlab_rows, range_ends


def test_forge_feeds(spark):
    node = {"advisory": {"ghsaId": "GHSA-1", "summary": "s", "description": "", "severity": "MODERATE", "cvss": {"score": 0.0, "vectorString": None}, "references": [{"url": "u"}, {}], "identifiers": [{"type": "GHSA", "value": "GHSA-1"}, {"type": "CVE", "value": "CVE-1"}]}, "package": {"ecosystem": "PIP", "name": "x"}, "vulnerableVersionRange": ">= 1.0, < 2.0", "firstPatchedVersion": {"identifier": "2.0"}}
    df = spark.createDataFrame([(json.dumps({"data": {"securityVulnerabilities": {"nodes": [node, None, {}]}}}),), ("{",), (None,)], "p string")
    (r,) = github_rows(df, "p").collect()
    assert (r["id"], r["description"], r["severity"], r["cvss_score"], r["references"]) == ("CVE-1", "s", "medium", None, ["u"])
    assert tuple(r["affected"][0]) == ("pypi", "x", "1.0", "2.0", "2.0")
    gl = spark.createDataFrame([(json.dumps({"id": "7", "title": "t", "severity": "info", "package_slug": "gem/a/b", "affected_range": ">=1,<2||=3", "fixed_versions": ["2"]}),), ("x",)], "p string")
    (r,) = gitlab_rows(gl, "p").collect()
    assert (r["id"], r["severity"]) == ("GITLAB-7", "none") and tuple(r["affected"][0]) == ("rubygems", "b", "1", "2", "2")


def test_range_ends(spark):
    df = spark.createDataFrame([(">= 1.0, < 2.0",), ("= 3",), ("<=4.1",), (None,), ("",)], "r string")
    assert [tuple(x["e"]) for x in df.select(range_ends(F.col("r")).alias("e")).collect()] == [("1.0", "2.0"), ("3", "3"), (None, "4.1"), (None, None), (None, None)]


def test_in_range(spark):
    cases = [("5.4", "<5.4.0", True), ("1.2.3", ">=1.0,<2.0", True), ("2.0", ">=1.0,<2.0", False), ("1.0-rc1", "=1.0", True), ("1.0", "", False), ("", ">=1", False), (None, ">=1", False), ("1.0", None, False), ("1.30", "<1.31,>=1.30", True), ("1.10", ">1.9", True), ("3", "!=3", False), ("2.5", "~=2.5", True)]
    df = spark.createDataFrame(cases, "v string, r string, want boolean")
    assert df.filter(versions.in_range(F.col("v"), F.col("r")) != F.col("want")).collect() == []


def test_labels(spark):
    row = spark.range(1).select(labels.slug(F.lit("SQL injection (generic)")), labels.hcl_string(F.lit('a"b\\c')), labels.severity_rank(F.lit("HIGH")), labels.severity_of_score(F.lit(float("nan"))), labels.normal_package(F.lit("My-Pkg.x"), F.lit("pypi"))).first()
    assert tuple(row) == ("sql-injection-generic", 'a\\"b\\\\c', 4, "unknown", "my_pkg_x")


def test_affected_counts_against_pairs(spark):
    import random

    r = random.Random(2)
    v = lambda: f"{r.randrange(4)}.{r.randrange(6)}"
    deps = [(i, "npm", r.choice("ab"), r.choice([None, v()])) for i in range(80)]
    ranges = [("npm", r.choice("ab"), r.choice([None, "0", v()]), r.choice([None, v()])) for _ in range(60)] + [(None, "a", "0", None)]
    got = {x["dep_id"]: x["advisories"] for x in affected_counts(spark.createDataFrame(deps, "dep_id bigint, ecosystem string, name string, version string"), spark.createDataFrame(ranges, "ecosystem string, name string, introduced string, fixed string")).collect()}
    key = lambda t: [int(x) for x in t.split(".")]
    want = {i: sum(e == x[0] and n == x[1] and key(x[2] or "0") <= key(t) and (x[3] is None or key(t) < key(x[3])) for x in ranges) for i, e, n, t in deps if t}
    assert got == want


def test_package_differences(spark):
    e = "package string, name string, sort string, parameters array<string>, returns string"
    old = spark.createDataFrame([("p", "gone", "function", [], None), ("p", "f", "function", ["a", "b"], "int"), ("p", "same", "class", None, None)], e)
    new = spark.createDataFrame([("p", "f", "function", ["a"], None), ("p", "same", "class", None, None), ("p", "more", "class", None, None)], e)
    assert {(r["kind"], r["name"], r["detail"]) for r in export_changes(old, new).collect()} == {("removed_export", "gone", "function"), ("removed_parameter", "f", "b"), ("changed_return", "f", None)}
    m = "package string, old_peers map<string,string>, new_peers map<string,string>, old_engines map<string,string>, new_engines map<string,string>, old_types string, new_types string, old_main string, new_main string, old_deprecated string, new_deprecated string, old_exports array<string>, new_exports array<string>, old_size bigint, new_size bigint, old_files bigint, new_files bigint, old_dependencies array<string>, new_dependencies array<string>"
    rows = [("p", {"react": "^17"}, {"react": "^18", "vue": "3"}, {"node": ">=10"}, {"node": ">=10"}, "t", "", "a", "b", None, "old", ["."], [], 100, 60, 10, 9, ["a", "b", "c"], None), ("q", *[None] * 18)]
    got = {(r["kind"], r["name"]) for r in metadata_changes(spark.createDataFrame(rows, m)).collect()}
    assert got == {("peer", "react"), ("peer", "vue"), ("deprecated", "p"), ("types_removed", "p"), ("main_moved", "p"), ("export_path_removed", "."), ("smaller", "p"), ("dependencies_removed", "p")}
    x = spark.createDataFrame([('{".": "./a.js", "./b": {"import": "x", "node": {"require": "y"}}}',), (None,), ("{",)], "x string").select(export_paths(F.col("x")).alias("p")).collect()
    assert set(x[0]["p"]) == {".", "./b/import", "./b/node/require"} and x[1]["p"] is None and x[2]["p"] is None
