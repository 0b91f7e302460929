from riskloom.plans import scans


def test_union_has_all_seven_ecosystems(spark, tmp_path):
    names = ["npm", "pypi", "go", "rubygems", "maven", "cargo", "composer"]
    rows = [(i, n.upper() if i == 6 else n, "p", None) for i, n in enumerate(names)] + [(9, "composer", "q", "1")]
    spark.createDataFrame(rows, "id bigint, ecosystem string, package_name string, version string").write.parquet(f"{tmp_path}/package_queries.parquet")
    got = {r["ecosystem"]: (r["source_seq"], r["rows"], r["packages"], r["unversioned"]) for r in scans.dep_scan_union(spark, str(tmp_path)).collect()}
    assert got == {n: (i, 1, 1, 1) for i, n in enumerate(names[:6])} | {"composer": (6, 2, 2, 1)}
    assert {r["ecosystem"] for r in scans.dep_scan_union(spark, str(tmp_path), exclude=("npm",)).collect()} == set(names[1:])
