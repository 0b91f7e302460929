from riskloom.plans import advisories


def test_lists_of_every_shape_are_read(spark, tmp_path):
    g = "GHSA-abcd-1234-efgh"
    old = {
        "all fixed": ['["CVE-2020-0001", "CVE-2020-0002"]'], "objects": ['[{"id": "CVE-2020-0001"}]'], "inside": ['"[\\"CVE-2020-0001\\"]"'], "plain": [f"cve-2020-0001, {g}; PYSEC-2020-7"],
        "dashes": ['["CVE‑2020‑0001"]'], "same": [f'["{g}"]'], "stand-in": ['["CVE-0000-0000"]'],
    }
    new = {"same": g.upper(), "objects": '[{"id": "CVE-2020-0009"}]'}
    rows = [(p, "1.0", c) for p, cs in old.items() for c in cs] + [(p, "2.0", new.get(p, "[]")) for p in old] + [("all fixed", "1.5", '["CVE-2020-0003"]'), ("one", "1.0", '["CVE-2020-0001"]')]
    spark.createDataFrame(rows, "package_name string, version string, cve_ids string").write.parquet(f"{tmp_path}/package_queries.parquet")
    got = {r["package_name"]: r["fixed"] for r in advisories.cves_fixed(spark, str(tmp_path)).collect()}
    assert got == {"all fixed": 2, "objects": 1, "inside": 1, "plain": 3, "dashes": 1}
