from riskloom.plans import stores

NOW = stores.AS_OF


def test_all_writes_are_upserted(spark, tmp_path):
    late = NOW + 5
    rows = [(1, "npm", "a", "1", "[]", NOW - 9, NOW), (2, "NPM", "a", "1", "[]", late, late), (3, "npm", "b", None, "[]", late * 1000, late * 1000)]
    spark.createDataFrame(rows, "id bigint, ecosystem string, package_name string, version string, cve_ids string, cached_at bigint, expires_at bigint").write.parquet(f"{tmp_path}/package_queries.parquet")
    assert {(r["package_name"], r["id"], r["cached_at"]) for r in stores.package_cache(spark, str(tmp_path)).collect()} == {("a", 2, late), ("b", 3, late)}
    rows = [("x", "{}", "osv", NOW - 9, 1, None), ("x", "{}", "nvd", late, late + 9, None), ("y", "{}", "osv", late, 1, None)]
    spark.createDataFrame(rows, "cve_id string, data string, source string, cached_at bigint, expires_at bigint, deleted_at bigint").write.parquet(f"{tmp_path}/cve_cache.parquet")
    assert {(r["cve_id"], r["source"]) for r in stores.cache_upsert(spark, str(tmp_path)).collect()} == {("x", "nvd"), ("y", "osv")}
    assert [r["cve_id"] for r in stores.cache_valid(spark, str(tmp_path)).collect()] == ["x"]
    assert {tuple(r) for r in stores.cache_stats(spark, str(tmp_path)).collect()} == {("nvd", 1, 1, 0), ("osv", 1, 0, 1)}
