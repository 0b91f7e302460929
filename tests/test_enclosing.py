from riskloom.plans import graphs


def test_odd_lines_are_calls_too(spark, tmp_path):
    rows = [(1, n, 10 * n, None, 0, 1.0) for n in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_shipdate timestamp, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    # spans: 10 over lines 1 to 3, 20 over line 2, 30 over lines 3 to 5; the first that holds a line counts
    assert {tuple(r) for r in graphs.enclosing_function(spark, str(tmp_path)).collect()} == {(1, 1, 10), (2, 1, 10), (3, 1, 10)}
