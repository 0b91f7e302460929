from riskloom.plans import versions


def test_changes_meet_updates_of_their_package(spark, tmp_path):
    titles = [(1, "Bump a-b from 1.0.0 to 2.0.0"), (2, "Bump A_b from 1.9.0 to 1.9.5"), (3, "Bump c from 1.0.0 to 9.0.0 in /x"), (4, "Update c to v2"), (5, None)]
    spark.createDataFrame(titles, "rec_id bigint, title string").write.parquet(f"{tmp_path}/github_pr_dependabot.parquet")
    # parts 0 and 2 are of a_b, 1 and 3 of c; sizes 9, 10, 17 and 8 are 1.9.0, 2.10.0, 1.17.0 and 0.8.0
    spark.createDataFrame([(0, 9), (1, 10), (2, 17), (3, 8)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in versions.known_changes(spark, str(tmp_path)).select("p_partkey", "package", "changed_in", "updates", "first_rec_id").collect()}
    assert got == {(0, "a_b", "1.9.0", 1, 1), (1, "c", "2.10.0", 1, 3), (2, "a_b", "1.17.0", 1, 1)}
