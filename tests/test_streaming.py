from riskloom.streaming.ttl import current, once_per, sessions, upsert_into, windowed


def batches(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, v int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema("k string, v int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def ts(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


ROWS = [
    [("a", 1, ts("2024-01-01T00:00:00")), ("a", 2, ts("2024-01-01T00:05:00")), ("b", 3, ts("2024-01-01T00:01:00"))],
    [("a", 4, ts("2024-01-01T02:00:00")), ("b", 5, ts("2024-01-01T00:10:00")), (None, 6, ts("2024-01-01T02:00:00"))],
    [("a", 7, ts("2024-01-03T00:00:00"))],
]


def drained(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_once_per(spark, tmp_path):
    got = drained(spark, once_per(batches(spark, tmp_path, ROWS), ["k"], "ts", "1 hour"), "once")
    assert sum(r["k"] == "b" for r in got) == 1 and sum(r["k"] is None for r in got) == 1
    assert [r["v"] for r in got if r["k"] == "a"][0] == 1


def test_windows(spark, tmp_path):
    got = {(str(r["start"]), r["k"]): r["n"] for r in drained(spark, windowed(batches(spark, tmp_path, ROWS), "ts", ["k"], "1 hour", "10 minutes"), "win")}
    assert got[("2024-01-01 00:00:00", "a")] == 2 and got[("2024-01-01 02:00:00", "a")] == 1


def test_sessions(spark, tmp_path):
    got = [(r["k"], r["n"]) for r in drained(spark, sessions(batches(spark, tmp_path, ROWS), "ts", ["k"], "30 minutes", "10 minutes"), "ses")]
    assert ("a", 2) in got


def test_upsert_sink(spark, tmp_path):
    out = str(tmp_path / "table")
    q = batches(spark, tmp_path, ROWS).writeStream.foreachBatch(upsert_into(out, ["k"], ["ts", "v"])).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["v"]) for r in current(spark, out).collect()} == {("a", 7), ("b", 5), (None, 6)}


def test_upsert_again_and_from_a_new_checkpoint(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, ts timestamp")
    held = lambda: {(r["k"], r["v"]) for r in current(spark, out).collect()}
    first = upsert_into(out, ["k"], ["ts"])
    first(rows(("a", 1, ts("2024-01-01T00:00:00")), (None, 0, ts("2024-01-01T00:00:00"))), 0)
    first(rows(("b", 2, ts("2024-01-02T00:00:00"))), 1)
    first(rows(("b", 9, ts("2024-01-09T00:00:00"))), 1)  # tried again after it was logged: not applied twice
    assert held() == {("a", 1), (None, 0), ("b", 2)}
    again = upsert_into(out, ["k"], ["ts"])  # numbers begin anew
    again(rows(("c", 3, ts("2024-01-01T00:00:00")), ("a", 4, ts("2024-01-03T00:00:00"))), 0)
    assert held() == {("a", 4), (None, 0), ("b", 2), ("c", 3)}
    again(rows(("a", 5, ts("2023-01-03T00:00:00"))), 1)  # an older write changes nothing
    assert held() == {("a", 4), (None, 0), ("b", 2), ("c", 3)}
    # a batch that failed before it was logged left files behind: it is written over them
    spark.createDataFrame([(1,)], "x int").write.parquet(out + "/data/v4/_bucket=0")
    again(rows(("d", 6, ts("2024-01-01T00:00:00"))), 2)
    assert held() == {("a", 4), (None, 0), ("b", 2), ("c", 3), ("d", 6)}


def test_upsert_of_nothing(spark, tmp_path):
    out = str(tmp_path / "table")
    write = upsert_into(out, ["k"], ["v"])
    assert current(spark, out) is None
    write(spark.createDataFrame([], "k string, v int"), 0)
    assert current(spark, out).count() == 0
