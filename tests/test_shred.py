import json

from riskloom.operators.shred import entities, shred


def table(spark, payloads):
    df = spark.createDataFrame([("t", i, p, 7) for i, p in enumerate(payloads)], "source_table string, rec_id bigint, payload string, node int")
    adj = shred(df, ["references", "weaknesses", "affected"], ["url", "type"])
    return adj


def test_lists_objects_and_texts(spark):
    rec = {"id": 1, "references": [{"url": "a"}, None, "b", {"source": "x"}, {"url": ""}, {"url": 5}], "weaknesses": {"type": "P", "description": [{"type": "inner"}]}}
    payloads = [json.dumps(rec), json.dumps(json.dumps(rec)), json.dumps({"vulnerabilities": [{"cve": rec}]}), json.dumps({"cve": rec}), "", None, "{", "null", json.dumps(rec)[:-9], '"x"', "[" * 5000, json.dumps({"references": None, "weaknesses": []})]
    e = entities(table(spark, payloads), ["references", "weaknesses"], ["url", "type"], bare={"references": "url"}).collect()
    for rec_id in range(4):
        own = {(r["label"], r["pos"], r["url"], r["type"]) for r in e if r["rec_id"] == rec_id}
        assert {x for x in own if x[0] == "references"} == {("references", 0, "a", None), ("references", 1, None, None), ("references", 2, "b", None), ("references", 3, None, None), ("references", 4, "", None), ("references", 5, None, None)}
        assert {x for x in own if x[0] == "weaknesses"} == {("weaknesses", 0, None, "P")}
    assert not [r for r in e if 4 <= r["rec_id"] <= 10]


def test_parents(spark):
    rec = {"affected": [None, {"ranges": [{"type": "A"}, None]}, {"ranges": {"type": "B"}}]}
    adj = table(spark, [json.dumps(rec)])
    owners = {r["node"]: r["ordinal"] for r in adj.filter("label = 'affected' and kind = 'object'").collect()}
    got = {(owners[r["parent"]], r["pos"], r["type"]) for r in entities(adj, ["ranges"], ["type"]).filter("type is not null").collect()}
    assert got == {(1, 0, "A"), (2, 0, "B")}


def test_empty_and_long(spark):
    assert table(spark, []).count() == 0
    long = json.dumps({"references": [{"url": "u" * 1_000_000}] * 3, "x": "\ud800"})
    assert entities(table(spark, [long, long]), ["references"], ["url"]).filter("length(url) = 1000000").count() == 6
