import random

from riskloom.llm.grouping import components, grouped


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(parent)}


def run(spark, pairs):
    return {tuple(r) for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}


def test_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((30, 25), (200, 150)):
        pairs = [(f"n{r.randrange(n):04}", f"n{r.randrange(n):04}") for _ in range(m)] + [(None, "n0001"), ("n0002", None)]
        assert run(spark, pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]]) == brute(pairs)


def test_long_chain_and_star(spark):
    order = list(range(150))
    random.Random(1).shuffle(order)
    chain = [(f"c{order[i]:04}", f"c{order[i + 1]:04}") for i in range(149)]
    star = [("m-hub", f"{x}-leaf{i}") for i in range(60) for x in ("a", "z")]
    assert run(spark, chain + star) == brute(chain + star)


def test_hot_labels_are_broadcast(spark, monkeypatch):
    from riskloom import session

    monkeypatch.setattr(session, "HOT_ROWS", 5)
    pairs = [("hub", f"l{i}") for i in range(40)] + [(f"l{i}", f"k{i}") for i in range(0, 40, 3)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, [(None, None), ("x", "x")]) == set()


def test_records(spark):
    rows = [
        ("GHSA-aaaa-bbbb-cccc", ["CVE-2020-1111"]), (" ghsa‑aaaa-bbbb-cccc\n", None), ("PYSEC-2020-1", ["cve-2020-1111 ", "TBD", None, "", "CVE-YYYY-NNNN", "CVE-0000-0000"]), ("GO-2020-1", ["CVE-0000-0000"]), ("GO-2020-2", []), ("n/a", ["GO-2020-2"]), (None, ["GO-2020-2"]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, aliases array<string>, group_id string")
    assert {tuple(r) for r in grouped(df).collect()} == {("GHSA-AAAA-BBBB-CCCC", "CVE-2020-1111"), ("PYSEC-2020-1", "CVE-2020-1111"), ("GO-2020-1", "GO-2020-1"), ("GO-2020-2", "GO-2020-2")}
    assert grouped(df.limit(0)).count() == 0
