import random

from riskloom.operators.orphans import advance, pending, snapshot
from riskloom.sources.references import query_references

REFS = "ref_table string, ref_id bigint, cve_id string, t bigint"
PARENTS = "cve_id string, from_s bigint, to_s bigint"


def brute(refs, parents):
    out = set()
    for table, i, cve, t in set(refs):
        if cve is None:
            continue
        own = [(a, b) for c, a, b in parents if c == cve]
        if any(a <= t and (b is None or b > t) for a, b in own):
            continue
        out.add((table, i, cve, t, "missing" if not own else "late" if any(a > t for a, _ in own) else "deleted"))
    return out


def made(seed, n_refs=300, n_parents=80):
    r = random.Random(seed)
    day = 86_400
    keys = ["HOT"] * 6 + [f"K{i}" for i in range(20)]
    at = lambda: r.randrange(0, 40 * day, day // 4)
    refs = [("q", r.randrange(50), r.choice([*keys, None]), at()) for _ in range(n_refs)]
    parents = []
    for _ in range(n_parents):
        a = at()
        parents.append((r.choice(keys[:20]), a, None if r.random() < 0.3 else a + r.randrange(1, 10 * day)))
    return refs, parents


def reasons(state):
    return {tuple(r) for r in state.refs.filter("reason is not null").select("ref_table", "ref_id", "cve_id", "t", "reason").collect()}


def test_one_increment(spark):
    for seed in range(3):
        refs, parents = made(seed)
        state = advance(None, spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
        assert reasons(state) == brute(refs, parents)
        assert sum(r["orphans"] for r in snapshot(state).collect()) == pending(state).count()


def test_increments_agree_with_one(spark):
    refs, parents = made(9)
    opened = [(c, a, None) for c, a, b in parents]
    state = advance(None, spark.createDataFrame(refs[:100], REFS), spark.createDataFrame(opened[:30], PARENTS))
    assert reasons(state) == brute(refs[:100], opened[:30])
    state = advance(state, spark.createDataFrame(refs[100:], REFS), spark.createDataFrame(opened[30:], PARENTS))
    assert reasons(state) == brute(refs, opened)
    closed = [p for p in parents if p[2] is not None]  # deletions reopen what they resolved
    state = advance(state, None, spark.createDataFrame(closed, PARENTS))
    keys = {(c, a) for c, a, _ in closed}
    now = closed + [p for p in opened if (p[0], p[1]) not in keys]
    assert reasons(state) == brute(refs, now)


def test_empty(spark):
    none = spark.createDataFrame([], REFS)
    refs = spark.createDataFrame([("q", 1, "A", 5), ("q", 1, "A", 5), ("q", 2, None, 5)], REFS)
    parents = spark.createDataFrame([], PARENTS)
    assert advance(None, none, parents).refs.count() == 0
    assert reasons(advance(None, refs, parents)) == {("q", 1, "A", 5, "missing")}
    odd = spark.createDataFrame([("A", None, None), ("B", 1, None)], PARENTS)
    more = spark.createDataFrame([("q", 1, "A", 5), ("q", 2, "B", None), ("q", 3, "B", 7)], REFS)
    assert reasons(advance(None, more, odd)) == {("q", 1, "A", 5, "deleted"), ("q", 2, "B", None, "deleted")}


def test_shapes(spark):
    texts = ['["CVE-2020-1111", " cve‑2020-2222 ", null, "N/A", ""]', '[{"id": "CVE-2020-3333"}]', '"[\\"CVE-2020-4444\\"]"', "CVE-2020-5555, CVE-2020-6666", '["CVE-2020-7777", "CVE-20', None, "", "[]", '"[]"', "CVE-0000-0000", '{"id": "CVE-2020-8888"}', '["CVE-2020-9999\\n"]']
    df = spark.createDataFrame([(i, t, 1_600_000_000_000 if i % 2 else 1_600_000_000) for i, t in enumerate(texts)], "id bigint, cve_ids string, cached_at bigint")
    got = {(r["ref_id"], r["cve_id"][-4:]) for r in query_references(df).collect()}
    assert got == {(0, "1111"), (0, "2222"), (1, "3333"), (2, "4444"), (3, "5555"), (3, "6666"), (10, "8888"), (11, "9999")}
    assert {r["t"] for r in query_references(df).collect()} == {1_600_000_000}
