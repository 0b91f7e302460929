import random

from riskloom.llm import leakage
from riskloom.llm.words import words_of

DOCS, ITEMS = "doc_id bigint, text string, item_id int", "item_id bigint, text string, doc_id int"


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t)
        for k in range(len(w) - 12):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*x, 0) for x in docs], DOCS), spark.createDataFrame([(*x, 0) for x in items], ITEMS)


def made():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(40)) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = [(0, None), (1, ""), (2, text(5)), (3, text(200))]
    for d in range(10, 40):
        w = words_of(items[d % 12][1])
        n = r.choice([12, 13, 14, 30])
        k = r.randrange(0, len(w) - n + 1)
        part = [x.upper() if r.random() < 0.3 else x for x in w[k : k + n]]
        docs.append((d, text(20) + " <b> " + ", ".join(part) + "​. " + text(20)))
    return docs + docs[10:14], items


def test_words():
    assert words_of("Café CAFÉ ﬁne x­yz a​b ｆｕｌｌ Straße_1 don't") == ["cafe", "cafe", "fine", "xyz", "ab", "full", "strasse", "1", "don", "t"]
    assert words_of(None) == [] and words_of("  ") == []


def test_against_brute_force(spark):
    docs, items = made()
    want = brute(docs, items)
    assert want
    assert {tuple(r) for r in leakage.leaked(*frames(spark, docs, items)).collect()} == want


def test_many_items_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(leakage, "FEW", 3)
    docs, items = made()
    assert {tuple(r) for r in leakage.leaked(*frames(spark, docs, items)).collect()} == brute(docs, items)


def test_substitutions_are_found(spark):
    words = [f"u{i}" for i in range(60)]
    changed = list(words)
    for k in range(6, 60, 9):  # never 13 equal words in a row
        changed[k] = "other"
    d, i = frames(spark, [(1, " ".join(changed)), (2, "nothing of the kind " * 20)], [(7, " ".join(words))])
    got = leakage.overlaps(d, i, least=20).collect()
    assert [(r["doc_id"], r["item_id"], r["exact_windows"]) for r in got] == [(1, 7, 0)] and got[0]["best"] >= 20
    assert leakage.leaked(d, i).count() == 0


def test_one_mask_misses_no_equal_window(spark):
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for mask in leakage.MASKS:
        assert len(mask) == leakage.SPAN
        with np.errstate(over="ignore"):
            assert (leakage._seeds(h, mask)[5:] == leakage._seeds(h[5:], mask)).all()


def test_empty(spark):
    docs, items = made()
    d, i = frames(spark, docs, items)
    assert leakage.leaked(d.limit(0), i).count() == 0
    assert leakage.leaked(d, i.limit(0)).count() == 0


def test_short_passages_with_substitutions(spark):
    words = [f"u{i}" for i in range(16)]
    for at in (5, 8, 10):  # no 13 equal words, at most 15 of them at one distance
        changed = words[:at] + ["other"] + words[at + 1 :]
        d, i = frames(spark, [(1, "x y z " * 20 + " ".join(changed) + " k l m" * 20)], [(7, "a b c " * 20 + " ".join(words) + " d e f" * 20)])
        got = leakage.overlaps(d, i, least=22).collect()
        assert [(r["doc_id"], r["item_id"], r["exact_windows"]) for r in got] == [(1, 7, 0)] and got[0]["run"] >= 13 and got[0]["best"] == 15


def test_longest_run(spark):
    import random

    r = random.Random(5)
    rows = [(r.getrandbits(29) | r.getrandbits(29) | r.getrandbits(29),) for _ in range(300)] + [(0,), ((1 << 29) - 1,)]

    def brute(x):
        b = [x >> k & 1 for k in range(29)]
        return max((n for n in range(13, 30) for k in range(30 - n) if sum(b[k : k + n]) * 5 >= n * 4), default=0)

    got = spark.createDataFrame(rows, "bits bigint").select("bits", leakage.longest_run(0.8, 29)("bits").alias("run")).collect()
    assert [r["run"] for r in got] == [brute(r["bits"]) for r in got] and len({r["run"] for r in got}) > 5


def test_recall_of_planted_substitutions(spark):
    """Passages of 14 to 30 words, up to a fifth of them substituted, in texts of their own: at least nine of ten are found."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, [word() for _ in range(60)]) for i in range(40)]
    docs, planted = [], set()
    for d in range(400):
        i, text = items[r.randrange(40)]
        n = r.randrange(14, 31)
        k = r.randrange(60 - n + 1)
        part = text[k : k + n]
        for at in r.sample(range(1, n - 1), r.randrange(1, n // 5 + 1)):
            part[at] = f"other{r.randrange(9)}"
        docs.append((d, " ".join([word() for _ in range(30)] + part + [word() for _ in range(30)])))
        planted.add((d, i))
    d, i = frames(spark, docs, [(n, " ".join(t)) for n, t in items])
    got = {(x["doc_id"], x["item_id"]) for x in leakage.overlaps(d, i, least=22).collect()}
    assert len(got & planted) >= 0.9 * len(planted), len(got & planted) / len(planted)
    assert len(got - planted) <= 0.01 * len(planted)
