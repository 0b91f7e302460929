from pyspark.sql import functions as F

from riskloom.functions import names as N
from riskloom.functions.identifiers import normal_form
from riskloom.plans.matching import classify


def values(spark, build, texts):
    return [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(build(F.col("t")).alias("x")).collect()]


def test_names(spark):
    assert values(spark, N.forge_url, ["git+https://github.com/a/b.git", "git@gitlab.com:a/b", "https://www.github.com/a/b/tree/x", "https://x.org/a/b", None]) == ["https://github.com/a/b", "https://gitlab.com/a/b", "https://github.com/a/b", None, None]
    assert values(spark, N.first_integer, ["^17.0", "x", None]) == [17, None, None]
    assert values(spark, N.least_python, [">=3.8,<4", "<3", None]) == ["3.8", None, None]
    assert values(spark, N.symbols, ["Use `a.b()` and FooBar, not `b`.", None]) == [["b", "FooBar"], None]
    assert values(spark, N.product, ["cpe:2.3:a:vendor:thing:1", "cpe:2.3:a:vendor:*:1", None]) == ["thing", "vendor", None]
    assert values(spark, N.prefixes, ["a_b_c"]) == [["a", "a_b", "a_b_c"]]


def test_identifiers(spark):
    good = {" cve‑2020-1234\t": "CVE-2020-1234", "CVE-2020-1234\n": "CVE-2020-1234", "ghsa−ab12−cd34−ef56": "GHSA-AB12-CD34-EF56", "　go–2021–700794​": "GO-2021-700794", "Pysec-2020-1": "PYSEC-2020-1", "RUSTSEC-2020-0001": "RUSTSEC-2020-0001"}
    assert values(spark, normal_form, list(good)) == list(good.values())
    bad = [None, "", "  ", "N/A", "TBD", "CVE-PENDING", "CVE-YYYY-NNNN", "CVE-0000-0000", "CVE-2020-XXXX", "GHSA-xxxx-xxxx-xxxx", "CVE-2020-0000", "x CVE-2020-1234", "CVE-2020-1234, CVE-2020-1235", "-", "none", "x" * 100_000]
    assert values(spark, normal_form, bad) == [None] * len(bad)


def test_classifier_takes_the_first(spark):
    df = spark.createDataFrame([("An injection by a redirect", "x"), ("", "a-sql"), ("plain", "a-router"), ("plain", "x")], "d string, p string")
    assert [r["c"] for r in df.select(classify(F.col("d"), F.col("p")).alias("c")).collect()] == ["injection", "injection", "redirect", None]
