import pytest

from riskloom.operators import requests as R

TITLES = [
    ("Update left-pad from 1.0.0 to v2.1.0", "moved", "left-pad", "1.0.0", "2.1.0"), ("chore(deps): update left-pad from 1.0 to 2.0", "moved", "left-pad", "1.0", "2.0"), ("Bump @scope/x from 1.2.3-beta.1 to 1.2.3", "moved", "@scope/x", "1.2.3-beta.1", "1.2.3"),
    ("Bump x from v1.0 to v2.0 in /web/admin", "moved", "x", "1.0", "2.0"), ("[Security] Bump x from 1.0 to 2.0", "moved", "x", "1.0", "2.0"), ("build(deps-dev): bump x from 1.0 to 2.0", "moved", "x", "1.0", "2.0"), ("chore(deps): bump x from 1.0 to 2.0", "moved", "x", "1.0", "2.0"),
    ("Update dependency left-pad to v2.1.0", "to", "left-pad", "", "2.1.0"), ("fix(deps): update left-pad to 2.0", "to", "left-pad", "", "2.0"), ("Update left-pad to v3 (major)", "to", "left-pad", "", "3"), ("Update left-pad to v3.1 (minor)", "to", "left-pad", "", "3.1"), ("Update dependency x to 2.0 [SECURITY]", "to", "x", "", "2.0"),
    ("Update node digest to abcdef1", "digest", "node", "", "abcdef1"), ("Pin left-pad to 1.2.3", "pin", "left-pad", "", "1.2.3"), ("Update react packages", "group", None, None, None), ("Update babel monorepo", "group", None, None, None), ("Lock file maintenance", "lockfile", None, None, None), ("Update lockfile", "lockfile", None, None, None),
    ("Fix the parser", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None),
]


def test_title_shapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t[0], "feature/x", "x") for i, t in enumerate(TITLES)], "id int, title string, branch string, name string")
    shapes = {r["id"]: r["s"] for r in df.select("id", R.title_shape(F.col("title")).alias("s")).collect()}
    assert [shapes[i] for i in range(len(TITLES))] == [t[1] for t in TITLES]
    got = {r["request"]: (r["name"], r["from_version"], r["to_version"]) for r in R.title_updates(df, "id", "title", "branch").collect()}
    assert got == {i: t[2:] for i, t in enumerate(TITLES) if t[2]}


@pytest.mark.parametrize(("branch", "want"), [("dependabot/gomod/x", "go"), ("dependabot/poetry/x", "pypi"), ("dependabot/pipenv/x", "pypi"), ("dependabot/yarn/x", "npm"), ("dependabot/docker/x", "npm"), (None, "npm")])
def test_branch_ecosystem(spark, branch, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(branch,)], "b string")
    assert df.select(R.branch_ecosystem(F.col("b"))).first()[0] == want


def test_ecosystem_of_names(spark):
    from pyspark.sql import functions as F

    from riskloom.functions.labels import ecosystem_of_package

    names = {"@a/b": "npm", "org.x:y": "maven", "github.com/a/b": "go", "python-dateutil": "pypi", "py-spy": "pypi", "ruby-prof": "rubygems", "dry-rb": "rubygems", "tokio-util": "cargo", "left-pad": "npm"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["e"] for r in df.select("n", ecosystem_of_package(F.col("n")).alias("e")).collect()} == names
