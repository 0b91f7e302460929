"""Change requests of update bots: who sent them, what they update, from and to which version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import ecosystem_of_package
from riskloom.functions.versions import is_major_upgrade

_PKG = r"[@\w][\w@./:-]*"
_VER = r"v?[0-9][\w.+-]*"
_AREA = r"(?:(?:fix|chore|build)\(deps(?:-dev)?\): ?)?"
#: Shapes of titles, tried in this order. Groups: package, then the versions that the title has.
SHAPES = {
    "moved": rf"(?i)^(?:\[security\] )?{_AREA}(?:bump|update) (?:dependency |module )?(\S.*?) from (v?\d\S*) to (v?\d\S*)(?: in \S+)?(?: \[security\])?\s*$",
    "to": rf"(?i)^{_AREA}update (?:dependency |module )?(\S.*?) to (v?\d\S*)(?: \((?:major|minor)\))?(?: \[security\])?\s*$",
    "digest": rf"(?i)^{_AREA}update (\S.*?) digest to (\S.*?)\s*$",
    "pin": rf"(?i)^{_AREA}pin (?:dependency )?(\S.*?) to (v?\d\S*)\s*$",
    "group": rf"(?i)^{_AREA}update (\S.*?) (?:packages?|monorepo)\s*$",
    "lockfile": rf"(?i)^{_AREA}(?:lock file maintenance|update lockfile)\s*$",
}
#: The shapes that name one package and its new version.
ONE = ("moved", "to", "digest", "pin")
BODY_FROM_TO = rf"(?i)bumps \[?({_PKG})\]?(?:\([^)]*\))? from ({_VER}) to ({_VER}?)\.?(?:\s|$)"
TABLE_ROW = r"\|\s*([^|\n]+?)\s*\|\s*([^|\n]*?)\s*\|\s*([^|\n]*?)\s*\|\s*`?([^|`\n]+?)`? -> `?([^|`\n]+?)`?\s*\|"

#: The ecosystem that the second part of a branch name stands for.
BRANCH_ECOSYSTEMS = {
    "npm": "npm", "npm_and_yarn": "npm", "yarn": "npm", "pip": "pypi", "pypi": "pypi", "poetry": "pypi", "pipenv": "pypi", "go": "go", "gomod": "go", "go_modules": "go",
    "bundler": "rubygems", "rubygems": "rubygems", "cargo": "cargo", "composer": "composer", "maven": "maven", "gradle": "maven",
}


def bot_type(author: Column, branch: Column) -> Column:
    a = F.lower(author)
    return (
        F.when(a.startswith("renovate"), "renovate").when(a.startswith("dependabot"), "dependabot")
        .when(branch.startswith("renovate/"), "renovate").when(branch.startswith("dependabot/"), "dependabot").otherwise("unknown")
    )


def clean_version(version: Column) -> Column:
    """A version without quotes, ticks and one leading v."""
    return F.regexp_replace(F.regexp_replace(version, "[`'\" ]", ""), "^[vV]", "")


def is_security(title: Column, labels: Column, body: Column) -> Column:
    labelled = F.coalesce(F.exists(labels, lambda x: F.lower(x) == "security"), F.lit(False))
    return F.coalesce(F.upper(title).contains("[SECURITY]"), F.lit(False)) | labelled | F.coalesce(F.lower(body).rlike("cve-[0-9]|security|vulnerab"), F.lit(False))


def update_type(branch: Column, title: Column) -> Column:
    """The first kind that a keyword of the branch or title names."""
    t = F.lower(F.concat_ws(" ", branch, title))
    return F.when(t.rlike("lock.?file"), "lockfile").when(t.rlike(r"\bpin\b"), "pin").when(t.rlike("digest"), "digest").when(t.rlike("group|monorepo|all-dep"), "group").when(t.rlike("security"), "security").otherwise("version")


def group_name(branch: Column) -> Column:
    """What a branch updates: without the bot's prefix and the version at the end."""
    return F.regexp_replace(F.regexp_replace(branch, "^(renovate|dependabot)/", ""), r"-[0-9][0-9a-z.]*$", "")


def branch_ecosystem(branch: Column) -> Column:
    """The ecosystem in the second part of a branch name; npm if it names none."""
    part = F.get(F.split(branch, "/"), F.lit(1))
    known = F.create_map(*(F.lit(x) for kv in BRANCH_ECOSYSTEMS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, part), F.lit("npm"))


def title_shape(title: Column) -> Column:
    """The first of ``SHAPES`` that a title has, null if none."""
    shape = F.lit(None).cast("string")
    for name, pattern in reversed(SHAPES.items()):
        shape = F.when(title.rlike(pattern), name).otherwise(shape)
    return shape


def title_updates(requests: DataFrame, request: str, title: str, branch: str) -> DataFrame:
    """request, name, from_version, to_version, is_major, ecosystem of each request whose title tells the update of one package.

    The major flag is what the title alone shows: without a from-version it is false.
    """
    t = F.col(title)
    part = lambda i: F.coalesce(*(F.when(F.col("_s") == s, F.regexp_extract(t, SHAPES[s], i)) for s in ONE))
    new = F.when(F.col("_s") == "moved", F.regexp_extract(t, SHAPES["moved"], 3)).otherwise(part(2))
    old = F.when(F.col("_s") == "moved", clean_version(F.regexp_extract(t, SHAPES["moved"], 2))).otherwise(F.lit(""))
    rows = requests.withColumn("_s", title_shape(t)).filter(F.col("_s").isin(*ONE))
    out = rows.select(F.col(request).alias("request"), part(1).alias("name"), old.alias("from_version"), clean_version(new).alias("to_version"), F.col(branch).alias("_b"))
    eco = F.when(F.col("_b").startswith("dependabot/"), branch_ecosystem(F.col("_b"))).otherwise(ecosystem_of_package(F.col("name")))
    return out.withColumn("is_major", F.when(F.col("from_version") == "", False).otherwise(is_major_upgrade(F.col("from_version"), F.col("to_version")))).withColumn("ecosystem", eco).drop("_b")


def table_updates(requests: DataFrame, request: str, body: str) -> DataFrame:
    """request, pos, name, from_version, to_version of each row of an update table in the description."""
    n, a, b = (F.regexp_extract_all(F.col(body), F.lit(TABLE_ROW), F.lit(i)) for i in (1, 4, 5))
    found = F.posexplode(F.transform(n, lambda x, i: F.struct(x.alias("name"), F.get(a, i).alias("a"), F.get(b, i).alias("b"))))
    rows = requests.filter(F.col(body).isNotNull()).select(F.col(request).alias("request"), found.alias("pos", "u"))
    return rows.select("request", "pos", "u.name", clean_version(F.col("u.a")).alias("from_version"), clean_version(F.col("u.b")).alias("to_version"))


def body_updates(requests: DataFrame, request: str, body: str) -> DataFrame:
    """request, name, from_version, to_version of a body that begins by telling its update."""
    b = F.col(body)
    rows = requests.filter(b.rlike(BODY_FROM_TO))
    return rows.select(F.col(request).alias("request"), F.regexp_extract(b, BODY_FROM_TO, 1).alias("name"), *(
        clean_version(F.regexp_replace(F.regexp_extract(b, BODY_FROM_TO, i), r"\.$", "")).alias(x) for i, x in ((2, "from_version"), (3, "to_version"))
    ))


def merged_updates(titles: DataFrame, table: DataFrame) -> DataFrame:
    """Updates of titles and tables: a table row fills what the title leaves open, other rows are added; by request and name."""
    rows = titles.select("request", "name", F.nullif("from_version", F.lit("")).alias("a"), "to_version", F.lit(0).alias("o")).unionByName(
        table.select("request", "name", F.nullif("from_version", F.lit("")).alias("a"), "to_version", (F.col("pos") + 1).alias("o"))
    )
    return rows.groupBy("request", "name").agg(
        F.min_by(F.col("a"), F.when(F.col("a").isNotNull(), F.col("o"))).alias("from_version"), F.max_by("to_version", "o").alias("to_version"), F.count(F.lit(1)).alias("sources")
    )
