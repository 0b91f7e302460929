"""Queries of change requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import requests as R
from riskloom.tables import read


def _both(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "gitlab_mr_renovate").select(F.lit("gitlab").alias("forge"), "rec_id", "title", F.col("description").alias("body"), "source_branch", "author", "labels", "state")
    b = read(spark, d, "github_pr_dependabot").select(F.lit("github").alias("forge"), "rec_id", "title", "body", "source_branch", "author", "labels", "state")
    return a.unionByName(b)


def bot_type(spark: SparkSession, d: str) -> DataFrame:
    t = _both(spark, d)
    return t.groupBy("forge", R.bot_type(F.col("author"), F.col("source_branch")).alias("bot"), R.is_security(F.col("title"), F.col("labels"), F.col("body")).alias("security")).agg(F.count(F.lit(1)).alias("n"))


def request_branches(spark: SparkSession, d: str) -> DataFrame:
    t = _both(spark, d)
    b = F.col("source_branch")
    return t.groupBy("forge", R.branch_ecosystem(b).alias("ecosystem"), R.group_name(b).alias("grp"), R.update_type(b, F.col("title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def title_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.title_updates(_both(spark, d), "rec_id", "title", "source_branch").groupBy("name", "ecosystem", "is_major").agg(F.count(F.lit(1)).alias("n"), F.min("from_version").alias("from_version"), F.max("to_version").alias("to_version"))


def table_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.table_updates(read(spark, d, "gitlab_mr_renovate", "rec_id", "description"), "rec_id", "description")


def bullet_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.body_updates(read(spark, d, "github_pr_dependabot", "rec_id", "body"), "rec_id", "body")


def merged_updates(spark: SparkSession, d: str) -> DataFrame:
    """Titles and tables of the merge requests together."""
    t = read(spark, d, "gitlab_mr_renovate", "rec_id", "title", "description", "source_branch")
    return R.merged_updates(R.title_updates(t, "rec_id", "title", "source_branch"), R.table_updates(t, "rec_id", "description"))


def ecosystem_override(spark: SparkSession, d: str) -> DataFrame:
    """Packages whose requests all name one ecosystem, with it; others keep the default."""
    t = read(spark, d, "github_pr_dependabot", "title", "source_branch")
    u = t.select(F.regexp_extract("title", R.SHAPES["moved"], 1).alias("name"), R.branch_ecosystem(F.col("source_branch")).alias("e")).filter("name <> ''")
    g = u.groupBy("name").agg(F.count_distinct("e").alias("n_ecosystems"), F.min("e").alias("e"))
    return g.select("name", "n_ecosystems", F.when(F.col("n_ecosystems") == 1, F.col("e")).otherwise("npm").alias("ecosystem"))


def title_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Requests by the shape of their titles."""
    return _both(spark, d).groupBy("forge", F.coalesce(R.title_shape(F.col("title")), F.lit("other")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first"))


def request_latest(spark: SparkSession, d: str) -> DataFrame:
    """The state of each request: the row received last, of rows received together the greatest."""
    columns = ("id", "rec_id", "state", "received_at")
    t = read(spark, d, "github_pr_dependabot", *columns).withColumn("forge", F.lit("github")).unionByName(read(spark, d, "gitlab_mr_renovate", *columns).withColumn("forge", F.lit("gitlab")))
    return t.groupBy("forge", "id").agg(F.max_by("state", F.struct("received_at", "rec_id")).alias("state"), F.count(F.lit(1)).alias("deliveries"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _both(spark, d).filter("labels is not null").select("forge", F.explode(F.array_distinct("labels")).alias("label"))
    return t.groupBy("forge", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (bot_type, request_branches, title_parse, table_parse, bullet_parse, merged_updates, ecosystem_override, title_shapes, request_latest, label_counts)}

_BOTH = "(select 'gitlab' as forge, rec_id, title, description as body, source_branch, author, labels, state from gitlab_mr_renovate union all select 'github', rec_id, title, body, source_branch, author, labels, state from github_pr_dependabot)"
_BOT = "case when starts_with(lower(author), 'renovate') then 'renovate' when starts_with(lower(author), 'dependabot') then 'dependabot' when starts_with(source_branch, 'renovate/') then 'renovate' when starts_with(source_branch, 'dependabot/') then 'dependabot' else 'unknown' end"
_SECURITY = "(coalesce(contains(upper(title), '[SECURITY]'), false) or coalesce(len(list_filter(labels, lambda x: lower(x) = 'security')) > 0, false) or coalesce(regexp_matches(lower(body), 'cve-[0-9]|security|vulnerab'), false))"
_SECOND = "split_part(source_branch, '/', 2)"
_ECO = f"case when {_SECOND} in ('pip', 'pypi', 'poetry', 'pipenv') then 'pypi' when {_SECOND} in ('go', 'gomod', 'go_modules') then 'go' when {_SECOND} in ('bundler', 'rubygems') then 'rubygems' when {_SECOND} in ('maven', 'gradle') then 'maven' when {_SECOND} in ('cargo', 'composer') then {_SECOND} else 'npm' end"
_GROUP = "regexp_replace(regexp_replace(source_branch, '^(renovate|dependabot)/', ''), '-[0-9][0-9a-z.]*$', '')"
_T = "lower(concat_ws(' ', source_branch, title))"
_KIND = f"case when regexp_matches({_T}, 'lock.?file') then 'lockfile' when regexp_matches({_T}, '\\bpin\\b') then 'pin' when contains({_T}, 'digest') then 'digest' when regexp_matches({_T}, 'group|monorepo|all-dep') then 'group' when contains({_T}, 'security') then 'security' else 'version' end"
_CLEAN = "regexp_replace(regexp_replace({0}, '[`''\" ]', '', 'g'), '^[vV]', '')"
# Titles word by word: what is done, to what, from and to which version; not the patterns of the operator.
_WORDS = r"regexp_replace(regexp_replace(trim(title), '^\[[Ss][Ee][Cc][Uu][Rr][Ii][Tt][Yy]\] |^([Ff]ix|[Cc]hore|[Bb]uild)\([Dd]eps(-[Dd]ev)?\): ?', ''), ' \[[Ss][Ee][Cc][Uu][Rr][Ii][Tt][Yy]\]$| \(([Mm]ajor|[Mm]inor)\)$', '')"
_SHAPED = rf"""(select *, case when verb in ('bump', 'update') and w[-4] = 'from' and w[-2] = 'to' and len(w) > 5 and regexp_matches(w[-1], '^v?\d') and regexp_matches(w[-3], '^v?\d') then 'moved' when verb = 'update' and w[-2] = 'to' and len(w) > 3 and regexp_matches(w[-1], '^v?\d') then 'to'
 when verb = 'update' and w[-3] = 'digest' and w[-2] = 'to' then 'digest' when verb = 'pin' and w[-2] = 'to' and regexp_matches(w[-1], '^v?\d') then 'pin' when verb = 'update' and w[-1] in ('package', 'packages', 'monorepo') and len(w) > 2 then 'group' when array_to_string(w, ' ') in ('lock file maintenance', 'update lockfile') then 'lockfile' end as shape
 from (select *, case when len(w0) > 6 and w0[-2] = 'in' and w0[-4] = 'to' then w0[1:-3] else w0 end as w, case when len(w0) > 6 and w0[-2] = 'in' and w0[-4] = 'to' then o0[1:-3] else o0 end as o, w0[1] as verb from (select *, string_split(lower({_WORDS}), ' ') as w0, string_split({_WORDS}, ' ') as o0 from SOURCE)))"""
_TITLES = f"""(select *, case when starts_with(source_branch, 'dependabot/') then {_ECO} when starts_with(name, '@') and contains(name, '/') then 'npm' when contains(name, ':') and not contains(name, '/') then 'maven' when regexp_matches(lower(name), '^[a-z0-9-]+[.][a-z0-9.-]+/') then 'go' when starts_with(name, 'python-') or starts_with(name, 'py-') then 'pypi' when starts_with(name, 'ruby-') or ends_with(name, '-rb') then 'rubygems' when regexp_matches(lower(name), '^(tokio|serde|actix|rocket|diesel)') then 'cargo' else 'npm' end as ecosystem,
 case when from_version = '' then false else coalesce(try_cast(regexp_extract(to_version, '([0-9]+)', 1) as bigint) > try_cast(regexp_extract(from_version, '([0-9]+)', 1) as bigint), false) end as is_major from (
 select rec_id, source_branch, regexp_replace(array_to_string(o[2:(case shape when 'moved' then -5 when 'digest' then -4 else -3 end)], ' '), '^([Dd]ependency|[Mm]odule) ', '') as name, case when shape = 'moved' then {_CLEAN.format('o[-3]')} else '' end as from_version, {_CLEAN.format('o[-1]')} as to_version from {_SHAPED} where shape in ('moved', 'to', 'digest', 'pin')))"""
_TABLE = f"""select rec_id as request, (unnest(generate_series(1, len(n))) - 1)::int as pos, unnest(n) as name, {_CLEAN.format('unnest(a)')} as from_version, {_CLEAN.format('unnest(b)')} as to_version from (
 select rec_id, regexp_extract_all(description, '{R.TABLE_ROW}', 1) as n, regexp_extract_all(description, '{R.TABLE_ROW}', 4) as a, regexp_extract_all(description, '{R.TABLE_ROW}', 5) as b from gitlab_mr_renovate where description is not null)"""
SQL = {
    "bot_type": f"select forge, {_BOT} as bot, {_SECURITY} as security, count(*) as n from {_BOTH} group by all",
    "request_branches": f"select forge, {_ECO} as ecosystem, {_GROUP} as grp, {_KIND} as kind, count(*) as n from {_BOTH} group by all",
    "title_parse": f"select name, ecosystem, is_major, count(*) as n, min(from_version) as from_version, max(to_version) as to_version from {_TITLES.replace('SOURCE', _BOTH)} group by name, ecosystem, is_major",
    "table_parse": _TABLE,
    "bullet_parse": f"select rec_id as request, regexp_extract(body, '{R.BODY_FROM_TO}', 1) as name, {_CLEAN.format(f'''regexp_replace(regexp_extract(body, '{R.BODY_FROM_TO}', 2), '[.]$', '')''')} as from_version, {_CLEAN.format(f'''regexp_replace(regexp_extract(body, '{R.BODY_FROM_TO}', 3), '[.]$', '')''')} as to_version from github_pr_dependabot where regexp_matches(body, '{R.BODY_FROM_TO}')",
    "merged_updates": f"select request, name, arg_min(a, case when a is not null then o end) as from_version, arg_max(to_version, o) as to_version, count(*) as sources from (select rec_id as request, name, nullif(from_version, '') as a, to_version, 0 as o from {_TITLES.replace('SOURCE', 'gitlab_mr_renovate')} union all select request, name, nullif(from_version, ''), to_version, pos + 1 from ({_TABLE})) group by request, name",
    "ecosystem_override": f"select name, n_ecosystems, case when n_ecosystems = 1 then e else 'npm' end as ecosystem from (select name, count(distinct e) as n_ecosystems, min(e) as e from (select name, {_ECO} as e from (select *, regexp_replace(array_to_string(o[2:-5], ' '), '^([Dd]ependency|[Mm]odule) ', '') as name from {_SHAPED.replace('SOURCE', 'github_pr_dependabot')} where shape = 'moved')) group by name)",
    "title_shapes": f"select forge, coalesce(shape, 'other') as shape, count(*) as n, min(rec_id) as first from {_SHAPED.replace('SOURCE', _BOTH)} group by all",
    "request_latest": "select forge, id, arg_max(state, row(received_at, rec_id)) as state, count(*) as deliveries from (select 'github' as forge, id, rec_id, state, received_at from github_pr_dependabot union all select 'gitlab', id, rec_id, state, received_at from gitlab_mr_renovate) group by forge, id",
    "label_counts": f"select forge, label, count(*) as n from (select forge, unnest(list_distinct(labels)) as label from {_BOTH} where labels is not null) where label is not null group by all",
}
