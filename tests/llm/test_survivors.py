import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm.descriptions import says_something
from riskloom.llm.survivors import advisory_survivors

CVE = "rec_id bigint, id string, description string, cvss_score double, modified_date timestamp_ntz, source string, score_rec_id int"
TRUST = "source string, trust_rank int"

SAYS = ["A path traversal lets a guest read files.", "TODO upstream: We rate this as medium because logs reveal it.", "N/A for 1.x. Exploitation needs a non-default option.", "** UPDATED ** A second path was closed.", "[reserved range] A second path was closed at the same time.", "Für ältere Zweige ist kein Rückport geplant.", "As a stopgap, run with one worker.", "See `parse` for the bound that the fix adds to the loop.", "x" * 100_000 + " overflow"]
SILENT = [None, "", "   ", "​", "-", "?", "...", "n/a", "N/A", "TBD", "tbd.", "null", "(none)", "to be announced", "TODO: write description", "Description pending", "No description available.", "** RESERVED ** Details will follow.", "This entry is a placeholder.", "Awaiting analysis", "see references", "See references below", "Refer to vendor page", "cf. the link", "See https://x.example/a/b#c", "https://x.example/a", "Beschreibung folgt", "{{details}}", "${SUMMARY}", "%(details)s", "%DESCRIPTION%", "@@summary@@", "$$SUMMARY$$", "[Insert details]", "[DETAILS HERE]", "[[details]]", "«summary»", "&details;", "<summary>", "#{summary}", "XXDETAILSXX", "TODO(details)", "__SUMMARY__", "{% summary %}", "<%= this.summary %>", "{{ pkg.summary }}", "  More information coming soon\n", "** Full text not yet available **", "[More details will be added later]", "Summary withheld for now", "CVE-2020-1234"]


def test_descriptions(spark):
    df = spark.createDataFrame([(t, True) for t in SAYS] + [(t, False) for t in SILENT], "t string, want boolean")
    assert [r["t"] for r in df.filter(says_something(F.col("t")) != F.col("want")).collect()] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, *(datetime.datetime(2020, 1, d) for d in (1, 2, 3))])
    sources = [" NVD", "nvd", "GitHub\t", "osv", None, "else"]
    ranks = {"nvd": 1, "github": 2, "osv": 4}
    rows = [(i, r.choice(["CVE-2020-1111", " cve-2020-1111", "CVE-2020-2222", "CVE-2020-3333", "N/A", None]), r.choice(["Real text about it.", "tbd", None]), r.choice([None, float("nan"), -1.0, 0.0, 5.5, 10.0, 10.1]), day(), r.choice(sources), 0) for i in range(60)] + [(99, "CVE-2020-4444", "Alone.", 1.0, None, "nvd", 0)]
    got = {x["id"]: (x["score_rec_id"], x["desc_rec_id"]) for x in advisory_survivors(spark.createDataFrame(rows, CVE), spark.createDataFrame([("nvd", 1), ("github", 2), ("osv", 4)], TRUST)).collect()}

    def best(own, usable):
        kept = [x for x in own if usable(x)]
        if not kept:
            return -1
        return min(kept, key=lambda x: (ranks.get((x[5] or "").strip().lower(), 99), -x[4].timestamp() if x[4] else 1e18, x[0]))[0]

    want = {}
    for key in ("CVE-2020-1111", "CVE-2020-2222", "CVE-2020-3333"):
        own = [x for x in rows if x[1] and x[1].strip().upper() == key]
        if len(own) > 1:
            want[key] = (best(own, lambda x: x[3] is not None and 0 <= x[3] <= 10), best(own, lambda x: x[2] == "Real text about it."))
    assert got == want


def test_empty(spark):
    assert advisory_survivors(spark.createDataFrame([], CVE), spark.createDataFrame([], TRUST)).count() == 0
