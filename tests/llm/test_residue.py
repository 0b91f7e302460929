import pytest

from riskloom.llm.notices import marks_and_notices
from riskloom.llm.residue import residue, residue_branches

PAGES = [
    "Please enable JavaScript to view this page.", "Skip to content\n\nPlease turn on scripts to use this app.\n\nPage generated in 0.41 s", "Your browser is out of date. This app needs scripts and cookies.", "Loading...\n\nIf nothing shows up, scripts may be blocked in your browser settings.", "Checking your browser before opening this page. This happens on its own and takes up to 5 seconds.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.", "Veuillez activer JavaScript dans votre navigateur.", "Пожалуйста, включите JavaScript, чтобы продолжить.", "お探しのページは見つかりませんでした。アドレスをご確認ください。",
    "404 Not Found\n\nThe requested address /a/b was not found on this server.", "Access denied\n\nYour request was blocked by a rule of this site. Reference 9b8b283829d2.", "Sorry, the entry is gone. Use the menu.", "rate limit exceeded for client 24.x; use a key (503)", '{"status": 410, "error": "Gone", "message": "no such resource", "path": "/a"}', '<?xml version="1.0"?>\n<error><code>SlowDown</code><resource>/r</resource><id>c719a2f5bb90</id></error>', "<html>\n<head><title>502 Bad Gateway</title></head>\n<body>\n<center><h1>502 Bad Gateway</h1></center>\n<hr><center>edge/3.9.26</center>\n</body>\n</html>", 'Traceback (most recent call last):\n  File "/srv/a.py", line 66, in page\n    return render(x)\nKeyError: \'http\'', "object undefined: undefined undefined - [object Object] (null) published on Invalid Date",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sample text. Replace this paragraph with your own content.", "foo bar baz qux foo bar baz qux", "some-package\n\nComing soon ...", "Dies ist ein Blindtext ohne Inhalt. Dies ist ein Blindtext ohne Inhalt.",
    "Summary: TBD\nImpact: TBD\nSteps to reproduce:\n1.\n2.\n3.\nCredits: [your name]", "## What does this change do?\n\n<!-- describe your change -->\n\n## Why?\n\n- [ ] tests added", "Advisory {{ id }} (${severity}): %(text)s", "Users of {{package}} should upgrade soon.\n\nThe parser now checks the length of each field before it copies it.", "## [VERSION HERE] (2019-01-02)\n\n- The parser checks the length of each field.", "score: __SCORE__\nowner: TODO(owner)",
]
CONTENT = [
    None, "", "  ", "​", "The parser now checks the length of each field before it copies it.", "We quote the old message, 'Access denied', so that people searching for it find this note.", 'With a strict policy the console shows its "please enable JavaScript" notice although scripts are on; the team traced it to `a.sh`.', "Tools that write TODO into the summary now fail the check that the team added in 3.2.", "Error pages leaked `x` and the server name; the fix escapes the value on output.",
    "Our fuzz corpus holds three files of lorem ipsum and the parser rejects none of them.", "Since 2.1 a missing page gives 404 Not Found instead of a blank body, which the console relied on.", "The chart takes `{{ .Values.image }}` from the values file.", "Set the image:\n\n```\nimage: ${REGISTRY}/{{ name }}:%TAG%\n```", "const x = `${out.reason}`;\nfunction run(a) {\n  return a;\n}", "A `<noscript>` block in the template let a guest inject markup.", "left==1.0\nright==2.0", "<p>We moved the loader.</p> <p>Nothing else changed in this release of the loader.</p>",
]


def judged(text):
    return any(marks_and_notices(text))


@pytest.mark.parametrize("text", PAGES)
def test_residue(text):
    assert judged(text) and judged(text.replace(" ", "  ")) and judged(text + "\n\nImprint | Privacy | Contact")


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not judged(text)


def test_query_and_induced_slots(spark):
    filled = [(100 + i, f"The package number{i}-core moved from 1.{i} to 2.{i} on the main branch.") for i in range(5)]
    rows = [(i, t) for i, t in enumerate(PAGES)] + [(1000 + i, t) for i, t in enumerate(CONTENT)] + filled + [(500, "The package ~~name~~ moved from 1.2 to 2.2 on the main branch."), (501, "Entirely ~~other~~ words that no template of the corpus has.")] + [(0, PAGES[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, page string")
    got = {r["doc_id"] for r in residue(df).collect()}
    assert got == {*range(len(PAGES)), 500}
    assert residue(df.limit(0)).count() == 0


def test_long_texts():
    assert not judged("The parser checks each field. " * 20_000)
    assert judged("Lorem ipsum dolor sit amet. " * 20_000)


@pytest.mark.parametrize(
    ("line", "mark"),
    [
        ("Fixed in: {}", "____"), ("Version: {}", "~~version~~"), ("この版はバージョン{}に更新されました。", "~~version~~"), ("本软件包已升级到{}。", "==version=="), ("패키지가 {}로 업데이트되었습니다", "~~version~~"),
        ("Eintrag " + "wort " * 120 + "{} und mehr", "~~name~~"), ("| " + "cell | " * 100 + "{} |", "~~name~~"),
    ],
)
def test_lines_of_every_length_and_script(spark, line, mark):
    rows = [(i, f"Prose of its own stands here with words.\n\n{line.format(f'{i}.2.3')}") for i in range(25)] + [(50, f"Prose of its own stands here with words.\n\n{line.format(mark)}")]
    assert [r["doc_id"] for r in residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [50]


def test_bars():
    import random
    import re

    from riskloom.llm.notices import _bars

    pattern, r = re.compile(r"^(?:.{1,40}(?: ?[|·•›»] ?.{1,40}){1,12})$"), random.Random(2)
    for _ in range(3000):
        n = r.choice([3, 20, 44, 60, 83])
        line = "".join(r.choice("aaaaaaaaaaaaaaaaaaa bbbbbbb" if r.random() < 0.97 else "| ·") for _ in range(n))
        assert _bars(line) == bool(pattern.match(line)), line


def test_unfilled_lines_fill_nothing(spark):
    said = lambda *texts: {r["doc_id"] for r in residue(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert said(*["Set LOG_LEVEL to a higher value."] * 4) == set()
    assert said(*["The package ~~name~~ moved to the main branch."] * 2) == set()
    assert said(*["The package ~~name~~ moved to the main branch."] * 3) == {0, 1, 2}
    assert said("The package ~~name~~ moved to the main branch.", *(f"The package a-{i} moved to the main branch." for i in range(3))) == {0}


def test_brackets_fill_nothing():
    import numpy as np

    from riskloom.llm.templates import Reader

    with np.errstate(over="ignore"):
        r = Reader()
        fills = lambda text: len(r.values(*r.joined(*([x] for x in r.read(text, True)[:2])))[0])
        assert fills("ok [1.2](x)\n") and fills("ok 1.2\n") and not fills("ok <|end|>\n")


def test_words_are_values_and_signs_need_no_list(spark):
    """Phrasings and signs that no rule names: siblings filled with words prove the slot, the signs then count elsewhere."""
    people = ("Anna", "Boris from Minsk", "the whole team", "Chen")
    rows = [f"Dear {p}, your parcel from the shop has left the house on {d}." for p, d in zip(people, ("Monday", "Friday", "2 May", "Sunday"), strict=True)]
    rows += ["Dear *|FNAME|*, your parcel from the shop has left the house on Monday.", "Dear Anna, your parcel from the shop has left the house on *|DAY|*."]
    rows += [f"We thank {p} for the long letter about our little garden in spring." for p in people] + ["We thank *|FNAME|* for the long letter about our little garden in spring."]
    rows += ["*|GREETING|*\n\n*|BODY|*", "A *|lonely|* sign that no template proves."]
    got = {r["doc_id"]: r["branch"] for r in residue_branches(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == dict.fromkeys((4, 5, 10, 11), "slots")


UNSEEN_PAGES = (
    "We'll be right back. Our engineers are on the job.", "Host is asleep. Gateway gave up after {n} seconds of waiting.", "Kein Anschluss unter dieser Adresse {n}. Drücken Sie eine Taste.", "Whoopsie daisy! Nothing lives at room {n}.",
    "Your coffee is being brewed, ticket {n}. Hold the line.", "Cette salle est vide. Revenez demain vers {n} heures.", "Hamsters refuse to turn the wheel. Case {n} was opened.",
)


def test_pages_of_unseen_phrasing(spark):
    """Pages that no list knows are found by their repetition under different headers; prose whose sentences mix and copies of one text are not."""
    import random

    r = random.Random(3)
    edges = ["Top of page", "Shop | Cart | Help", "Made with love", ""]
    pages = [f"{r.choice(edges)}\n\n{p.format(n=r.randrange(99))}\n\n{r.choice(edges)}" for p in UNSEEN_PAGES for _ in range(8)]
    said = [f"The {a} of the {b} {c}." for a in ("parser", "reader", "cache", "loader") for b in ("core", "shell", "proxy", "store") for c in ("checks each field", "drops the buffer", "waits for the lock", "logs twice")]
    prose = [f"{r.choice(edges)}\n\n" + " ".join(r.sample(said, r.randint(1, 6))) + f"\n\n{r.choice(edges)}" for _ in range(400)]
    copies = ["The moon rose late over the quiet harbour."] * 9
    rows = pages + prose + copies
    got = {x["doc_id"] for x in residue(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert len(got & set(range(len(pages)))) >= 0.9 * len(pages), len(got & set(range(len(pages))))
    assert not got - set(range(len(pages)))
