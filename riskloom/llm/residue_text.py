"""What the rules for residue share: code, sentences, markup and scripts without blanks."""

from __future__ import annotations

import re

#: Stands for a line of code.
CODE_MARK = "\x03"

CODE_WORDS = ("import ", "from ", "export ", "const ", "let ", "var ", "func ", "def ", "class ", "return", "if", "for", "while", "package ", "public ", "private ")
TAG_SLOT = re.compile(r"(?<![\w<&])<([a-z][a-z_]{1,30})>", re.I)
#: Element names of HTML and common XML; a tag of another name that is never closed is a slot.
TAGS = frozenset(
    "a abbr address article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed error fieldset figcaption figure font footer form frame frameset h head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q resource rp rt ruby s samp script search section select slot small source span strike strong style sub sub sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr xml message status".split()
)
UNSEEN = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
#: Elements that can't stand alone without an end tag; in a text without any end tag their names in brackets are slots.
PAIRED = frozenset("summary title link footer header address label source details code data time".split())
FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
TICKS = re.compile(r"`[^`\n]*`")
CODE_LINE = re.compile(
    r"^\s*(?:import |from \S+ import|export |const |let |var |func |def |class |return\b|if ?\(|if err|for ?\(|while ?\(|package \w+$|public |private |[}\])]+[;,]?$|#include|@\w+$|//|\$ |>>> )|[{;]$|^\s*\"[^\"]+\": |^\s*[\w.-]+ ?:?= ?[\w.(\[]|=> \{|^\S+==\S+$|^\s*[\w@./:-]+(?:==|: \^?~?)\d\S*,?$"
)
SENTENCE = re.compile(r"(?<=[.!?。！？…])\s+|(?<=[。！？])")
#: Letters of scripts that set no blanks between words, and Hangul, which joins particles to what stands before.
DENSE = re.compile("[\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1100-\u11ff\u1780-\u17d3\u3005\u3041-\u30fa\u30fc-\u30ff\u3130-\u318f\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]+")
DENSE_MARKS = re.compile("[\u3001\u3002\u3008-\u3011\u3014-\u301b\u30fb\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f]")


def key_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def spaced(sentence: str) -> str:
    """``sentence`` with blanks around runs of letters of ``DENSE``, so that values beside them are words of their own."""
    if sentence.isascii():
        return sentence
    return DENSE.sub(lambda m: f" {''.join(c for c in m[0] if c.isalpha())} ", DENSE_MARKS.sub(" ", sentence))


def is_code(line: str) -> bool:
    """Whether a line (no blanks at its ends) looks like code; the first tests spare most prose the pattern."""
    if line[-1] in "{;":
        return True
    if line[0] in "}])\"$>@#/" or "=" in line or line.startswith(CODE_WORDS) or ": " in line and line.count(" ") == 1:
        return bool(CODE_LINE.search(line))
    return False


def closed_or_known(name: str, low: str) -> bool:
    """Whether a tag of this name is markup in the text ``low``: a known element, or one with an end tag."""
    if name in TAGS or re.fullmatch(r"h\d", name):
        return name not in PAIRED or "</" in low
    return f"</{name}" in low
