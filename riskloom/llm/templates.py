"""Texts made from templates: lines and sentences, their skeletons, marks in the place of values, and whole pages.

A text is read as lines of sentences, code left aside. A sentence's *tokens* are its words in lower case, with one
token for anything that is no word (versions, identifiers, paths). A *mark* is a name between signs that mirror each
other (``{{name}}``, ``~~name~~``, ``*|NAME|*``, ``TODO(name)``), a blank, a variable's name, or a word that forms
hold before anybody fills them in; no list of template languages is used. A mark's *place* is what stands before and
after it in its sentence, up to four tokens on either side; a sentence fills the place if it has the same tokens around
one to three others, its value.

The *skeleton* of a sentence is its tokens with runs of non-words as one; a page is the order of its skeletons.
"""

from __future__ import annotations

import html
import re
import unicodedata

from riskloom.llm.residue_text import CODE_MARK, FENCE, SENTENCE, TICKS, UNSEEN, closed_or_known, is_code, key_of, spaced

#: Tokens that one value may have.
VALUE_TOKENS = 3
#: Tokens on either side of a slot that must agree, as far as the sentence goes.
AROUND = 4
#: Lines at either end of a text that may be headers and footers.
EDGE = 2

_OPEN = r"[<{\[$#%@&«|~^=!?*_+§¤]{1,4}[({\[]?[=/>^-]?|[A-Za-z]{0,4}\("
_CLOSE = r"(?:[=/-]?[)}\]]?[>}\]%$#@;»|~^=!?*_+§¤]{1,4}|\)[sdif]?)"
_MARK = re.compile(rf"(?<![\w/.\\:-])(?P<o>{_OPEN})\s?(?P<n>[A-Za-z][A-Za-z_]*(?:[ .-][A-Za-z_]+){{0,4}}?)\s?(?P<c>{_CLOSE})(?![\w(/])")
_FENCED = re.compile(r"(?<!\w)([A-Z])\1([A-Za-z_]{2,30})\1\1(?!\w)")
#: Blanks, names of variables, and fixed values: words that forms hold before anybody fills them in.
_BLANK = re.compile(r"(?<!\S)(?:_{3,}|\?{2,}|\.{4,}|-{3,})(?=[\s.,;:!]|$)|(?<!\S)[A-Z]+_[A-Z_]+(?=[\s.,;:!]|$)|(?<![\w.-])(?:tbd|todo|fixme|xxx|undefined|null|nan|TBD|TODO|FIXME|XXX|NULL|NaN|NAN|Undefined)(?![\w.-])|\[object Object\]")
_SIGN = re.compile(r"[<{\[%&«§¤]|(?<!^)(?<!^[#*])[$#@|~^=!?*_+]{2}|[A-Z$]\(|[A-Z]_[A-Z]|\.{4}|---|([A-Z])\1[A-Za-z_]{2,30}\1\1")
_ANY = re.compile(r"[<{\[%&«§¤$#@|~^=!?*_+(]")
_WORDS = ("tbd", "todo", "fixme", "xxx", "undefined", "null", "nan")
_MIRROR = str.maketrans("<>{}[]()«»", "><}{][)(»«")
#: Signs that set words off in running text and say nothing about a slot.
_EMPHASIS = frozenset(("*", "**", "***", "_", "=", "!", "?", "@", "(", "#", "+", "~", "^", "|", "$"))
#: A field with a value: code by its look, but it fills the field of a template.
_FIELD = re.compile(r"[A-Za-z][\w.-]*: [^\s\"'{}\[\]]+")
_TAG = re.compile(r"</?([a-zA-Z][\w-]*)(?: [^<>\n]{0,300})?/?>|<[!?][^<>\n]{0,300}>")
_COMMENT = re.compile(r"<!--(.*?)(?:-->|\Z)", re.S)
_STRIP = ".,;:!?()[]{}\"'“”‘’*_#>=-–—…|·•≡<~/©«»。！？、，：；\\"
_M = "\x05"
#: Tokens: a mark, anything that is no word; the last three bits of a token tell (4: a word). 0: nothing but signs.
_HERE, _VALUE, _WORD = 1, 2, 4
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def lines_of(text: str, fields: bool = False) -> list[str]:
    """Lines of a text in single blanks, code as ``CODE_MARK``; ticked code is a value, known markup is gone.

    With ``fields``, fields with a value are lines too, whatever they look like."""
    text = UNSEEN.sub("", text if text.isascii() else unicodedata.normalize("NFC", text))
    if "```" in text or "~~~" in text:
        text = FENCE.sub(lambda m: f"\n{CODE_MARK}\n" if any(c.isalnum() for c in m[0]) else "\n", text)
    if "`" in text:
        text = TICKS.sub(" 0 ", text)
    if "<" in text:
        text = _COMMENT.sub(r"\n\1\n", text)
        low = text.lower()
        text = _TAG.sub(lambda m: "\n" if m[1] is None or closed_or_known(m[1].lower(), low) else m[0], text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for raw in text.split("\n"):
        line = " ".join(raw.split())
        if line:
            code = line == CODE_MARK or is_code(spaced(line).strip() or line) and not (fields and _FIELD.fullmatch(line))
            out.append(CODE_MARK if code else line)
    return out


def _style(m: re.Match) -> str | None:
    """Signs of a mark, if they mirror each other."""
    o, c = m["o"].strip(), m["c"].strip().rstrip("sdif")
    if o in _EMPHASIS:
        return None
    if o == "__" == c:  # strong emphasis in small letters, a mark in capitals
        return "__" if m["n"].isupper() else None
    if o[-1] == "(" and o[:-1].isalpha():
        return f"{o.lower()})" if c == ")" and o[:-1].isupper() else None
    back = o[::-1].translate(_MIRROR)
    if back.startswith(c) or back.endswith(c) or (o, c) == ("&", ";"):
        return f"{o} {c}"
    return None


def marked(sentence: str) -> tuple[str, list[tuple[str, str]]]:
    """``sentence`` with a token of its own for each mark, and (style, name) of the marks in their order; a blank has neither."""
    found: list[tuple[str, str]] = []

    def put(style: str, name: str) -> str:
        found.append((style, name))
        return f" {_M}{chr(0xF0000 + min(len(found) - 1, 0xFFFD))} "

    def mark(m: re.Match) -> str:
        style = _style(m)
        return m[0] if style is None else put(style, re.split(r"[ .]", m["n"].lower())[-1])

    out = _MARK.sub(mark, sentence)
    out = _FENCED.sub(lambda m: put(m[1] * 2, m[2].lower()), out)
    out = _BLANK.sub(lambda m: put("", ""), out)
    if not found:
        return sentence, found
    return out, [found[ord(w[1]) - 0xF0000] for w in out.split() if w[0] == _M]


def _plain(h):
    """Token hashes with one token for everything that is no word, marks too."""
    import numpy as np

    return np.where(h & np.uint64(_WORD), h, np.uint64(_VALUE))


class Reader:
    """Reads texts into arrays of token hashes; remembers the tokens of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.grow(4096)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse, for texts of up to ``n`` tokens."""
        import numpy as np

        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BACK))]), dtype=np.uint64)

    def token(self, word: str) -> int:
        if (t := self.known.get(word)) is not None:
            return t
        bare = word.strip(_STRIP)
        if word[0] == _M:
            t = _HERE
        elif not any(c.isalnum() for c in bare):
            t = 0
        elif bare.isalpha() or bare.replace("'", "").replace("’", "").isalpha():
            t = key_of(bare.lower()) & _MASK & ~7 | _WORD
        else:
            t = key_of(bare) & _MASK & ~7 | _VALUE
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = t
        return t

    def read(self, text: str | None, fields: bool = False):
        """(tokens, ends, of_line, code, marks) of a text: token hashes; end of each sentence among them; line of each
        sentence; whether there is code; (style, name) of each mark in its order. None without any token."""
        if not text:
            return None
        get, token = self.known.get, self.token
        flat: list[int] = []
        ends, of_line, marks, code = [], [], [], False
        low = text.lower()
        words = any(w in low for w in _WORDS)
        rare = words or "...." in text or "---" in text or _FENCED.search(text)
        for n, line in enumerate(lines_of(text, fields)):
            if line == CODE_MARK:
                code = True
                continue
            signs = (rare or _ANY.search(line)) and (_SIGN.search(line) or words and any(w in line.lower() for w in _WORDS))
            for sentence in SENTENCE.split(line):
                sentence = spaced(sentence)
                if signs:
                    sentence, found = marked(sentence)
                    marks += found
                parts = sentence.split()
                here = [get(w) for w in parts]
                if None in here:
                    here = [token(w) for w in parts]
                if 0 in here:
                    here = [t for t in here if t]
                if here:
                    flat += here
                    ends.append(len(flat))
                    of_line.append(n)
        return (flat, ends, of_line, code, marks) if flat else None

    def joined(self, tokens: list[list[int]], ends: list[list[int]]):
        """(h, starts) of several texts: token hashes as one array; first token of each sentence, and the end of all."""
        import numpy as np

        h = np.concatenate([np.array(t, np.uint64) for t in tokens])
        if len(h) >= len(self.up):
            self.grow(2 * len(h))
        offsets = np.cumsum([0, *map(len, tokens)])
        return h, np.concatenate([[0], *(np.array(e) + o for e, o in zip(ends, offsets[:-1], strict=True))])

    def sums(self, h):
        """Running polynomial sums of token hashes, from which the hash of any stretch follows."""
        import numpy as np

        return np.concatenate([[np.uint64(0)], np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])

    def around(self, c, start, end, i, j):
        """Key of what stands in the sentence [start, end) around [i, j); arrays of equal length."""
        import numpy as np

        start, end = np.maximum(start, i - AROUND), np.minimum(end, j + AROUND)
        x = (c[i] - c[start]) * self.down[start] * np.uint64(0xD6E8FEB86659FD93) + (c[end] - c[j]) * self.down[j] * np.uint64(0xA0761D6478BD642F)
        return _mixed(x + (i - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + (end - j).astype(np.uint64))

    def skeletons(self, h, starts):
        """Keys of the sentences' skeletons; 0 for one without any word."""
        import numpy as np

        h = _plain(h)
        first = np.zeros(len(h), bool)
        first[starts[:-1]] = True
        keep = ~((h == _VALUE) & np.concatenate([[False], h[:-1] == _VALUE]) & ~first)
        at = np.concatenate([[0], np.cumsum(keep)])[starts]
        c = self.sums(kept := h[keep])
        keys = _mixed((c[at[1:]] - c[at[:-1]]) * self.down[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
        keys[(at[1:] - at[:-1] == 1) & (kept[at[:-1]] == _VALUE)] = 0
        tokens = kept.tolist()
        for n in np.flatnonzero(at[1:] - at[:-1] >= 9).tolist():  # one that says a few words over and over is told by these words
            here = tokens[at[n] : at[n + 1]]
            words = set(here)
            if len(words) * 3 <= len(here):
                keys[n] = hash((6, *sorted(words))) & _MASK
        return keys

    def places(self, h, starts):
        """(key, words) of the place of each mark: what stands around it, and how many words that has."""
        import numpy as np

        c = self.sums(_plain(h))
        at = np.flatnonzero(h == _HERE)
        n = np.searchsorted(starts, at, "right") - 1
        keys = self.around(c, starts[n], starts[n + 1], at, at + 1)
        words = np.concatenate([[0], np.cumsum(h & np.uint64(_WORD) != 0)])
        return keys, words[np.minimum(starts[n + 1], at + 1 + AROUND)] - words[np.maximum(starts[n], at - AROUND)]

    def values(self, h, starts):
        """(key, value, token) of each place that one to ``VALUE_TOKENS`` tokens of a sentence may fill, of sentences
        without marks; ``token``: where it begins."""
        import numpy as np

        c, own = self.sums(_plain(h)), self.sums(h)
        n = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        bad = np.zeros(len(starts) - 1, bool)
        bad[n[h == _HERE]] = True
        i = np.flatnonzero(~bad[n])
        keys, values, at = [], [], []
        for k in range(1, VALUE_TOKENS + 1):
            ok = i[i + k <= starts[n[i] + 1]]
            m = n[ok]
            keys.append(self.around(c, starts[m], starts[m + 1], ok, ok + k))
            values.append((own[ok + k] - own[ok]) * self.down[ok])
            at.append(ok)
        return np.concatenate(keys), np.concatenate(values), np.concatenate(at)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ordered(keys: list[int]) -> int:
    """One key for a list of keys in its order; hashes of integers are the same in every process."""
    return hash(tuple(keys))


def unit(seq: list) -> list:
    """The shortest beginning of ``seq`` that, repeated and cut, gives all of it and twice at least; else ``seq``."""
    border = [0] * len(seq)
    for i in range(1, len(seq)):
        j = border[i - 1]
        while j and seq[i] != seq[j]:
            j = border[j - 1]
        border[i] = j + (seq[i] == seq[j])
    period = len(seq) - border[-1] if seq else 0
    return seq[:period] if seq and 2 * period <= len(seq) else seq
