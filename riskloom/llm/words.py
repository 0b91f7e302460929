"""Words of a text for comparison, and their 64-bit hashes."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[0-9a-z]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits without regard to case, accents, compatibility forms and invisible formatting characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    text = "".join(c for c in text if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf")
    return _WORD.findall(text)


def hashes_of(words: list[str], known: dict[str, int]):
    """64-bit hashes of ``words`` as a numpy array; ``known`` keeps those of earlier texts and is emptied when large."""
    import numpy as np
    import xxhash

    if len(known) > 200_000:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out
