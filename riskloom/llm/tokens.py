"""Encoding of whole texts with a byte-level BPE vocabulary, and decoding.

Monoid tree reduction: a long text is halved until its parts are short, the parts are encoded, and neighbours are
joined up the tree. A join re-encodes a window around the boundary that grows on both sides until it reaches a place
where the tokens outside are provably stable; tokens outside the window are kept.

Why a place between a letter or digit and a space or line end is stable: in every alternative of the splitting
pattern white space can only come first, so no piece holds a character that is not white space followed by one that
is. Such a place is therefore a border between pieces in any surroundings, the scan from a border on doesn't depend
on what precedes it, and pieces are encoded one by one. Where a side has no such place, the window takes it whole.

Defined results: null and empty texts give the empty list; strings of special tokens are ordinary text; very long
texts take a tree of logarithmic depth; repeated rows each give their row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import spread

#: Where the vocabulary files of public tokenizers lie, unless the caller names another folder.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts up to this many characters are encoded at once.
LEAF = 8_192
#: First reach of a boundary window, in characters on each side; it doubles as needed.
REACH = 64

_STABLE = re.compile(r"[^\W_](?=[ \n])")
_CODERS: dict[int, "Coder"] = {}


class Coder:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: bytes, leaf: int = LEAF, reach: int = REACH):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bytes_of = {i: t for t, i in table.items()}
        self.encode_once = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.leaf, self.reach = leaf, reach

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.encode_once(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._tree(text, a, mid), self._tree(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of ``text[a:b]`` from those of its two parts."""
        lo, reach = None, self.reach
        while lo is None:
            start = max(a, mid - reach)
            places = [m.end() for m in _STABLE.finditer(text, start, min(mid + 1, b)) if m.end() <= mid]
            lo = places[-1] if places else a if start == a else None
            reach *= 2
        hi, reach = None, self.reach
        while hi is None:
            stop = min(b, mid + reach)
            m = _STABLE.search(text, mid, stop)
            hi = m.end() if m else b if stop == b else None
            reach *= 2
        keep, spare = len(left), len(text[lo:mid].encode())
        while spare > 0:
            keep -= 1
            spare -= len(self.bytes_of[left[keep]])
        skip, spare_r = 0, len(text[mid:hi].encode())
        while spare_r > 0:
            spare_r -= len(self.bytes_of[right[skip]])
            skip += 1
        if spare or spare_r:  # never so at a stable place
            raise AssertionError("a token crosses a border between pieces")
        return left[:keep] + self.encode_once(text[lo:hi]) + right[skip:]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ``ids``: the bytes of the tokens one after the other, as joined up the tree."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def ranks_file(name: str, folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def coder_of(shared) -> Coder:
    """The coder of a broadcast rank file, built once in each worker."""
    data = shared.value
    key = hash(data)
    if key not in _CODERS:
        _CODERS[key] = Coder(data)
    return _CODERS[key]


def encoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """Column function from text to its ids. The rank file, under 1 MB, is read here and broadcast."""
    shared = spark.sparkContext.broadcast(ranks_file(name, folder))

    @F.arrow_udf("array<int>")
    def encode(text):
        import numpy as np
        import pyarrow as pa

        coder = coder_of(shared)
        lists = [np.array(coder.encode(t), np.int32) for t in text.to_pylist()]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode


def decoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """Column function from ids to the text they stand for; null gives the empty text."""
    shared = spark.sparkContext.broadcast(ranks_file(name, folder))

    @F.arrow_udf("string")
    def decode(ids):
        import pyarrow as pa

        coder = coder_of(shared)
        return pa.array([coder.decode(x or ()) for x in ids.to_pylist()], pa.string())

    return decode


def encoded(documents: DataFrame, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of each document."""
    encode = encoder(documents.sparkSession, name, folder)
    return spread(documents).select("doc_id", encode(text).alias("ids"))
