"""Evaluation texts that leaked into training texts, by spaced-seed hashing.

A seed is the hash of some of the 13 words in a window; a mask says which positions count and which are ignored. Test
and training seeds are joined, and around each hit the words are compared one by one, so that overlaps with
substituted words are found too. A window whose 13 words all agree has the same seed under every mask: for passages
of 13 equal consecutive words any mask misses nothing, and the comparison makes the result exact. Seven positions of
13 count, so that passages with substitutions still share a seed under one of the masks.

Scale: the training side is never shuffled as a whole. A bitmap of the test seeds, of a size fixed by the number of
test seeds and at most 32 MB, goes to all executors; only windows whose seed it knows leave the map step. They meet
the test windows by broadcast if these are proven to be few, else by a shuffle on seed and salt, so a passage that
a third of all documents holds is spread over the salts.

Defined results: null, empty and short texts (under 13 words) have no windows and give no rows; repeated documents
each give their own; ties don't arise, all items of a document are reported; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import Cuts, bounded, spread

SPAN = 13
#: Fixed masks over the 13 words of a window; a substitution at one of the ignored places leaves the seed as it is.
MASKS = ("1011100001101", "1100011101010", "0111010111000", "0011111000101")
#: Words compared on either side of a window for overlaps with substitutions.
AROUND = 8
SALTS = 16
#: Share of equal words that a stretch of at least 13 words must have to be an overlap.
SHARE = 0.8
#: Test windows up to this number are broadcast.
FEW = 120_000

_WINDOWS = "id bigint, seed bigint, at int, words array<bigint>"


def _seeds(hashes, mask: str):
    """Seeds of all windows of a text under one mask."""
    import numpy as np

    n = len(hashes) - SPAN + 1
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    factor = np.uint64(0x2545F4914F6CDD1D)
    for i, bit in enumerate(mask):
        factor = factor * step | np.uint64(1)
        if bit == "1":
            out += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29))) * factor
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def windows(texts: DataFrame, masks: tuple[str, ...], around: int, bitmap=None, bits: int = 0) -> DataFrame:
    """(id, seed, at, words) of each window of ``texts`` (id, text) whose seed the bitmap knows; of all without one.

    ``words``: hashes of the window's words and of ``around`` words on either side, 0 beyond the text.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.words import hashes_of, words_of

        known: dict[str, int] = {}
        table = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        width = SPAN + 2 * around
        names = ["id", "seed", "at", "words"]
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, seeds, ats, ctx = [], [], [], []
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = words_of(text)
                    if len(words) < SPAN:
                        continue
                    h = hashes_of(words, known)
                    padded = np.concatenate([np.zeros(around, np.uint64), h, np.zeros(around, np.uint64)])
                    views = np.lib.stride_tricks.sliding_window_view(padded, width)
                    for mask in masks:
                        s = _seeds(h, mask)
                        if table is None:
                            at = np.arange(len(s))
                        else:
                            b = s >> np.uint64(64 - bits)
                            at = np.flatnonzero(table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
                        if len(at):
                            ids.append(np.full(len(at), doc, np.int64))
                            seeds.append(s[at])
                            ats.append(at.astype(np.int32))
                            ctx.append(views[at].reshape(-1))
                if ids:
                    seed = np.concatenate(seeds).view(np.int64)
                    flat = pa.array(np.concatenate(ctx).view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seed) + 1, dtype=np.int32) * width), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(seed), pa.array(np.concatenate(ats)), lists], names=names)

    return texts.select("id", "text").mapInArrow(run, _WINDOWS)


def seed_bitmap(items: DataFrame) -> tuple[bytes, int]:
    """Bitmap over the first ``bits`` bits of the test seeds, built by the executors in blocks of 4 KB."""
    n = items.count()
    bits = min(28, max(20, math.ceil(math.log2(max(n, 1) * 256))))
    place = F.shiftrightunsigned("seed", 64 - bits) + 1  # the bitmap functions count from 1
    blocks = items.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    out = bytearray(1 << (bits - 3))
    for r in blocks.toLocalIterator():  # at most 2 ** bits / 32768 blocks
        at = (r["block"] - 1) * 4096
        out[at : at + 4096] = r["map"]
    return bytes(out), bits


def longest_run(share: float, width: int):
    """Column function: length of the longest stretch of at least 13 words of which ``share`` agree; 0 without one.

    It takes an integer whose bit i, of ``width``, tells whether the words at place i agree.
    """

    @F.arrow_udf("int")
    def run(bits):
        import numpy as np
        import pyarrow as pa

        b = bits.to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([np.zeros((1, len(b)), np.int64), np.cumsum([(b >> i) & 1 for i in range(width)], axis=0)])
        out = np.zeros(len(b), np.int32)
        for n in range(SPAN, width + 1):
            out[((sums[n:] - sums[:-n]) >= share * n - 1e-9).any(axis=0)] = n
        return pa.array(out)

    return run


def overlaps(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, around: int = AROUND, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id, exact_windows, best, run) for each document and item with a hit.

    ``documents``: doc_id, text; ``items``: item_id, text. ``exact_windows``: places of the document at which 13
    consecutive words agree; ``best``: most words that agree at the same distance within a window and its
    surroundings; ``run``: words in the longest stretch there, of at least 13, of which ``SHARE`` agree, 0 without one.
    Rows with ``best`` below ``least`` are chance hits and are left out, unless 13 words agree or there is such a stretch.
    """
    spark = documents.sparkSession
    test = Cuts(spark, "seeds").cut(windows(items.select(F.col("item_id").alias("id"), "text"), masks, around))
    table, bits = seed_bitmap(test)
    train = windows(spread(documents.select(F.col("doc_id").alias("id"), "text")), masks, around, spark.sparkContext.broadcast(table), bits)
    train = train.select(F.col("id").alias("doc_id"), "seed", "at", F.col("words").alias("_d"))
    test = test.select(F.col("id").alias("item_id"), F.col("seed").alias("_seed"), F.col("words").alias("_i")).distinct()
    few = bounded(test, FEW)
    if few is test:
        test = test.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        train = train.withColumn("_s", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
        hits = train.join(test, (train["seed"] == test["_seed"]) & (train["_s"] == test["_salt"]))
    else:
        hits = train.join(few, train["seed"] == few["_seed"])
    exact = F.slice("_d", around + 1, SPAN) == F.slice("_i", around + 1, SPAN)
    if around:
        # which words agree, one bit each
        bits = F.aggregate(F.zip_with("_d", "_i", lambda a, b: ((a == b) & (a != 0)).cast("bigint")), F.lit(0).cast("bigint"), lambda n, x: n * 2 + x)
        hits = hits.select("doc_id", "item_id", "at", exact.alias("exact"), bits.alias("bits"))
        hits = hits.select("doc_id", "item_id", "at", "exact", F.bit_count("bits").alias("same"), longest_run(SHARE, SPAN + 2 * around)("bits").alias("run"))
    else:
        hits = hits.select("doc_id", "item_id", "at", exact.alias("exact"), F.lit(SPAN).alias("same"), F.lit(SPAN).alias("run")).filter("exact")
    out = hits.groupBy("doc_id", "item_id").agg(F.count_distinct(F.when(F.col("exact"), F.col("at"))).alias("exact_windows"), F.max("same").alias("best"), F.max("run").alias("run"))
    return out.filter((F.col("best") >= least) | (F.col("exact_windows") > 0) | (F.col("run") > 0))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) that share at least 13 consecutive words: the tolerant overlaps with a window of equal words."""
    return overlaps(documents, items, MASKS[:2]).filter("exact_windows > 0").select("doc_id", "item_id")
