"""Template residue, filler and error-page text in place of content.

Method. *Slots.* Sentences of the same template are aligned on the tokens around a place: those that agree there have
a slot between them, and the one to three tokens in it are its values, words as well as numbers. A sentence that holds a mark at this place (a
name between mirrored signs, a blank, a variable's name, see ``templates``) keeps the slot unfilled. It counts if
``FILLED`` documents fill the same place with different values, ``FILLED_SHORT`` where fewer than ``CONTEXT`` words
stand around it. Signs that so prove to mark slots in ``PLACES`` places are taken for marks of a template language:
they show slots wherever else they stand around a name that is known from a proved slot or from two kinds of signs,
or around two different names of one text; so forms that nobody filled in at all are found too. ``FILLED`` documents
with the same mark in the same sentence of ``CONTEXT`` words or more need no filled one beside them.

*Pages.* Headers and footers are lines at the ends of texts that stand around many different others. The rest of a
text, as the order of its sentences' skeletons, is its page. Sentences of real content go together with ever other
sentences; those of an error page, a notice or a form come in the same few pages again and again. A sentence is
*closed* if at least ``REPEATED`` different texts have it and these are at least ``CLOSED`` times as many as their
pages, texts that differ in values alone being one: its pages stand under at least three headers and footers each, so
they belong to no site. A text is residue if all of its sentences are closed, it has no code and at most
``PAGE_WORDS`` different words: a longer text that repeats is a copied one.

*Known* marks and notices (``notices``: fixed values) count at once, as one text alone can't be aligned.

Code, fenced, in backticks or by the look of its lines, is left aside: slots belong there.

Scale: one pass over the texts writes keys of sentences, marks and edge lines (about 8 bytes a sentence), a second
looks up the places of marks by a bitmap of at most 32 MB, so that of all possible values only those at a mark's
place leave the map step. Everything else works on keys that are summed before the shuffle; lookups go through
``session.lookup``. No list of documents or keys comes to the driver.

Defined results: null, empty and blank texts are no case; very long texts are read whole; repeated texts are each
reported; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import xor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.leakage import seed_bitmap
from riskloom.session import Cuts, lookup, spread

#: Documents that must fill a slot with values before a mark there counts as unfilled.
FILLED = 3
#: The same where fewer than ``CONTEXT`` words stand around the slot, which more sentences share by chance.
FILLED_SHORT = 20
CONTEXT = 4
#: Different proved places, and their share of all marks with the same signs, that make signs those of a template language.
PLACES = 3
SHARE = 0.05
#: Documents that must have a line at their ends, or a sentence, before it can be a header or closed.
REPEATED = 3
#: Share of different surroundings among the documents with a line at their ends that makes it a header or footer.
DIVERSE = 0.5
#: Documents with a closed sentence for each different page that has it.
CLOSED = 3
#: Most different words of a page.
PAGE_WORDS = 50
#: Tokens of documents whose arrays are computed at once.
TOKENS = 100_000

_FEATURES = (
    "doc_id bigint, slot boolean, notices boolean, code boolean, words int, text bigint, keys array<bigint>, full bigint, "
    "edges array<struct<line: bigint, at: int, n: int, s: bigint, once: boolean>>, marks array<struct<key: bigint, words: int, style: string, name: string>>"
)
_BODIES = "doc_id bigint, plain boolean, text bigint, page bigint, size int, keys array<bigint>"
_VALUES = "key bigint, low bigint, high bigint"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def residue_features(documents: DataFrame) -> DataFrame:
    """Keys of each document's sentences, its lines at the ends and its marks, and what it shows by itself."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.notices import marks_and_notices
        from riskloom.llm.templates import EDGE, Reader, ordered

        reader = Reader()
        edge = pa.struct([("line", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("s", pa.int64()), ("once", pa.bool_())])
        mark = pa.struct([("key", pa.int64()), ("words", pa.int32()), ("style", pa.string()), ("name", pa.string())])
        kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(edge), pa.list_(mark))
        names = ["doc_id", "slot", "notices", "code", "words", "text", "keys", "full", "edges", "marks"]

        def rows(docs):
            """Features of some documents, whose arrays are computed at once."""
            with np.errstate(over="ignore"):
                h, starts = reader.joined([d[3][0] for d in docs], [d[3][1] for d in docs])
                every = reader.skeletons(h, starts).view(np.int64).tolist()
                places, around = (x.tolist() for x in reader.places(h, starts))
            n = m = 0
            for doc, slot, notices, (tokens, ends, of_line, code, marks) in docs:
                said = [(k, line) for k, line in zip(every[n : n + len(ends)], of_line, strict=True) if k]
                n += len(ends)
                keys = [k for k, _ in said]
                held = [{"key": _signed(places[m + i]), "words": around[m + i], "style": style, "name": name} for i, (style, name) in enumerate(marks)]
                m += len(marks)
                begins = [i for i in range(len(said)) if not i or said[i][1] != said[i - 1][1]]
                edges, seen = [], set()
                if len(begins) > 1 or code and begins:
                    for i in sorted({*range(min(EDGE, len(begins))), *range(max(0, len(begins) - EDGE), len(begins))}):
                        here = keys[begins[i] : begins[i + 1] if i + 1 < len(begins) else len(keys)]
                        line = ordered(here)
                        edges.append({"line": line, "at": begins[i], "n": len(here), "s": reduce(xor, here), "once": line not in seen})
                        seen.add(line)
                yield doc, slot, notices, code, len(set(tokens)), ordered(keys), keys, reduce(xor, keys, 0), edges, held

        def out(batch):
            docs, size = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                slot, notices = marks_and_notices(text)
                read = reader.read(text)
                if read is None:
                    if slot or notices:
                        yield doc, slot, notices, False, 0, 0, [], 0, [], []
                    continue
                docs.append((doc, slot, notices, read))
                size += len(read[0])
                if size > TOKENS:
                    yield from rows(docs)
                    docs, size = [], 0
            if docs:
                yield from rows(docs)

        for batch in batches:
            if found := list(out(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, _FEATURES)


def fillings(documents: DataFrame, bitmap, bits: int) -> DataFrame:
    """(key, low, high): for each document and each place of a mark that it fills, the least and greatest of its values."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from riskloom.llm.templates import Reader

        reader = Reader()
        table = np.frombuffer(bitmap.value, np.uint8)

        def rows(docs):
            with np.errstate(over="ignore"):
                h, starts = reader.joined([d[0] for d in docs], [d[1] for d in docs])
                keys, values, at = reader.values(h, starts)
            b = keys >> np.uint64(64 - bits)
            known = np.flatnonzero(table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
            if len(known):
                doc = np.searchsorted(np.cumsum([len(d[0]) for d in docs]), at[known], "right")
                order = np.lexsort((values[known], keys[known], doc))
                k, v, doc = keys[known][order], values[known][order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]))
                last = np.append(first[1:], len(k)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (k[first], v[first], v[last])], names=["key", "low", "high"])

        for batch in batches:
            docs, size = [], 0
            for text in batch.column("text").to_pylist():
                read = reader.read(text, True)
                if read:
                    docs.append(read)
                    size += len(read[0])
                    if size > TOKENS:
                        yield from rows(docs)
                        docs, size = [], 0
            if docs:
                yield from rows(docs)

    return spread(documents.select("text")).mapInArrow(run, _VALUES)


def unfilled(documents: DataFrame, features: DataFrame, cuts: Cuts) -> DataFrame:
    """doc_id of the documents with a mark in a proved slot, or with proved signs around a name."""
    spark = documents.sparkSession
    marks = cuts.cut(features.filter("size(marks) > 0").select("doc_id", F.explode("marks").alias("m")).select("doc_id", "m.*"))
    table, bits = seed_bitmap(marks.filter("words > 0").select(F.col("key").alias("seed")))
    filled = fillings(documents, spark.sparkContext.broadcast(table), bits).groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))
    # the bitmap knows some keys too many; the lookup is exact
    filled = cuts.cut(filled.filter(f"times >= {FILLED} and low <> high").select("key", "times"))
    proved = cuts.cut(lookup(marks.filter("words > 0"), "key", filled, "key").filter(f"times >= if(words >= {CONTEXT}, {FILLED}, {FILLED_SHORT})"))
    by_style = proved.filter("style <> ''").groupBy("style", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("style").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"))
    signs = by_style.join(marks.groupBy("style").agg(F.count(F.lit(1)).alias("all")), "style").filter(f"places >= {PLACES} and n >= {SHARE} * all").select(F.col("style").alias("_style"))
    signed = lookup(marks, "style", cuts.cut(signs), "_style")
    # a name is known from a proved slot, or from two kinds of signs
    names = proved.filter("style <> ''").select("name", "style", F.lit(True).alias("p")).unionByName(signed.select("name", "style", F.lit(False).alias("p")))
    names = names.groupBy("name", "style").agg(F.max("p").alias("p")).groupBy("name").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("kinds")).filter("p or kinds > 1").select(F.col("name").alias("_name"))
    known = lookup(signed, "name", cuts.cut(names), "_name").select("doc_id")
    several = signed.groupBy("doc_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b").select("doc_id")
    # a line of some words that several documents repeat with a name in signs was left unfilled in all of them
    named = marks.filter(f"style <> '' and words >= {CONTEXT}").select("doc_id", "key")
    again = named.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter(f"times >= {FILLED}").select(F.col("key").alias("_key"))
    copied = lookup(named, "key", cuts.cut(again), "_key").select("doc_id")
    return proved.select("doc_id").unionByName(known).unionByName(several).unionByName(copied).distinct()


def edge_lines(features: DataFrame, cuts: Cuts) -> DataFrame:
    """line: the headers and footers, lines at the ends of documents that stand around many different others."""
    many = f"n >= {REPEATED} and rests >= greatest({REPEATED}, {DIVERSE} * n)"
    rows = features.filter("size(edges) > 0").select("doc_id", F.col("code").cast("bigint").alias("c"), F.size("keys").alias("total"), "full", F.explode("edges").alias("e")).filter("e.once")
    rows = rows.select("doc_id", "c", "total", "full", "e.line", "e.n", "e.s")

    def diverse(surroundings: DataFrame) -> DataFrame:
        # summed by line and surroundings first, so that a line which a third of all documents have is spread
        each = surroundings.groupBy("line", "rest", "some").agg(F.count(F.lit(1)).alias("k"))
        return each.groupBy("line").agg(F.sum("k").alias("n"), F.count_if("some").alias("rests")).filter(many).select("line", F.col("n").alias("times"))

    wide = cuts.cut(diverse(rows.select("line", F.col("full").bitwiseXOR(F.col("s")).bitwiseXOR(F.col("c")).alias("rest"), ((F.col("total") > F.col("n")) | (F.col("c") > 0)).alias("some"))))
    # once more without the commoner of these lines: a notice isn't a header because it stands under different headers
    near = lookup(rows, "line", wide.withColumnRenamed("line", "_line"), "_line")
    near = near.groupBy("doc_id").agg(F.first("c").alias("c"), F.first("total").alias("total"), F.first("full").alias("full"), F.collect_list(F.struct("line", "n", "s", "times")).alias("es"))  # at most 2 * EDGE
    near = near.select("c", "total", "full", "es", F.explode("es").alias("e"))
    others = F.filter("es", lambda x: (x["line"] == F.col("e.line")) | (x["times"] >= F.col("e.times")))
    taken = F.aggregate(others, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x["s"]))
    left = F.col("total") - F.aggregate(others, F.lit(0), lambda a, x: a + x["n"])
    return cuts.cut(diverse(near.select("e.line", F.col("full").bitwiseXOR(taken).bitwiseXOR(F.col("c")).alias("rest"), ((left > 0) | (F.col("c") > 0)).alias("some"))).select("line"))


def bodies(features: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, plain (short and without code), page, size and keys: each document without its headers and footers."""
    slots = features.filter("size(edges) > 0").select("doc_id", F.explode("edges").alias("e")).select("doc_id", "e.line", "e.at", "e.n")
    drop = lookup(slots, "line", headers.withColumnRenamed("line", "_line"), "_line").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("drop"))  # at most 2 * EDGE
    rows = features.filter("size(keys) > 0").select("doc_id", "code", "words", "text", "keys").join(drop, "doc_id", "left")

    def run(batches):
        import pyarrow as pa

        from riskloom.llm.templates import ordered, unit

        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        names = ["doc_id", "plain", "text", "page", "size", "keys"]
        for batch in batches:
            out = []
            for doc, code, words, text, keys, drop in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "code", "words", "text", "keys", "drop")), strict=True):
                gone = {i for d in drop or () for i in range(d["at"], d["at"] + d["n"])}
                body = unit([k for i, k in enumerate(keys) if i not in gone] if gone else keys)
                if body:
                    own = sorted(set(body))
                    out.append((doc, not code and words <= PAGE_WORDS, text, ordered(body), len(own), own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _BODIES)


def repeated(features: DataFrame, cuts: Cuts) -> DataFrame:
    """doc_id of the documents whose page says nothing but closed sentences."""
    docs = cuts.cut(bodies(features, edge_lines(features, cuts)))
    texts = docs.groupBy("text", "page").agg(F.first("size").alias("size"), F.first("plain").alias("plain"), F.first("keys").alias("keys"))  # copies, and texts that differ in values alone, are one
    said = cuts.cut(texts.select("page", "plain", "size", F.explode("keys").alias("key")).groupBy("key", "page").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.bool_or("plain").alias("plain")))
    closed = said.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages")).filter(f"n >= {REPEATED} and n >= {CLOSED} * pages").select("key")
    pages = lookup(said.filter("plain"), "key", cuts.cut(closed).withColumnRenamed("key", "_key"), "_key")
    pages = pages.groupBy("page").agg(F.count(F.lit(1)).alias("closed"), F.max("size").alias("size")).filter("closed = size").select("page")
    return lookup(docs.filter("plain").select("doc_id", "page"), "page", cuts.cut(pages).withColumnRenamed("page", "_page"), "_page").select("doc_id")


def residue_branches(documents: DataFrame) -> DataFrame:
    """(doc_id, branch): ``slots`` and ``pages`` out of the alignment, ``marks`` and ``notices`` out of the fixed values."""
    cuts = Cuts(documents.sparkSession, "residue")
    f = cuts.cut(residue_features(documents))
    found = {"slots": unfilled(documents, f, cuts), "pages": repeated(f, cuts), "marks": f.filter("slot").select("doc_id"), "notices": f.filter("notices").select("doc_id")}
    out = None
    for branch, ids in found.items():
        ids = ids.select("doc_id", F.lit(branch).alias("branch"))
        out = ids if out is None else out.unionByName(ids)
    return out


def residue(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that hold residue in place of content."""
    return residue_branches(documents).select("doc_id").distinct()
