"""Deeply nested records to related flat tables, by an adjacency table.

``shred`` stores one row for every node of a record: ``node``, ``parent``, ``label``, ``ordinal``, ``kind`` and, for
texts, numbers and truth values, ``scalar``. An element of a list is a child of the object that holds the list, under
the list's label and with its position as written (null elements count); a lone value where a list is usual is the
element 0. ``entities`` joins the object nodes of a label with their scalar children and pivots those into columns.

Defined results: null, empty and unreadable payloads have no nodes; null elements have a node of kind ``null``;
repeated keys in one object keep the last; repeated rows each give their own nodes; an empty table gives an empty
table. Only nodes under the wanted top labels are stored, so what no entity reads is never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import spread

ADJACENCY = "source_table string, rec_id bigint, node bigint, parent bigint, label string, ordinal bigint, kind string, scalar string"


def _text(x: str) -> str:
    """``x`` with lone surrogates, which no UTF-8 text can hold, replaced."""
    try:
        x.encode()
        return x
    except UnicodeEncodeError:
        return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def record_of(payload: str | None):
    """The record in a payload: JSON text inside a JSON text is read again, envelopes are opened; None if unreadable."""
    x = payload
    while True:  # each step takes off a layer of the text
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except (ValueError, RecursionError):
                return None
        elif isinstance(x, dict) and "vulnerabilities" in x and "id" not in x:
            x = x["vulnerabilities"]
        elif isinstance(x, list):
            x = next((y for y in x if isinstance(y, dict)), None)
        elif isinstance(x, dict) and "cve" in x and "id" not in x:
            x = x["cve"]
        else:
            break
    return x if isinstance(x, dict) else None


def nodes_of(record: dict, tops: Sequence[str], labels: frozenset[str]) -> Iterable[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of the record, parents first; the root is node 0.

    Below the top labels, scalars are kept if their label is wanted; lists and objects always.
    """
    n = 0
    stack = [(0, t, record[t]) for t in tops if t in record]
    while stack:
        parent, label, value = stack.pop()
        for i, x in enumerate(value if isinstance(value, list) else (value,)):
            if isinstance(x, (dict, list)):
                n += 1
                yield n, parent, label, i, "object" if isinstance(x, dict) else "array", None
                for k, y in x.items() if isinstance(x, dict) else ((label, x),):
                    if k in labels or isinstance(y, (dict, list)):
                        stack.append((n, k, y))
            elif label in labels or parent == 0:
                n += 1
                kind = "null" if x is None else "text" if isinstance(x, str) else "truth" if isinstance(x, bool) else "number"
                yield n, parent, label, i, kind, None if x is None else _text(x) if isinstance(x, str) else json.dumps(x)


def shred(df: DataFrame, tops: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Adjacency table of ``df`` (source_table, rec_id, payload as JSON text), see ``ADJACENCY``."""
    tops, wanted = tuple(tops), frozenset(labels)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in ADJACENCY.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for table, rec, payload in zip(*(batch.column(c).to_pylist() for c in ("source_table", "rec_id", "payload")), strict=True):
                record = record_of(payload)
                if record:
                    out += [(table, rec, *node) for node in nodes_of(record, tops, wanted)]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return spread(df.select("source_table", "rec_id", "payload")).mapInArrow(run, ADJACENCY)


def entities(adjacency: DataFrame, labels: Sequence[str], fields: Sequence[str], bare: dict[str, str] | None = None) -> DataFrame:
    """One row for each element under one of ``labels``: source_table, rec_id, node, parent, label, pos and the texts of ``fields``.

    The object nodes are joined with their scalar children on (record, node = parent) and the children pivoted into
    columns. Both sides come out of one pass over the adjacency table and meet in one grouping on the node's key,
    which needs a single shuffle with map-side combining. ``bare``: by label, the field that a bare text gives.
    """
    here = F.col("label").isin(list(labels))
    child = F.col("label").isin(list(fields)) & (F.col("kind") == "text") & (F.col("ordinal") == 0)
    rows = adjacency.filter(here | child)
    key = F.when(here, F.col("node")).otherwise(F.col("parent"))
    own = lambda c: F.max(F.when(here, F.col(c)))
    columns = []
    for f in fields:
        texts = [k for k, v in (bare or {}).items() if v == f]
        value = F.when(~here & (F.col("label") == f), F.col("scalar"))
        if texts:
            value = F.coalesce(value, F.when(F.col("label").isin(texts) & (F.col("kind") == "text"), F.col("scalar")))
        columns.append(F.max(value).alias(f))
    out = rows.groupBy("source_table", "rec_id", key.alias("node")).agg(own("parent").alias("parent"), own("label").alias("label"), own("ordinal").alias("pos"), *columns)
    return out.filter("pos is not null")
