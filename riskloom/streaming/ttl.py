"""Streams: de-duplication with a time to live, windowed counts, and an upserted table as sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.stores import upsert


def once_per(stream: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """The first row of each key within ``ttl`` of event time.

    A key comes again after the watermark, which trails the latest row by ``ttl``, has passed its first row by
    ``ttl``; until then its rows are held for repeats. State is one row for each such key.
    """
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, by: list[str], every: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates of tumbling windows; a window is final once the watermark of ``late`` has passed it."""
    found = stream.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(*(aggregates or (F.count(F.lit(1)).alias("n"),)))
    return found.select(F.col("window.start").alias("start"), *(c for c in found.columns if c != "window"))


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Spans of activity of each key that no pause of ``gap`` interrupts: start, end, rows."""
    found = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


#: Buckets of an upserted table: a batch rewrites only those that its keys fall into.
BUCKETS = 32
#: Versions whose files are kept for readers that began earlier.
KEPT = 2

_LOG = "v bigint, query string, epoch bigint, places map<int,bigint>"


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
    """Function for ``foreachBatch``: merges each batch into the table at ``path``.

    The table lies in ``buckets`` by a hash of its keys. A batch reads and rewrites those its keys fall into, under the
    next version number, and then appends to the log which version each bucket has now; readers take what the last line
    says. A batch that was logged is known by its query and number and is not applied twice, one that failed before is
    written again over its own files. A query with a new checkpoint has another id, so its numbers may begin anew.
    Files that neither of the last ``KEPT`` versions names are removed.
    """
    instance = uuid.uuid4().hex  # a caller outside of a query

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or instance
        log = _log(spark, path)
        last = None
        if log is not None:
            if log.filter((F.col("query") == query) & (F.col("epoch") == int(epoch))).limit(1).count():
                return
            last = log.orderBy(F.col("v").desc()).first()
        v, places = (last["v"] + 1, dict(last["places"])) if last else (0, {})
        at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.withColumn("_bucket", at)
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not touched and last:
            return
        old = [b for b in touched if b in places]
        here = _read(spark, path, {b: places[b] for b in old}) if old else None
        batch = batch.drop("_bucket")
        merged = upsert(batch.limit(0) if here is None else here, batch, keys, order).withColumn("_bucket", at)
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{v}")
        if not touched:  # an empty first batch still gives the table its columns
            batch.write.mode("overwrite").parquet(f"{path}/data/v{v}/_bucket=0")
            touched = [0]
        places.update(dict.fromkeys(touched, v))
        spark.createDataFrame([(v, query, int(epoch), places)], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
        _prune(spark, path)

    return write


def _file_system(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _log(spark, path: str) -> DataFrame | None:
    at, fs = _file_system(spark, f"{path}/log")
    return spark.read.schema(_LOG).parquet(f"{path}/log") if fs.exists(at) else None


def _read(spark, path: str, places: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/data/v{v}/_bucket={b}" for b, v in sorted(places.items())))


def _prune(spark, path: str) -> None:
    """Remove files that the last versions don't name."""
    named = {f"v{v}/_bucket={b}" for r in _log(spark, path).orderBy(F.col("v").desc()).limit(KEPT).collect() for b, v in r["places"].items()}
    at, fs = _file_system(spark, f"{path}/data")
    for version in fs.listStatus(at):
        inside = [x for x in fs.listStatus(version.getPath()) if x.isDirectory()]
        gone = [x for x in inside if f"{version.getPath().getName()}/{x.getPath().getName()}" not in named]
        for x in gone:
            fs.delete(x.getPath(), True)
        if len(gone) == len(inside):
            fs.delete(version.getPath(), True)


def current(spark, path: str) -> DataFrame | None:
    """The table as of the last whole batch, or None before the first."""
    log = _log(spark, path)
    last = None if log is None else log.orderBy(F.col("v").desc()).first()
    return None if last is None else _read(spark, path, last["places"])
