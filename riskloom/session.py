"""Session helpers: lineage cuts in shared storage, size-checked broadcasts, skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is joined by broadcast of its own rows instead of one shuffle partition.
HOT_ROWS = 100_000
#: Most rows of a table that may be broadcast by hint.
BROADCAST_ROWS = 50_000
#: Copies of a table among which the rows of too many hot keys are spread.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a temporary one where it is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


class Cuts:
    """Tables written to the shared folder to cut lineage.

    Each cut is a Parquet table that every executor reads, so a lost executor costs a task and not the
    work before the cut. Columnar files are smaller than a serialised checkpoint of rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.remove)

    def remove(self) -> None:
        """Delete everything of this run; called when the driver ends, as results may be read until then."""
        try:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  # the session may be gone
            pass

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read again; ``by``: a column of few values by which its files lie apart."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._riskloom_path = path
        return out

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``cut(df)`` and its number of rows, counted while it is written."""
        seen = Observation()
        return self.cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of cuts that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_riskloom_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to hold at most ``rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a costly step in Python: rows that lie in too few splits for the cores, as those of one small file, are dealt out.

    ``df`` should come straight from a scan: counting the splits of a plan with shuffles would run them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def lookup(left: DataFrame, key: str, table: DataFrame, table_key: str, left_rows: int | None = None, table_rows: int | None = None) -> DataFrame:
    """Left rows joined (inner) to the unique ``table_key`` row of ``table`` without a hot partition.

    A table proven to be small is broadcast. Otherwise the keys with over ``HOT_ROWS`` left rows, of which there are
    at most ``left rows / HOT_ROWS``, are found and their table rows broadcast if they are proven to be few; if they
    are not, left rows are spread over ``SALTS`` copies of the table. No key comes to the driver. ``left_rows`` and
    ``table_rows`` spare counting what the caller knows. ``table`` is read more than once: give a cut.
    """
    right = table.withColumnRenamed(table_key, "_k")
    on = left[key] == right["_k"]
    if table_rows is None:
        table_rows = right.limit(BROADCAST_ROWS + 1).count()
    if table_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "inner").drop("_k")
    if left_rows is not None and left_rows <= HOT_ROWS:
        return left.join(right, on, "inner").drop("_k")
    hot = left.groupBy(F.col(key).alias("_h")).count().filter(F.col("count") > HOT_ROWS).select("_h")
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return left.join(right, on, "inner").drop("_k")
    if n > BROADCAST_ROWS:
        salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
        spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = left.withColumn("_s", salt)
        return salted.join(spread, (salted[key] == spread["_k"]) & (salted["_s"] == spread["_salt"]), "inner").drop("_k", "_s", "_salt")
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, right["_k"] == hot["_h"], "left_semi"))
    a = left.join(hot, left[key] == hot["_h"], "left_semi")
    b = left.join(hot, left[key] == hot["_h"], "left_anti")
    return a.join(few, a[key] == few["_k"], "inner").drop("_k").unionByName(b.join(right, b[key] == right["_k"], "inner").drop("_k"))
