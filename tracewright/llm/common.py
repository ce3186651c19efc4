"""Shared folders, cut points and readers that the operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters as ``translate`` wants them; ``lower()`` would fold other scripts as well.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch. Texts may have 100 KB and more each, so the default of 10,000 rows is too many.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the setting is missing and the master is local.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this driver has named, in order; see :func:`drop_tables`.
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation.

    The table stays until :func:`drop_tables`, since the plan that reads it is lazy.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    """A mark for :func:`drop_tables`."""
    return len(_named)


def drop_tables(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables named after the mark ``since``, but for ``keep``: once a result is written, nothing reads them."""
    _delete(spark, [p for p in _named[since:] if p not in keep])
    _named[since:] = [p for p in _named[since:] if p in keep]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:  # by the file system that Spark wrote them with
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator's steps, like :func:`cut`; ``drop`` deletes them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        self.paths.append(_named[-1])
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays, since the result reads it."""
        return cut(df, name)

    def drop(self) -> None:
        _delete(self.spark, self.paths)
        self.paths = []


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by rows and bytes of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def first_by_hash(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows, those with the least hash of ``by``; ties by all of ``by``, in order.

    Rows whose hash is too large to be among them are dropped before any are gathered, so what
    reaches one task stays near ``n`` rows for any input. Repeated rows can make it fewer than ``n``.
    """
    total = rows.count()
    share = (n + 10 * n**0.5 + 10) / max(total, 1)
    h = F.xxhash64(*by)
    if share < 1:
        rows = rows.where(h < F.lit(int((share - 0.5) * 2**64)))
    return rows.orderBy(h, *by).limit(n)
