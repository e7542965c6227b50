"""What the operators of this folder share: shared folders, text columns, row keys."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Where it is unset, a local session gets a temporary
    folder of its own; a cluster must name one, since executors do not see local folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    path = new_dir(df.sparkSession, tag)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; neither ``df`` nor what is still to be computed from it may be used after it."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


#: Rows of an Arrow batch. Texts are long, and both sides of a Python stage hold a few batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of texts become smaller where the session has Spark's own batch size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``scan``, after which a reused worker gives the memory it has freed back to the system."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from scan(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """What ``make`` gave for the keys met lately, within about ``room`` bytes.

    There are two generations: when the younger has filled half the room it becomes the
    older, and what was not met since is forgotten. Use one per task, so that a reused
    worker gives the memory back.
    """

    #: Of a dictionary's entry, besides its key and value.
    ENTRY = 104

    def __init__(self, make: Callable, room: int = 16_000_000) -> None:
        self.make, self.room, self.used, self.old = make, room // 2, 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.used += sys.getsizeof(key) + sys.getsizeof(found) + self.ENTRY
        if self.used > self.room:
            self.old, self.used = dict(self), 0
            self.clear()
        self[key] = found
        return found
