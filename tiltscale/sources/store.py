"""Shared folders and stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, for local sessions only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a table that is used more than once: it is computed once, and sums of doubles
    cannot differ between its uses. Lost executors do not lose it.
    """
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(df: DataFrame, path: str, subname: str | None = None) -> None:
    """Replace the rows of ``subname`` in a stage table and keep the others'; None is the default set."""
    df.withColumn("subname", F.lit(subname).cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subname").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """All sets of a stage table, their ``subname`` as text, null for the default set."""
    schema = spark.read.parquet(path).schema
    kept = StructType([StructField(f.name, StringType() if f.name == "subname" else f.dataType) for f in schema])
    return spark.read.schema(kept).parquet(path)


def chosen_set(spark: SparkSession, path: str, subname: str | None = None) -> DataFrame:
    """One set of a stage table: that of ``subname``, which must be there; without one the default
    set, or the only one there is. The names of the sets reach the driver; the rest is not read."""
    stage = read_stage(spark, path)
    names = [r[0] for r in stage.select("subname").distinct().collect()]
    if subname is None and None not in names and len(names) != 1:
        raise KeyError(f"{path} has several sets, name one of {sorted(names)}")
    if subname is not None and subname not in names:
        raise KeyError(f"{path} has no set {subname}, but {sorted(map(str, names))}")
    wanted = subname if subname is not None or None in names else names[0]
    return stage.where(F.col("subname").eqNullSafe(F.lit(wanted))).drop("subname")


def write_tsv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Tab-separated files with a header, one folder for each value of ``by``."""
    df.write.partitionBy(*by).option("sep", "\t").option("header", True).csv(path)
