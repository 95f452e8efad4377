"""Intermediate tables that cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sunlattice-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, **noted: Column) -> DataFrame:
    """Write the rows to the shared folder named by spark.checkpoint.dir and read them back.

    `noted` are aggregates that are computed while the rows are written; the result has them as the dict `noted`.

    In local mode without that setting a temporary folder is used; on a cluster the setting is required.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/iterations/{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *[c.alias(n) for n, c in noted.items()]) if noted else df).write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._cut_path, read.noted = path, seen.get if noted else {}
    return read


def discard(df: DataFrame) -> None:
    """Delete a table that `cut` has made. Plans that still read it fail then."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
