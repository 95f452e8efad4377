"""Intermediate tables in the folder that the cluster shares.

A table written here cuts lineage: a lost executor costs at most the tasks of the current stage, and plans after it
start from Parquet files instead of recomputing what led to them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the reducer bitmap: at most REDUCER_BITS / 64 rows of 16 bytes, 4 MB, whatever the input's size.
REDUCER_BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='sunlattice-')}")
    return made


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


#: The lists of the enclosing `owner` blocks, outermost first.
_owners: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


@contextmanager
def owner() -> Iterator[list[str]]:
    """Gives the list of the tables that `cut` makes in the block. What is left of it then belongs to the outer block."""
    own: list[str] = []
    token = _owners.set((*_owners.get(), own))
    try:
        yield own
    finally:
        _owners.reset(token)
        if outer := _owners.get():
            outer[-1].extend(own)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder, a folder for each value of the column `by`, and return a DataFrame that reads them."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    if owners := _owners.get():
        owners[-1].append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch_path = path
    return read


def remove(spark: SparkSession, paths: list[str], keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables of a list but for those of `keep`, which stay in it. Plans that read deleted tables fail then."""
    kept = {df._scratch_path for df in keep}
    for path in paths:
        if path not in kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths[:] = [p for p in paths if p in kept]


def discard(df: DataFrame) -> None:
    """Delete one table that `cut` has made."""
    remove(df.sparkSession, [df._scratch_path])
    for own in _owners.get():
        own[:] = [p for p in own if p != df._scratch_path]


def reducer(ids: DataFrame) -> DataFrame:
    """A bitmap of fixed size over the values of the one-column `ids`, as a table (word, bits).

    It has REDUCER_BITS / 64 rows at most, so it may be broadcast. It only spares a following exact join from shuffling
    rows that can't match; once the bitmap is full it lets everything through.
    """
    spot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(REDUCER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))
    words = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return cut(words)


def split_by(df: DataFrame, name: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `df` whose column `name` may be among the values of the `reducer`, rows for which it certainly isn't)."""
    spot = F.pmod(F.xxhash64(F.col(name)), F.lit(REDUCER_BITS))
    words = F.broadcast(bitmap.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    joined = df.join(words, F.shiftright(spot, 6) == F.col("_word"), "left")
    hit = F.coalesce(F.getbit("_bits", F.pmod(spot, F.lit(64)).cast("int")) == 1, F.lit(False))
    return joined.where(hit).drop("_word", "_bits"), joined.where(~hit).drop("_word", "_bits")


def maybe_in(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose column `name` may be among the values of the one-column `ids`."""
    return split_by(df, name, reducer(ids))[0]
