"""Requests as a stream: validated, joined to feature vectors and scored by the same plan as in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.functions import finance
from sunlattice.plans import pipeline

REQUEST = "site_id long, lat double, lon double, power_kw double, tariff double"


def request_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path)


def responses(stream: DataFrame, vectors: DataFrame, cf: Column) -> DataFrame:
    """Responses of valid requests; the join is stream to table, so no state is kept."""
    return pipeline.evaluate(stream, vectors, cf)


def rejected(stream: DataFrame) -> DataFrame:
    return stream.where(~finance.valid_request(F.col("lat"), F.col("lon"), F.col("power_kw"), F.col("tariff")))
