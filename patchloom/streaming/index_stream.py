"""An index folder as a stream: new record files are reported as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import INDEX_SCHEMA


def index_stream(spark: SparkSession, folder: str, schema: str = INDEX_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def dominant_counts(stream: DataFrame) -> DataFrame:
    """Running number of records by region and dominant class, for complete or update mode."""
    return stream.where(F.col("patch_id").isNotNull()).groupBy("region", "dominant_class").agg(F.count("*").alias("records"))
