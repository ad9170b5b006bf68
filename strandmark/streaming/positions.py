"""Positions of archives as they arrive: counts are additive, so the batch plan runs as a stream in complete or update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.summarize import positions


def stream_positions(spark: SparkSession, folder: str, schema, **args) -> DataFrame:
    """A streaming DataFrame; write it with outputMode("complete") or ("update"). min_num_calls applies to what has arrived."""
    return positions(spark.readStream.schema(schema).option("pathGlobFilter", "*.ch3").parquet(folder), **args)
