"""CSV files and table writes that may read what they replace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from . import paths


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header at path."""
    spark, stage = df.sparkSession, f"{path}.stage-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(stage)
    fs, p = paths.hadoop(spark, stage)
    part = next(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    paths.delete(spark, path)
    paths.rename(spark, part, path)
    paths.delete(spark, stage)
    return path


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet at path; an overwrite is written aside and then moved, so df may read the table that it replaces."""
    spark = df.sparkSession
    if mode == "append":
        if paths.exists(spark, path):
            df = df.select(*spark.read.parquet(path).columns)
        df.write.mode("append").parquet(path)
        return
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(stage)
    paths.delete(spark, path)
    paths.rename(spark, stage, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a new folder of the shared one, and reread: for tables that a plan reads several times."""
    path = paths.new_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
