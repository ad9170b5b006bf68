"""Region annotations and key tables from CSV, TSV and BED files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("chrom", "start", "end", "region_name")


def _separator(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ("csv", "tsv", "bed"):
        raise ValueError("annotation files must be CSV, TSV or BED")
    return "," if end == "csv" else "\t"


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Names are given by position; a header row is dropped; names are made from coordinates only if no row has one."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in NAMES])
    df = spark.read.option("sep", _separator(path)).schema(schema).csv(path).where(~F.lower("chrom").isin("chr", "chrom"))
    df = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "region_name")
    if not df.where("region_name IS NOT NULL").limit(1).count():
        df = df.withColumn("region_name", F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    return df


def read_key_table(spark: SparkSession, path: str, required=("chrom", "start", "end")) -> DataFrame:
    """A file with a header; coordinates as long, other columns as numbers where they are."""
    df = spark.read.option("sep", _separator(path)).option("header", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"the table must include columns: {', '.join(missing)}")
    text = {"chrom", "region_name"}
    return df.select(*[F.col(c) if c in text else F.col(c).cast("long" if c in ("start", "end", "num_windows") else "double").alias(c) for c in df.columns])
