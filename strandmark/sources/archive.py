"""Call archives: from call tables, and into the calls table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARCHIVE_COLUMNS, CALL_TSV, CALL_TYPES, CALLS_COLUMNS
from . import paths


def read_call_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(CALL_TSV).csv(path)


def to_archive(calls: DataFrame, sample: str, short_ids: bool = True) -> DataFrame:
    """Archive rows of one sample: unplaced minus-strand calls dropped, 0-based half-open coordinates, CG calls on both bases."""
    cg, plus, minus = F.col("query_kmer") == "CG", F.col("ref_mod_strand") == "+", F.col("ref_mod_strand") == "-"
    pos = F.col("ref_position")
    read_id = F.regexp_replace("read_id", "^.*-", "") if short_ids else F.col("read_id")
    rows = calls.where(~(minus & (pos == 0)))
    return rows.select(
        F.lit(sample).alias("sample_name"), read_id.alias("read_id"), "chrom", F.when(minus & cg, pos - 1).otherwise(pos).alias("start"), F.when(plus & cg, pos + 2).otherwise(pos + 1).alias("end"),
        F.col("forward_read_position").alias("read_position"), "read_length", "query_kmer", "call_prob", "call_code", "base_qual", "flag",
    ).select(*ARCHIVE_COLUMNS)


def make_archive(spark: SparkSession, file_name: str, sample: str, out_path: str, short_ids: bool = True) -> list[str]:
    """Write <out_path>/<sample>-<i>.ch3, zstd Parquet; the paths."""
    stage = f"{out_path.rstrip('/')}/_{sample}.stage"
    to_archive(read_call_tsv(spark, file_name), sample, short_ids).write.mode("overwrite").option("compression", "zstd").parquet(stage)
    fs, p = paths.hadoop(spark, stage)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    out = []
    for i, part in enumerate(parts):
        target = f"{out_path.rstrip('/')}/{sample}-{i}.ch3"
        paths.delete(spark, target)
        paths.rename(spark, part, target)
        out.append(target)
    paths.delete(spark, stage)
    return out


def ingest_filter(calls: DataFrame, chrom: str | Sequence[str] | None = None, min_read_length: int = 50, min_call_prob: float = 0.9, min_base_qual: int = 10, flag: int | None = None) -> DataFrame:
    """Quality filters on plain columns, so that they are pushed to the Parquet scan; a null drops the row."""
    keep: Column = (F.col("read_length") >= min_read_length) & (F.col("call_prob") >= min_call_prob) & (F.col("base_qual") >= min_base_qual)
    if chrom is not None:
        keep &= F.col("chrom").isin(*([chrom] if isinstance(chrom, str) else chrom))
    if flag is not None:
        keep &= F.col("flag") == flag
    return calls.where(keep)


def read_archives(spark: SparkSession, files, **filters) -> DataFrame:
    """Calls of all archives, under the samples' names by file: one scan for each sample's files, united."""
    by_sample: dict[str, list[str]] = {}
    for sample, path in paths.resolve(spark, files):
        by_sample.setdefault(sample, []).append(path)
    out = None
    for sample, own in by_sample.items():
        df = spark.read.parquet(*own)
        df = ingest_filter(df, **filters)
        wanted = [c for c in CALLS_COLUMNS if c != "read_position" or c in df.columns]
        df = df.withColumn("sample_name", F.lit(sample)).select(*[F.col(c).cast(CALL_TYPES.get(c, "string")).alias(c) for c in wanted])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
