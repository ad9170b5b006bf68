"""Trimming, user filters, renaming and metadata."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_reads(calls: DataFrame, by_frac: float = 0.1, trim_start: bool = False, trim_end: bool = True) -> DataFrame:
    """Keep calls at least by_frac of the read's length from the trimmed ends."""
    if not 0 < by_frac < 1:
        raise ValueError("by_frac must lie between 0 and 1")
    if not (trim_start or trim_end):
        raise ValueError("at least one of trim_start and trim_end must be true")
    if "read_position" not in calls.columns:
        raise ValueError("calls have no read_position")
    out = calls
    if trim_start:
        out = out.where(F.col("read_position") >= F.col("read_length") * by_frac)
    if trim_end:
        out = out.where(F.col("read_position") < F.col("read_length") * (1 - by_frac))
    return out


def filter_rows(df: DataFrame, *conditions: Column | str) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def check_samples_map(df: DataFrame, samples_map: Mapping[str, str], strict: bool = True) -> list[str]:
    """Errors raise; the list holds warnings of names that would be merged."""
    if not samples_map:
        raise ValueError("samples_map is empty")
    if any(not k or not v for k, v in samples_map.items()):
        raise ValueError("samples_map has empty names")
    present = {r[0] for r in df.select("sample_name").distinct().collect()}  # sample names: few
    missing = sorted(set(samples_map) - present)
    if missing and strict:
        raise ValueError("samples not in the table: " + ", ".join(missing))
    after = [samples_map.get(s, s) for s in present]
    return sorted({f"several samples become '{s}'" for s in after if after.count(s) > 1})


def renamed(samples_map: Mapping[str, str]) -> Column:
    new = F.create_map(*[F.lit(x) for pair in samples_map.items() for x in pair])
    return F.coalesce(F.element_at(new, F.col("sample_name")), F.col("sample_name"))


def rename_preview(df: DataFrame, samples_map: Mapping[str, str], strict: bool = True) -> DataFrame:
    """(sample_name, new_name, num_rows) of every sample."""
    check_samples_map(df, samples_map, strict)
    return sample_counts(df).select("sample_name", renamed(samples_map).alias("new_name"), "num_rows")


def rename_samples(df: DataFrame, samples_map: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Samples that come to share a name are a warning."""
    for message in check_samples_map(df, samples_map, strict):
        warnings.warn(message, stacklevel=2)
    return df.withColumn("sample_name", renamed(samples_map))


def cpg_count(df: DataFrame, by_chrom: bool = False) -> DataFrame:
    """Distinct coordinates, by default whatever the chromosome."""
    keys = (["chrom"] if by_chrom else []) + ["start", "end"]
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("num_cpgs"))


def sample_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_name").agg(F.count(F.lit(1)).alias("num_rows")).orderBy("sample_name")
