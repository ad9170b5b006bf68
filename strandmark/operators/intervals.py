"""Joins of points and intervals with intervals, both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: an interval table that touches at most so many bins is broadcast
BROADCAST_ROWS = 200_000
BIN = 10_000


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Counts at most most + 1 rows."""
    most = BROADCAST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    """All bins that [start, end] touches."""
    lo, hi = F.floor(start.cast("long") / width), F.floor(end.cast("long") / width)
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _binned(intervals: DataFrame, width: int, small: bool | None) -> DataFrame:
    """A row for each bin of each interval, to be broadcast if they are few."""
    rows = intervals.withColumn("__bin", F.explode(bins(F.col("i_start"), F.col("i_end"), width)))
    return F.broadcast(rows) if (is_small(rows) if small is None else small) else rows


def point_join(points: DataFrame, intervals: DataFrame, position: str = "start", width: int = BIN, small: bool | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) on chrom and position between i_start and i_end; intervals has i_chrom, i_start and i_end. The keys are chrom and bin."""
    same = (F.col("chrom") == F.col("i_chrom")) & (F.floor(F.col(position) / width) == F.col("__bin"))
    return points.join(_binned(intervals, width, small), same & F.col(position).between(F.col("i_start"), F.col("i_end")), how).drop("__bin")


def overlap_join(spans: DataFrame, intervals: DataFrame, first: str, last: str, width: int = BIN, small: bool | None = None) -> DataFrame:
    """Inner join on chrom where [first, last] and [i_start, i_end] overlap; a pair in several bins is kept in the first one they share."""
    meet = (F.col("chrom") == F.col("i_chrom")) & (F.col(first) <= F.col("i_end")) & (F.col(last) >= F.col("i_start"))
    left = spans.withColumn("__at", F.explode(bins(F.col(first), F.col(last), width)))
    once = F.col("__bin") == F.greatest(F.floor(F.col(first) / width), F.floor(F.col("i_start") / width))
    return left.join(_binned(intervals, width, small), meet & (F.col("__at") == F.col("__bin")) & once).drop("__at", "__bin")
