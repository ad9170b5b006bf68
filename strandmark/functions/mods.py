"""Conditional counts and fractions of call codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ModSpec


def code_counts(specs: list[ModSpec], code: str = "call_code") -> list[Column]:
    return [F.sum(F.when(F.col(code).isin(*s.codes), 1).otherwise(0)).cast("long").alias(f"{s.column}_counts") for s in specs]


def summed_counts(specs: list[ModSpec]) -> list[Column]:
    return [F.sum(f"{s.column}_counts").cast("long").alias(f"{s.column}_counts") for s in specs]


def fractions(specs: list[ModSpec]) -> list[Column]:
    """Null where there are no calls."""
    return [F.when(F.col("num_calls") > 0, F.col(f"{s.column}_counts") / F.col("num_calls")).alias(f"{s.column}_frac") for s in specs]
