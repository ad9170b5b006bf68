"""Composite workflows over a Database."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import differential
from ..sources import sinks
from . import qc


def coverage_plot(df: DataFrame) -> dict[str, DataFrame]:
    """What a plot of coverage draws: quantiles, and bins of log10 calls."""
    return {"coverage": qc.quantiles(df, F.col("num_calls")), "coverage_hist": qc.histogram(df, F.log10("num_calls"), 0.25)}


def fraction_plot(df: DataFrame) -> dict[str, DataFrame]:
    """What a plot of modified fractions draws: quantiles, and bins of percentages."""
    frac = qc.fraction_column(df)
    return {"modfrac": qc.quantiles(df, frac), "modfrac_hist": qc.histogram(df, frac, 10)}


def run_qc(db, call_type: str = "positions", value: str = "m_frac", max_rows: int | None = None, sample_order: Sequence[str] | None = None, agg_fun: Callable[[str], Column] = F.avg) -> dict[str, DataFrame]:
    """Coverage, modified fractions, correlation and PCA of a table; for calls, positions are built first. The correlation keeps sample_order, and the samples in it."""
    if call_type == "calls":
        db.summarize_positions()
        call_type = "positions"
    df = qc.sample_rows(db.table(call_type), max_rows)
    correlation = qc.sample_correlation(df, value, agg_fun, call_type=call_type)
    if sample_order is not None:
        place = {c: F.array_position(F.array(*map(F.lit, sample_order)), F.col(c)) for c in ("sample_x", "sample_y")}
        correlation = correlation.where((place["sample_x"] > 0) & (place["sample_y"] > 0)).orderBy(*place.values())
    return coverage_plot(df) | fraction_plot(df) | {"correlation": correlation, "pca": qc.sample_pca(df, value)}


def significant_rows(table: DataFrame, diff: DataFrame, p_val_max: float = 0.05) -> DataFrame:
    """Rows of table at loci with an unadjusted p-value of at most p_val_max; a locus that diff holds twice matches twice."""
    found = diff.where(F.col("p_val") <= p_val_max).select("chrom", "start", "end")
    return table.join(found, ["chrom", "start", "end"]).select(*table.columns)


def run_analysis(db, out_path: str, cases, controls, call_type: str = "positions", annotation: str | None = None, window_size: int = 1000, step_size: int = 10, mod_type: str = "mh", calc_type: str = "fast_fisher", p_val_max: float = 0.05) -> dict[str, str]:
    """Summarise, test and export three CSV files; their paths."""
    if call_type == "positions":
        db.summarize_positions()
    elif call_type == "windows":
        db.summarize_windows(window_size=window_size, step_size=step_size)
    elif call_type == "regions":
        if not annotation:
            raise ValueError("regions need an annotation file")
        db.summarize_regions(annotation)
    else:
        raise ValueError("call_type must be positions, windows or regions")
    db.calc_diff(call_type, cases=cases, controls=controls, mod_type=mod_type, calc_type=calc_type)
    diff, table = db.table(f"mod_diff_{call_type}"), db.table(call_type)
    if call_type == "windows":
        sig = differential.collapse_windows(diff)
    else:
        sig = significant_rows(table, diff, p_val_max)
    base = f"{out_path.rstrip('/')}/Mod_Diff_Analysis_Results"
    return {name: sinks.write_csv(df, f"{base}/{name}.csv") for name, df in (("mod_diff", diff), ("All_CpGs", table), ("Sig_CpGs", sig))}
