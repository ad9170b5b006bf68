"""Case against control: tests by locus, merged windows, read classification."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.sinks import stored
from .intervals import overlap_join

TESTS = ("wilcox", "fast_fisher", "r_fisher", "log_reg")


def check_groups(df: DataFrame, cases: Sequence[str], controls: Sequence[str], mod_type: str) -> None:
    labels = sorted(c.removesuffix("_counts") for c in df.columns if c.endswith("_counts"))
    if mod_type not in labels:
        raise ValueError(f"Requested mod_type '{mod_type}' not found among the table's counts ({', '.join(labels)})")
    if "num_calls" not in df.columns:
        raise ValueError("num_calls is not a column of the table")
    present = {r[0] for r in df.where(F.col("sample_name").isin(*cases, *controls)).select("sample_name").distinct().collect()}  # given names
    for what, names in (("case", cases), ("control", controls)):
        if missing := [n for n in names if n not in present]:
            raise ValueError(f"Check {what} names - not among the samples: {', '.join(missing)}")


def calc_diff(df: DataFrame, cases: Sequence[str], controls: Sequence[str], mod_type: str = "mh", calc_type: str | None = None, adjust: bool = True) -> DataFrame:
    """df: positions, windows or regions. Without calc_type, wilcox if a group has several samples, else fast_fisher. A sample in both groups is a case."""
    check_groups(df, cases, controls, mod_type)
    calc_type = calc_type or ("wilcox" if len(cases) > 1 or len(controls) > 1 else "fast_fisher")
    if calc_type not in TESTS:
        raise ValueError(f"Unknown calc_type: {calc_type}. Use one of {', '.join(TESTS)}.")
    loci = [c for c in ("region_name", "chrom", "start", "end") if c in df.columns]
    side = F.when(F.col("sample_name").isin(*cases), True).when(F.col("sample_name").isin(*controls), False)
    rows = df.select(*loci, side.alias("is_case"), "num_calls", F.col(f"{mod_type}_counts").alias("mod")).where("is_case IS NOT NULL")
    if calc_type == "wilcox":
        out = _wilcoxon(rows, loci, mod_type)
        return stats.bh_adjust(stored(out, "tests")) if adjust else out
    return _pooled(rows, loci, mod_type, calc_type, adjust)


def _side(value, case: bool):
    return F.coalesce(F.sum(F.when(F.col("is_case") == case, value)), F.lit(0)).cast("long")


def _pooled(rows: DataFrame, loci: list[str], mod: str, calc_type: str, adjust: bool) -> DataFrame:
    """Replicates are summed; test and adjustment run once for each distinct table of counts, weighted by its loci."""
    other = "unmod_counts" if mod == "c" else "c_counts"
    sides = {"case": True, "control": False}
    dat = rows.groupBy(*loci).agg(*[_side(F.col("num_calls"), v).alias(f"num_calls_{s}") for s, v in sides.items()], *[_side(F.col("mod"), v).alias(f"{mod}_counts_{s}") for s, v in sides.items()])
    dat = dat.withColumns({f"{other}_{s}": F.col(f"num_calls_{s}") - F.col(f"{mod}_counts_{s}") for s in sides})
    cells = [f"{mod}_counts_case", f"{mod}_counts_control", f"{other}_case", f"{other}_control"]
    mc, mk, uc, uk = (F.col(c) for c in cells)
    test = {
        "fast_fisher": lambda: stats.mid_p_column(mc, mc + mk, uc + uk, mc + uc),
        "r_fisher": lambda: stats.fisher_column(mk, mc, uk, uc),
        "log_reg": lambda: stats.g_test_column(mc, uc, mk, uk),
    }[calc_type]()
    tables = dat.groupBy(*cells).agg(F.count(F.lit(1)).alias("__loci")).withColumn("p_val", test)
    if adjust:
        tables = stats.bh_adjust(stored(tables, "tests"), weight="__loci")
    frac = {s: F.when(F.col(f"num_calls_{s}") > 0, F.col(f"{mod}_counts_{s}") / F.col(f"num_calls_{s}")) for s in sides}
    return dat.join(tables.drop("__loci"), cells).select(
        *loci, *[f"num_calls_{s}" for s in sides], *[f"{mod}_counts_{s}" for s in sides], *[f"{other}_{s}" for s in sides],
        *[v.alias(f"{mod}_frac_{s}") for s, v in frac.items()], (frac["case"] - frac["control"]).alias("meth_diff"), "p_val", *(["p_adjust"] if adjust else []),
    )


def _wilcoxon(rows: DataFrame, loci: list[str], mod: str) -> DataFrame:
    """A locus gathers one fraction a sample; the group's value is their unweighted mean."""
    frac = F.when(F.col("num_calls") > 0, F.col("mod") / F.col("num_calls"))
    sides = {"case": True, "control": False}
    aggs = []
    for s, v in sides.items():
        mine = F.col("is_case") == v
        aggs += [F.count(F.when(mine, 1)).alias(f"num_samples_{s}"), _side(F.col("num_calls"), v).alias(f"num_calls_{s}"), _side(F.col("mod"), v).alias(f"{mod}_counts_{s}"), F.avg(F.when(mine, frac)).alias(f"{mod}_frac_{s}"), F.collect_list(F.when(mine, frac)).alias(f"__{s}")]
    dat = rows.groupBy(*loci).agg(*aggs)
    order = [f"{c}_{s}" for c in ("num_samples", "num_calls", f"{mod}_counts", f"{mod}_frac") for s in sides]
    return dat.select(*loci, *order, (F.col(f"{mod}_frac_case") - F.col(f"{mod}_frac_control")).alias("meth_diff"), stats.rank_sum_column(F.sort_array("__case"), F.sort_array("__control")).alias("p_val"))


def collapse_windows(diff: DataFrame, max_distance: int = 1000, sig_cutoff: float = 0.05, min_diff: float = 0.5) -> DataFrame:
    """Merge neighbouring significant windows of one sign: a run ends at a gap of more than max_distance from the row before, or at a change of sign.

    Windows are ordered by chromosome: one exchange serves both window functions, and a chromosome's
    significant windows are bounded by its length, whatever the depth of sequencing.
    """
    found = diff.where((F.col("p_adjust") <= sig_cutoff) & F.col("meth_diff").isNotNull() & ~F.isnan("meth_diff") & (F.abs("meth_diff") >= min_diff))
    cols = [c for c in diff.columns if re.search(r"_(counts|frac)_(control|case)$", c)]
    w = Window.partitionBy("chrom").orderBy("start", "end")
    prev = F.lag(F.struct("end", F.signum("meth_diff").alias("sign"))).over(w)
    new = F.col("__prev").isNull() | (F.col("__prev.end") + max_distance < F.col("start")) | (F.col("__prev.sign") != F.signum("meth_diff"))
    marked = found.select("chrom", "start", "end", "meth_diff", *cols).withColumn("__prev", prev).withColumn("__new", new.cast("long"))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("chrom", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.avg(c).alias(f"avg_{c}") for c in cols], F.avg("meth_diff").alias("avg_meth_diff"), F.count(F.lit(1)).alias("num_windows"))
    return out.drop("__run")


KEY_COLUMNS = ("chrom", "start", "end", "avg_mh_frac_control", "avg_mh_frac_case", "avg_meth_diff")


def classify_reads(reads: DataFrame, key: DataFrame, case: str = "case", control: str = "control", meth_diff_threshold: float = 0.1) -> DataFrame:
    """One row for each read and overlapping key row; control is tried before case."""
    if missing := [c for c in KEY_COLUMNS if c not in key.columns]:
        raise ValueError(f"Key table must include columns: {', '.join(missing)}")
    least = key.agg(F.min(F.abs("avg_meth_diff"))).first()[0]
    if least is not None and meth_diff_threshold >= least / 2:
        raise ValueError(f"meth_diff_threshold must be less than half of the least difference in the key table ({least})")
    ranges = key.select(F.col("chrom").alias("i_chrom"), F.col("start").cast("long").alias("i_start"), F.col("end").cast("long").alias("i_end"), "avg_mh_frac_control", "avg_mh_frac_case")
    joined = overlap_join(reads, ranges, "first_cpg_pos", "last_cpg_pos")
    near = lambda c: F.abs(F.col("mh_frac") - F.col(c)) <= meth_diff_threshold
    label = F.when(near("avg_mh_frac_control"), control).when(near("avg_mh_frac_case"), case).otherwise("unknown")
    return joined.select("sample_name", "read_id", "first_cpg_pos", "last_cpg_pos", "mh_frac", label.alias("classification"))
