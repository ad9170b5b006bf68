"""Summaries of calls by position, sliding window, region and read.

Counts are additive, so each summary is partial and final hash aggregation; samples are
grouped together instead of one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mods import code_counts, fractions, summed_counts
from ..schema import DEFAULT_CHRS, DEFAULT_MODS, parse_mods
from .intervals import point_join


def _usable(calls: DataFrame, chrs: Sequence[str] | None, samples: Sequence[str] | None) -> DataFrame:
    """Coordinate 0 is left out, unknown sample names are ignored; both filters reach the scan."""
    df = calls.where(F.col("start") > 0)
    if chrs is not None:
        df = df.where(F.col("chrom").isin(*chrs))
    if samples is not None:
        df = df.where(F.col("sample_name").isin(*samples))
    return df


def positions(calls: DataFrame, chrs=DEFAULT_CHRS, samples=None, mod_code=DEFAULT_MODS, unmod_code="-", unmod_label="c", min_num_calls: int = 1) -> DataFrame:
    specs = parse_mods(mod_code, unmod_code, unmod_label)
    counted = _usable(calls, chrs, samples).groupBy("sample_name", "chrom", "start").agg(F.count(F.lit(1)).alias("num_calls"), *code_counts(specs))
    kept = counted.where(F.col("num_calls") >= min_num_calls)
    return kept.select("sample_name", "chrom", "start", F.col("start").alias("end"), "num_calls", *[f"{s.column}_counts" for s in specs], *fractions(specs))


def windows(calls: DataFrame, window_size: int = 1000, step_size: int = 10, chrs=DEFAULT_CHRS, samples=None, mod_code=DEFAULT_MODS, unmod_code="-", unmod_label="c", min_num_calls: int = 1) -> DataFrame:
    """Windows of window_size that start at each offset 1, 1 + step, ... below window_size.

    A position before an offset belongs to the window that starts at the offset. Positions are counted
    once and summed over the cells between neighbouring offsets, which share all their windows. The cells of a
    turn of window_size positions meet those of the next one in a single row (each is sent twice), from
    which all windows that start in the turn are summed: those of its cells from the offset on, and the next turn's before it.
    """
    if window_size < 2 or step_size < 1:
        raise ValueError("window_size must be at least 2 and step_size at least 1")
    specs = parse_mods(mod_code, unmod_code, unmod_label)
    n = len(range(1, window_size, step_size))
    at = _usable(calls, chrs, samples).groupBy("sample_name", "chrom", "start").agg(F.count(F.lit(1)).alias("num_calls"), *code_counts(specs))
    turn = F.floor((F.col("start") - 1) / window_size)
    cell = F.least(F.floor(((F.col("start") - 1) % window_size) / step_size), F.lit(n - 1))
    cells = at.groupBy("sample_name", "chrom", turn.alias("turn"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("num_CpGs"), F.sum("num_calls").alias("num_calls"), *summed_counts(specs))
    sums = ["num_CpGs", "num_calls", *[f"{s.column}_counts" for s in specs]]
    places = F.array(F.struct(F.col("turn").alias("turn"), F.col("cell").alias("cell")), F.struct((F.col("turn") - 1).alias("turn"), (F.col("cell") + n).alias("cell")))
    dealt = cells.select("sample_name", "chrom", F.explode(places).alias("place"), *sums).where("place.turn >= 0")
    turns = dealt.groupBy("sample_name", "chrom", "place.turn").agg(F.collect_list(F.struct(F.col("place.cell").alias("cell"), *sums)).alias("cells"))  # 2 n of them at most

    def window(j):
        zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in sums])
        inside = lambda c: (c["cell"] < j + n) & ((c["cell"] >= j) | (F.col("turn") == 0))
        total = F.aggregate(F.filter("cells", inside), zero, lambda acc, c: F.struct(*[(acc[x] + c[x]).alias(x) for x in sums]))
        return F.struct((F.col("turn") * window_size + 1 + j * step_size).cast("long").alias("start"), total.alias("sum"))

    summed = turns.select("sample_name", "chrom", F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), window))).select("sample_name", "chrom", "start", "sum.*")
    kept = summed.where((F.col("num_CpGs") > 0) & (F.col("num_calls") >= min_num_calls))
    return kept.select("sample_name", "chrom", "start", (F.col("start") + window_size - 1).alias("end"), "num_CpGs", "num_calls", *[f"{s.column}_counts" for s in specs], *fractions(specs))


def match_chr_style(annotation: DataFrame, calls: DataFrame) -> DataFrame:
    """Add or strip a lower-case chr on the annotation, as any call's chromosome has it."""
    if calls.where(F.col("chrom").startswith("chr")).limit(1).count():
        return annotation.withColumn("chrom", F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom")))
    return annotation.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def regions(calls: DataFrame, annotation: DataFrame, join: str = "inner", chrs=DEFAULT_CHRS, samples=None, mod_code=DEFAULT_MODS, unmod_code="-", unmod_label="c", min_num_calls: int = 1, half_open: bool = False) -> DataFrame:
    """annotation: chrom, start, end (inclusive unless half_open), region_name.

    join "left" keeps positions in no region, one row without region for each sample; "right" keeps regions without
    positions, once for each sample but without its name, if min_num_calls lets them through.
    """
    if join not in ("inner", "left", "right"):
        raise ValueError("join must be inner, left or right")
    specs = parse_mods(mod_code, unmod_code, unmod_label)
    names = [f"{s.column}_counts" for s in specs]
    at = _usable(calls, chrs, samples).groupBy("sample_name", "chrom", "start", "end").agg(F.count(F.lit(1)).alias("num_calls"), *code_counts(specs))
    last = F.col("end").cast("long") - (1 if half_open else 0)
    ranges = match_chr_style(annotation, calls).select("region_name", F.col("chrom").alias("i_chrom"), F.col("start").cast("long").alias("i_start"), last.alias("i_end"), F.col("end").cast("long").alias("r_end"))
    keys = ["sample_name", "region_name", F.col("i_chrom").alias("chrom"), F.col("i_start").alias("start"), F.col("r_end").alias("end")]
    joined = point_join(at, ranges, how="left" if join == "left" else "inner")
    sums = [F.sum("num_calls").alias("num_calls"), *summed_counts(specs)]
    out = joined.select("sample_name", "region_name", "i_chrom", "i_start", "r_end", "num_calls", *names).groupBy(*keys).agg(F.count(F.lit(1)).alias("num_CpGs"), *sums)
    if join == "right" and min_num_calls <= 0:
        present = {r[0] for r in (_usable(calls, chrs, None) if samples is None else calls).select("sample_name").distinct().collect()}  # one row a sample
        who = sorted(x for x in present if x is not None and (samples is None or x in samples))
        every = ranges.select(F.explode(F.array(*map(F.lit, who)).cast("array<string>")).alias("__s"), "region_name", F.col("i_chrom").alias("chrom"), F.col("i_start").alias("start"), F.col("r_end").alias("end"))
        same = (every["__s"] == out["sample_name"]) & every["region_name"].eqNullSafe(out["region_name"]) & (every["chrom"] == out["chrom"]) & (every["start"] == out["start"]) & (every["end"] == out["end"])
        lone = every.join(out, same, "left_anti").drop("__s")
        out = out.unionByName(lone.withColumns({"num_CpGs": F.lit(1).cast("long"), "num_calls": F.lit(0).cast("long"), **{n: F.lit(0).cast("long") for n in names}}), allowMissingColumns=True)
    return out.where(F.col("num_calls") >= min_num_calls).select("sample_name", "region_name", "chrom", "start", "end", "num_CpGs", "num_calls", *names, *fractions(specs))


def reads(calls: DataFrame, key_regions: DataFrame | None = None, min_length: int = 100, min_CGs: int = 5, compat_bucket: bool = False) -> DataFrame:
    """One row a read id; sample, chromosome and length are the least of the read's. A call in several regions counts several times.

    compat_bucket looks for regions only in the 10 kb bucket of their start.
    """
    df = calls
    if key_regions is not None:
        ranges = key_regions.select(F.col("chrom").alias("i_chrom"), F.col("start").cast("long").alias("i_start"), F.col("end").cast("long").alias("i_end"))
        df = point_join(calls, ranges)
        if compat_bucket:
            df = df.where(F.floor(F.col("start") / 10_000) == F.floor(F.col("i_start") / 10_000))
    code = F.col("call_code")
    n = lambda *codes: F.sum(F.when(code.isin(*codes), 1).otherwise(0)).cast("long")
    out = df.groupBy("read_id").agg(
        F.min("sample_name").alias("sample_name"), F.min("chrom").alias("chrom"), F.count(F.lit(1)).alias("total_calls"), F.min("start").alias("first_cpg_pos"), F.max("end").alias("last_cpg_pos"),
        F.min("read_length").alias("read_length"), n("-").alias("c_counts"), n("m").alias("m_counts"), n("h").alias("h_counts"), n("m", "h").alias("mh_counts"),
    )
    out = out.where((F.col("total_calls") >= min_CGs) & (F.col("read_length") >= min_length))
    return out.select("sample_name", "read_id", "chrom", "total_calls", "first_cpg_pos", "last_cpg_pos", "read_length", "c_counts", "m_counts", "h_counts", "mh_counts", *[(F.col(f"{x}_counts") / F.col("total_calls")).alias(f"{x}_frac") for x in ("m", "h", "mh")])
