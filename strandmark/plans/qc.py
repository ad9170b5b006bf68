"""Quality control as DataFrames: what a plot would draw."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import paths

#: probabilities of the quantile tables (fixed values)
QUANTILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.995, 0.999, 1.0]


def archive_stats(calls: DataFrame, call_prob_threshold: float = 0.9, base_qual_threshold: float = 10) -> DataFrame:
    """One row; percentages are of all rows."""
    high = lambda c, t: F.sum(F.when(F.col(c) >= t, 1).otherwise(0))
    total = F.count(F.lit(1))
    percent = lambda n: F.when(total > 0, n / total * 100)
    return calls.agg(
        total.alias("num_calls"), F.count_distinct("read_id").alias("num_reads"), F.avg("read_length").alias("avg_read_length"),
        high("call_prob", call_prob_threshold).alias("high_conf_calls"), percent(high("call_prob", call_prob_threshold)).alias("high_conf_percent"),
        high("base_qual", base_qual_threshold).alias("high_qual_calls"), percent(high("base_qual", base_qual_threshold)).alias("high_qual_percent"),
    )


def coverage_by_threshold(calls: DataFrame, min_reads: Sequence[int] = (1, 5, 10, 15)) -> DataFrame:
    """Loci with at least so many calls, and their percentage."""
    loci = calls.groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("n"))
    one = loci.agg(F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col("n") >= x, 1)).alias(f"c{x}") for x in min_reads])
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("min_reads"), F.col(f"c{x}").alias("covered"), F.when(F.col("all") > 0, F.col(f"c{x}") / F.col("all") * 100).alias("percent")) for x in min_reads])
    return one.select(F.inline(rows))


def flag_counts(calls: DataFrame) -> DataFrame:
    n = calls.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)  # one row a flag value


def archive_report(spark: SparkSession, files, log_file: str | None = None, min_reads: Sequence[int] = (1, 5, 10, 15), call_prob_threshold: float = 0.9, base_qual_threshold: float = 10) -> dict[str, DataFrame]:
    """Statistics, coverage and flags of archives, by their paths and unfiltered; with log_file also as a text there."""
    calls = spark.read.parquet(*[path for _, path in paths.resolve(spark, files)])
    report = {"stats": archive_stats(calls, call_prob_threshold, base_qual_threshold), "coverage": coverage_by_threshold(calls, min_reads), "flags": flag_counts(calls).orderBy("flag")}
    if log_file:
        tables = [f"{name}\n{df.toPandas().to_string(index=False)}\n" for name, df in report.items()]  # a row, one a threshold, one a flag value
        paths.write_text(spark, log_file, "\n".join([f"archives: {files}\n", *tables]))
    return report


def quantiles(df: DataFrame, value: Column) -> DataFrame:
    """(prob, value): exact, interpolated linearly, from distinct values and their frequencies; rows with a null are left out."""
    counts = df.dropna().groupBy(value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.percentile("v", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q"))
    return found.select(F.posexplode(F.when(F.col("q").isNotNull(), F.arrays_zip(F.array(*map(F.lit, QUANTILES)).alias("prob"), F.col("q").alias("value"))))).select("col.prob", "col.value")


def fraction_column(df: DataFrame) -> Column:
    """Percent modified, both modifications if the table has that column."""
    return 100 * F.col("mh_frac" if "mh_frac" in df.columns else "m_frac")


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """(bin, n): bins of the width, centred on its multiples and closed on the right; bin is the multiple."""
    return df.dropna().select(F.ceil((value - width / 2) / width).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, value: Column) -> DataFrame:
    x = df.dropna().select(value.cast("double").alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return x.agg(F.min("v").alias("min"), q[0].alias("q1"), q[1].alias("median"), F.avg("v").alias("mean"), q[2].alias("q3"), F.max("v").alias("max"))


def sample_rows(df: DataFrame, max_rows: int | None, seed: int = 0, check: bool = True) -> DataFrame:
    """The max_rows rows first in the order of a hash of the seed and their texts and whole numbers, whatever the partitions; more than there are is an error unless check is off."""
    if max_rows is None:
        return df
    if check and df.count() < max_rows:
        raise ValueError("max_rows is larger than the table")
    exact = [c for c, t in df.dtypes if t in ("string", "boolean") or t.endswith("int")] or df.columns
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in exact]))).limit(max_rows)


def volcano_raster(diff: DataFrame, bins: int = 100) -> DataFrame:
    """Counts on a grid over meth_diff and -log10(p_val)."""
    ok = F.col("meth_diff").isNotNull() & F.col("p_val").isNotNull() & ~F.isnan("meth_diff") & ~F.isnan("p_val") & (F.col("p_val") > 0)
    points = diff.where(ok).select(F.col("meth_diff").alias("x"), (-F.log10("p_val")).alias("y"))
    edge = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v: F.when(F.col(f"{v}1") > F.col(f"{v}0"), F.least(F.floor((F.col(v) - F.col(f"{v}0")) / ((F.col(f"{v}1") - F.col(f"{v}0")) / bins)), F.lit(bins - 1))).otherwise(0).cast("long")
    return points.join(F.broadcast(edge)).select(cell("x").alias("x_bin"), cell("y").alias("y_bin")).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def _feature(df: DataFrame) -> list[str]:
    return ["region_name"] if "region_name" in df.columns else ["chrom", "start", "end"]


def sample_matrix(df: DataFrame, value: str = "m_frac", agg: Callable[[str], Column] = F.avg, fill: float | None = None) -> tuple[DataFrame, list[str]]:
    """(features x samples, sample names); columns s0, s1... in the order of the names."""
    samples = [r[0] for r in df.select("sample_name").distinct().orderBy("sample_name").collect()]  # one row a sample
    cells = [agg(F.when(F.col("sample_name") == s, F.col(value))).alias(f"s{i}") for i, s in enumerate(samples)]
    wide = df.groupBy(*_feature(df)).agg(*cells) if cells else df.select(*_feature(df)).limit(0)
    return (wide if fill is None else wide.fillna(fill, [f"s{i}" for i in range(len(samples))])), samples


def sample_correlation(df: DataFrame, value: str = "m_frac", agg: Callable[[str], Column] = F.avg, call_type: str = "positions") -> DataFrame:
    """(sample_x, sample_y, corr): Pearson over features with both values; windows count a missing value as 0."""
    wide, samples = sample_matrix(df, value, agg, 0.0 if call_type == "windows" else None)
    pairs = [(i, j) for i in range(len(samples)) for j in range(len(samples))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "sample_x string, sample_y string, corr double")
    one = wide.agg(*[F.corr(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs if i <= j])
    rows = F.array(*[F.struct(F.lit(samples[i]).alias("sample_x"), F.lit(samples[j]).alias("sample_y"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("corr")) for i, j in pairs])
    return one.select(F.inline(rows))


def sample_pca(df: DataFrame, value: str = "m_frac") -> DataFrame:
    """(sample_name, pc, score, sdev, percent) of complete features; sample columns are standardised, features centred across samples.

    The matrix is tall: Spark reduces it to samples x samples products, whose eigenvectors give the scores. Signs are arbitrary.
    Empty if there are under two complete features, or a sample whose value is the same in all of them.
    """
    wide, samples = sample_matrix(df.dropna(), value)
    cols = [f"s{i}" for i in range(len(samples))]
    wide = wide.dropna(subset=cols)
    stats = wide.agg(*[F.avg(c).alias(f"m{c}") for c in cols], *[F.stddev_samp(c).alias(f"d{c}") for c in cols]).first() if cols else None
    schema = "sample_name string, pc int, score double, sdev double, percent double"
    if not cols or any(not stats[f"d{c}"] for c in cols):
        return df.sparkSession.createDataFrame([], schema)
    scaled = wide.select(*[((F.col(c) - stats[f"m{c}"]) / stats[f"d{c}"]).alias(c) for c in cols])
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    centred = scaled.select(*[(F.col(c) - mean).alias(c) for c in cols])
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]).first()
    gram = np.array([[sums[f"{cols[min(i, j)]}_{cols[max(i, j)]}"] for j in range(len(cols))] for i in range(len(cols))])
    value_, vector = np.linalg.eigh(gram)
    value_, vector = np.maximum(value_[::-1], 0), vector[:, ::-1]
    scores = vector * np.sqrt(value_)
    rows = [(s, k + 1, float(scores[i, k]), float(np.sqrt(value_[k] / max(len(cols) - 1, 1))), float(100 * value_[k] / max(value_.sum(), 1e-300))) for i, s in enumerate(samples) for k in range(len(cols))]
    return df.sparkSession.createDataFrame(rows, schema)


def kde_grid(diff: DataFrame, x: str = "mh_frac_case", y: str = "mh_frac_control", n: int = 250) -> DataFrame:
    """(x, y, z): Gaussian density of the pairs on an n x n grid over the unit square, with normal-reference bandwidths.

    Distinct points are weighted by their number; tasks add up separable kernels, so only n x n partial sums are exchanged.
    """
    points = diff.select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")).dropna()
    quart = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    s = points.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("a").alias("da"), F.stddev_samp("b").alias("db"), quart("a").alias("qa"), quart("b").alias("qb")).first()
    if s["n"] < 20:
        raise ValueError("a density needs 20 points at least")
    width = [1.06 * min(d, (q[1] - q[0]) / 1.34) * s["n"] ** -0.2 for d, q in ((s["da"], s["qa"]), (s["db"], s["qb"]))]
    if min(width) <= 0:
        raise ValueError("The points do not spread in both directions.")
    grid, total = np.linspace(0, 1, n), s["n"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.zeros((n, n))
        for pdf in batches:
            for at in range(0, len(pdf), 10_000):
                part = pdf.iloc[at : at + 10_000]
                k = [np.exp(-(((grid[:, None] - part[c].to_numpy()[None]) / h) ** 2) / 2) for c, h in zip("ab", width, strict=True)]
                z += (k[0] * part["w"].to_numpy()) @ k[1].T
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "z": z.ravel() / (2 * np.pi * total * width[0] * width[1])})

    weighted = points.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    sums = weighted.mapInPandas(add, "i long, j long, z double").groupBy("i", "j").agg(F.sum("z").alias("z"))
    return sums.select((F.col("i") / (n - 1)).alias("x"), (F.col("j") / (n - 1)).alias("y"), "z")
