"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Calls are a deterministic view of lineitem: reads are orders, two cases and two controls, three
chromosomes, stretches that are modified more in cases or in controls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .functions import stats
from .operators import differential, filters, summarize
from .plans import qc, workflow
from .schema import CALL_TSV
from .sources import paths, sinks
from .sources.annotation import read_annotation
from .sources.archive import ingest_filter, make_archive, to_archive

CASES, CONTROLS = ["case1", "case2"], ["ctrl1", "ctrl2"]

_CALLS = """
SELECT
  CASE l_orderkey % 4 WHEN 0 THEN 'case1' WHEN 1 THEN 'case2' WHEN 2 THEN 'ctrl1' ELSE 'ctrl2' END AS sample_name,
  concat('r', CAST(l_orderkey AS VARCHAR(20))) AS read_id,
  concat('chr', CAST(CAST(floor((l_orderkey % 12) / 4) AS BIGINT) + 1 AS VARCHAR(20))) AS chrom,
  pos * 25 AS start, pos * 25 + 2 AS "end",
  CAST(l_linenumber * 100 AS BIGINT) AS read_position, 'CG' AS query_kmer,
  CASE WHEN l_quantity < 3 THEN 'a'
       WHEN l_orderkey % 4 < 2 AND (pos BETWEEN 100 AND 199 OR pos >= 320) AND l_quantity > 5 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'm' END
       WHEN l_orderkey % 4 >= 2 AND pos BETWEEN 220 AND 280 AND l_quantity > 5 THEN 'm'
       WHEN l_quantity > 45 THEN 'm' ELSE '-' END AS call_code,
  CAST(400 + (l_orderkey % 7) * 100 AS BIGINT) AS read_length,
  CAST(1.0 - l_discount AS DOUBLE) AS call_prob,
  CAST(floor(l_quantity) AS BIGINT) AS base_qual,
  CAST((l_orderkey % 2) * 16 AS BIGINT) AS flag
FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CAST((CAST(floor(l_orderkey / 12) AS BIGINT) * 7) % 400 + l_linenumber - 1 AS BIGINT) AS pos FROM {lineitem}) x
"""
_RAW = """
SELECT concat('run-', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS read_id, CAST(l_linenumber * 100 AS BIGINT) AS forward_read_position, 'chr1' AS chrom,
  CAST(l_orderkey % 50 AS BIGINT) AS ref_position, CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END AS ref_mod_strand, CAST(500 AS BIGINT) AS read_length,
  CASE WHEN l_linestatus = 'O' THEN 'CG' ELSE 'CA' END AS query_kmer, CAST(1.0 - l_discount AS DOUBLE) AS call_prob, 'm' AS call_code, CAST(floor(l_quantity) AS BIGINT) AS base_qual, CAST(0 AS BIGINT) AS flag
FROM {lineitem}
"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`").format(lineitem="{x}"), x=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _CALLS)


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_filter(calls(spark, sf_dir))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    start = F.col("n_nationkey").cast("long") * 400
    return n.select(F.concat(F.lit("chr"), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 500 + F.col("n_regionkey") * 50).alias("end"), F.col("n_name").alias("region_name"))


def _windows(spark, sf_dir):
    return summarize.windows(good(spark, sf_dir), step_size=100)


def _diff(spark, sf_dir, calc_type="fast_fisher", **args):
    return differential.calc_diff(sinks.stored(_windows(spark, sf_dir), "windows"), CASES, CONTROLS, calc_type=calc_type, **args)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _collapsed(spark, sf_dir):
    return differential.collapse_windows(_diff(spark, sf_dir))


def _table_info(spark, sf_dir):
    return filters.sample_counts(good(spark, sf_dir))


def _pca(spark, sf_dir):
    out = qc.sample_pca(_windows(spark, sf_dir))
    return out.select("sample_name", "pc", F.round(F.abs("score"), 4).alias("score"), F.round("sdev", 4).alias("sdev"), F.round("percent", 4).alias("percent"))


def _bh(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, None).otherwise((F.col("l_partkey") % 997) * (F.col("l_suppkey") % 13) / 12000.0).alias("p_val"))
    return _rounded(stats.bh_adjust(p), 9)


def _archives(spark, sf_dir) -> str:
    """A folder of archives of two samples, made from call tables."""
    raw, folder = _view(spark, sf_dir, _RAW), paths.new_path(spark, "archives")
    for i, sample in enumerate(("s1", "s2")):
        raw.where(F.col("ref_position") % 2 == i).select(*CALL_TSV.fieldNames()).write.option("sep", "\t").option("header", True).csv(f"{folder}/{sample}.tsv")
        make_archive(spark, f"{folder}/{sample}.tsv", sample, f"{folder}/ch3")
    return f"{folder}/ch3"


def _ingested(spark, sf_dir) -> Database:
    return Database.create(spark, paths.new_path(spark, "db"), [_archives(spark, sf_dir)], min_call_prob=0.95)


def _annotation_file(spark, sf_dir, end: str) -> str:
    df = annotation(spark, sf_dir).select("chrom", "start", "end", *(["region_name"] if end != "bed" else []))
    path = f"{paths.new_path(spark, 'regions')}.{end}"
    df.coalesce(1).write.option("sep", "," if end == "csv" else "\t").option("header", end == "csv").csv(path)
    return path


def _of_calls(spark, sf_dir) -> Database:
    """A database of the good calls."""
    db = Database(spark, paths.new_path(spark, "db"))
    return db.write(good(spark, sf_dir), "calls", partition_by=["sample_name"])


def _csv_round_trip(spark, sf_dir):
    db = _of_calls(spark, sf_dir).summarize_positions()
    file = db.export("positions", f"{db.root}-out/")[0]
    return spark.read.option("header", True).schema(db.table().schema).csv(file)


def _analysis(spark, sf_dir):
    db = _of_calls(spark, sf_dir)
    files = db.run_analysis(f"{db.root}-out", cases=CASES, controls=CONTROLS, call_type="windows", step_size=100)
    found = spark.read.option("header", True).option("inferSchema", True).csv(files["Sig_CpGs"])
    return _rounded(found.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "num_windows")}))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "archive_coords": lambda s, d: to_archive(_view(s, d, _RAW), "s1"),
    "ingest_filter": lambda s, d: ingest_filter(calls(s, d), chrom=["chr1", "chr2"], min_read_length=500, min_call_prob=0.95, flag=0),
    "sample_names": lambda s, d: calls(s, d).select("sample_name").distinct(),
    "positions": lambda s, d: summarize.positions(good(s, d)),
    "positions_custom_codes": lambda s, d: summarize.positions(calls(s, d), chrs=["chr1", "chr3"], samples=["case1", "ctrl1", "nobody"], mod_code=["a", "m+h"], unmod_code=["-", "h"], unmod_label="u"),
    "positions_min_calls": lambda s, d: summarize.positions(good(s, d), min_num_calls=4),
    "windows_overlap": _windows,
    "windows_tiled": lambda s, d: summarize.windows(good(s, d), window_size=500, step_size=500, min_num_calls=20),
    "windows_uneven_step": lambda s, d: summarize.windows(good(s, d), window_size=1000, step_size=30, samples=["case1"]),
    "regions_inner": lambda s, d: summarize.regions(good(s, d), annotation(s, d)),
    "regions_left": lambda s, d: summarize.regions(good(s, d), annotation(s, d), join="left"),
    "regions_right": lambda s, d: summarize.regions(good(s, d), annotation(s, d).where("end < 9000").union(annotation(s, d).where("start >= 9000").withColumn("chrom", F.lit("chr9"))), join="right", min_num_calls=0),
    "reads": lambda s, d: summarize.reads(good(s, d), min_CGs=3),
    "reads_in_regions": lambda s, d: summarize.reads(good(s, d), annotation(s, d), min_CGs=2),
    "trim_end": lambda s, d: filters.trim_reads(calls(s, d)),
    "trim_both": lambda s, d: filters.trim_reads(calls(s, d), 0.15, trim_start=True),
    "filter_table": lambda s, d: filters.filter_rows(summarize.positions(good(s, d)), F.col("num_calls") >= 2, "mh_frac > 0.25 AND chrom <> 'chr2'"),
    "rename_samples": lambda s, d: filters.rename_samples(summarize.positions(good(s, d)), {"case1": "treated", "ctrl1": "plain"}),
    "cpg_count": lambda s, d: filters.cpg_count(good(s, d)),
    "cpg_count_by_chrom": lambda s, d: filters.cpg_count(good(s, d), by_chrom=True),
    "table_info": _table_info,
    "archive_stats": lambda s, d: _rounded(qc.archive_stats(calls(s, d))),
    "coverage_by_threshold": lambda s, d: _rounded(qc.coverage_by_threshold(calls(s, d))),
    "flag_counts": lambda s, d: _rounded(qc.flag_counts(calls(s, d))),
    "coverage_quantiles": lambda s, d: _rounded(qc.quantiles(summarize.positions(good(s, d)), F.col("num_calls"))),
    "modfrac_quantiles": lambda s, d: _rounded((lambda p: qc.quantiles(p, qc.fraction_column(p)))(summarize.positions(good(s, d)))),
    "coverage_summary": lambda s, d: _rounded(qc.summary(summarize.positions(good(s, d)), F.col("num_calls"))),
    "coverage_hist": lambda s, d: qc.histogram(summarize.positions(good(s, d)), F.log10("num_calls"), 0.25),
    "modfrac_hist": lambda s, d: (lambda p: qc.histogram(p, qc.fraction_column(p), 10))(summarize.positions(good(s, d))),
    "diff_fast_fisher": lambda s, d: _rounded(_diff(s, d)),
    "diff_positions": lambda s, d: _rounded(differential.calc_diff(sinks.stored(summarize.positions(good(s, d)), "positions"), CASES, CONTROLS, calc_type="fast_fisher")),
    "diff_r_fisher": lambda s, d: _rounded(_diff(s, d, "r_fisher")),
    "diff_wilcoxon": lambda s, d: _rounded(_diff(s, d, "wilcox")),
    "diff_log_reg": lambda s, d: _rounded(_diff(s, d, "log_reg")),
    "bh_adjust": _bh,
    "collapse_windows": lambda s, d: _rounded(_collapsed(s, d)),
    "classify_reads": lambda s, d: differential.classify_reads(summarize.reads(good(s, d)), sinks.stored(_collapsed(s, d), "key")),
    "sample_corr": lambda s, d: _rounded(qc.sample_correlation(_windows(s, d), call_type="windows")),
    "sample_corr_positions": lambda s, d: _rounded(qc.sample_correlation(summarize.positions(good(s, d)), "mh_frac")),
    "volcano_raster": lambda s, d: qc.volcano_raster(_rounded(_diff(s, d))),
    "significant_rows": lambda s, d: workflow.significant_rows(_windows(s, d), _rounded(_diff(s, d))),
    "sample_pca": _pca,
    "kde_grid": lambda s, d: qc.kde_grid(_diff(s, d)).withColumn("z", F.round("z", 5)),
    "sample_rows": lambda s, d: qc.sample_rows(summarize.positions(good(s, d)), 100),
    "archives_to_calls": lambda s, d: _ingested(s, d).table("calls"),
    "archive_report": lambda s, d: _rounded(qc.archive_report(s, _archives(s, d))["stats"]),
    "annotation_csv": lambda s, d: read_annotation(s, _annotation_file(s, d, "csv")),
    "annotation_bed": lambda s, d: read_annotation(s, _annotation_file(s, d, "bed")),
    "regions_from_file": lambda s, d: _of_calls(s, d).summarize_regions(_annotation_file(s, d, "tsv")).table(),
    "reads_from_key_table": lambda s, d: _of_calls(s, d).summarize_reads(regions_table=_annotation_file(s, d, "csv"), min_CGs=2).table(),
    "csv_round_trip": _csv_round_trip,
    "run_analysis": _analysis,
    "rename_preview": lambda s, d: filters.rename_preview(summarize.positions(good(s, d)), {"case1": "treated", "case2": "treated"}),
    "sql_table": lambda s, d: _of_calls(s, d).sql("SELECT chrom, COUNT(*) AS n, MAX(start) AS last FROM calls WHERE sample_name LIKE 'case%' GROUP BY chrom"),
}


# ------------------------------------------------------------------ SQL


def _counts(specs: dict[str, str]) -> str:
    return ", ".join(f"CAST(SUM(CASE WHEN call_code IN ({codes}) THEN 1 ELSE 0 END) AS BIGINT) AS {n}_counts" for n, codes in specs.items())


def _fracs(labels) -> str:
    return ", ".join(f"CASE WHEN num_calls > 0 THEN {n}_counts / num_calls END AS {n}_frac" for n in labels)


_SPECS = {"c": "'-'", "m": "'m'", "h": "'h'", "mh": "'m', 'h'"}
_NAMES = [f"{n}_counts" for n in _SPECS]
_SUMS = ", ".join(f"CAST(SUM({n}) AS BIGINT) AS {n}" for n in _NAMES)
_GOOD = "read_length >= 50 AND call_prob >= 0.9 AND base_qual >= 10"
_WITH = f"WITH calls AS ({_CALLS.format(lineitem='lineitem')}), good AS (SELECT * FROM calls WHERE {_GOOD}), raw AS ({_RAW.format(lineitem='lineitem')})"
_ANN = """ann AS (SELECT concat('chr', CAST(n_nationkey % 3 + 1 AS VARCHAR)) AS chrom, CAST(n_nationkey * 400 AS BIGINT) AS start, CAST(n_nationkey * 400 + 500 + n_regionkey * 50 AS BIGINT) AS "end", n_name AS region_name FROM nation)"""


def _pos(source: str = "good", specs: dict[str, str] = _SPECS, where: str = "start > 0", having: int = 1) -> str:
    return f"""SELECT sample_name, chrom, start, start AS "end", num_calls, {", ".join(f"{n}_counts" for n in specs)}, {_fracs(specs)}
    FROM (SELECT sample_name, chrom, start, COUNT(*) AS num_calls, {_counts(specs)} FROM {source} WHERE {where} GROUP BY ALL) WHERE num_calls >= {having}"""


def _win(size: int, step: int, having: int = 1, where: str = "TRUE") -> str:
    return f"""SELECT sample_name, chrom, start, start + {size - 1} AS "end", num_CpGs, num_calls, {", ".join(_NAMES)}, {_fracs(_SPECS)} FROM (
    SELECT sample_name, chrom, start - ((start - o) % {size}) AS start, COUNT(*) AS num_CpGs, CAST(SUM(num_calls) AS BIGINT) AS num_calls, {_SUMS}
    FROM pos, range(1, {size}, {step}) t(o) WHERE {where} GROUP BY sample_name, chrom, start - ((start - o) % {size})) WHERE num_calls >= {having}"""


def _reg(join: str, ann: str = "ann", having: int = 1) -> str:
    return f"""SELECT sample_name, region_name, chrom, start, "end", num_CpGs, num_calls, {", ".join(_NAMES)}, {_fracs(_SPECS)} FROM (
    SELECT p.sample_name, a.region_name, a.chrom, a.start, a."end", COUNT(*) AS num_CpGs, CAST(COALESCE(SUM(num_calls), 0) AS BIGINT) AS num_calls, {", ".join(f"CAST(COALESCE(SUM({n}), 0) AS BIGINT) AS {n}" for n in _NAMES)}
    FROM (SELECT sample_name, chrom, start, "end", COUNT(*) AS num_calls, {_counts(_SPECS)} FROM good WHERE start > 0 GROUP BY ALL) p {join} {ann} a ON p.chrom = a.chrom AND p.start BETWEEN a.start AND a."end"
    GROUP BY p.sample_name, a.region_name, a.chrom, a.start, a."end") WHERE num_calls >= {having}"""


def _reads(source: str, min_cgs: int) -> str:
    return f"""SELECT *, m_counts / total_calls AS m_frac, h_counts / total_calls AS h_frac, mh_counts / total_calls AS mh_frac FROM (
    SELECT MIN(c.sample_name) AS sample_name, read_id, MIN(c.chrom) AS chrom, COUNT(*) AS total_calls, MIN(c.start) AS first_cpg_pos, MAX(c."end") AS last_cpg_pos, MIN(read_length) AS read_length, {_counts(_SPECS)}
    FROM {source} GROUP BY read_id) WHERE total_calls >= {min_cgs} AND read_length >= 100"""


_BH = "least(1.0, min(p_val * n / r) OVER (ORDER BY p_val DESC RANGE UNBOUNDED PRECEDING))"


def _adjusted(source: str) -> str:
    """source with p_adjust."""
    return f"""SELECT * EXCLUDE (n, r), {_BH} AS p_adjust FROM (SELECT *, COUNT(*) OVER () AS n, COUNT(*) OVER (ORDER BY p_val RANGE UNBOUNDED PRECEDING) AS r FROM {source} WHERE p_val IS NOT NULL)
    UNION ALL SELECT *, NULL FROM {source} WHERE p_val IS NULL"""


_TAILS = "2 * least(COALESCE(SUM(d) FILTER (i > q), 0) + 0.5 * SUM(d) FILTER (i = q), COALESCE(SUM(d) FILTER (i < q), 0) + 0.5 * SUM(d) FILTER (i = q))"
_EXACT = "least(1.0, SUM(d) FILTER (d <= dq * (1 + 1e-7)))"


def _fisher(p: str, q: str = "mh_counts_case", k: str = "num_calls_case", source: str = "win") -> str:
    """CTEs dat and tested: pooled counts by locus with their p-value."""
    m, n = "(mh_counts_case + mh_counts_control)", "(c_counts_case + c_counts_control)"
    lf = lambda x: f"lgamma({x} + 1.0)"
    density = f"exp({lf('m')} - {lf('i')} - {lf('m - i')} + {lf('n')} - {lf('k - i')} - {lf('n - k + i')} - {lf('m + n')} + {lf('k')} + {lf('m + n - k')})"
    return f"""dat AS (SELECT chrom, start, "end", num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, num_calls_case - mh_counts_case AS c_counts_case, num_calls_control - mh_counts_control AS c_counts_control
      FROM (SELECT chrom, start, "end", {", ".join(f"CAST(COALESCE(SUM({v}) FILTER (sample_name LIKE '{g}%'), 0) AS BIGINT) AS {v}_{s}" for v in ("num_calls", "mh_counts") for s, g in (("case", "case"), ("control", "ctrl")))} FROM {source} GROUP BY chrom, start, "end")),
    cells AS (SELECT DISTINCT mh_counts_case, mh_counts_control, c_counts_case, c_counts_control, {q} AS q, {m} AS m, {n} AS n, {k} AS k FROM (SELECT * FROM dat)),
    terms AS (SELECT *, {density} AS d FROM (SELECT *, unnest(range(greatest(0, k - n), least(m, k) + 1)) AS i FROM cells)),
    marked AS (SELECT *, MAX(CASE WHEN i = q THEN d END) OVER (PARTITION BY mh_counts_case, mh_counts_control, c_counts_case, c_counts_control) AS dq FROM terms),
    pvals AS (SELECT mh_counts_case, mh_counts_control, c_counts_case, c_counts_control, {p} AS p_val FROM marked GROUP BY ALL),
    tested AS (SELECT chrom, start, "end", num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, c_counts_case, c_counts_control,
      CASE WHEN num_calls_case > 0 THEN mh_counts_case / num_calls_case END AS mh_frac_case, CASE WHEN num_calls_control > 0 THEN mh_counts_control / num_calls_control END AS mh_frac_control,
      CASE WHEN num_calls_case > 0 AND num_calls_control > 0 THEN mh_counts_case / num_calls_case - mh_counts_control / num_calls_control END AS meth_diff, least(1.0, p_val) AS p_val
      FROM dat JOIN pvals USING (mh_counts_case, mh_counts_control, c_counts_case, c_counts_control)),
    diff AS ({_adjusted("tested")})"""


_FISHER_COLS = """chrom, start, "end", num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, c_counts_case, c_counts_control"""
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("mh_frac_case", "mh_frac_control", "meth_diff", "p_val", "p_adjust"))
_POSW = f"{_WITH}, pos AS ({_pos()})"
_WINW = f"{_POSW}, win AS ({_win(1000, 100)})"
_DIFFW = f"{_WINW}, {_fisher(_TAILS)}"
_AVG = ["num_calls", "mh_counts", "c_counts", "mh_frac"]
_COLLAPSE = f"""flagged AS (SELECT *, CASE WHEN LAG("end") OVER w IS NULL OR LAG("end") OVER w + 1000 < start OR sign(meth_diff) <> sign(LAG(meth_diff) OVER w) THEN 1 ELSE 0 END AS f
      FROM diff WHERE p_adjust <= 0.05 AND abs(meth_diff) >= 0.5 WINDOW w AS (PARTITION BY chrom ORDER BY start)),
    grouped AS (SELECT *, SUM(f) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
    merged AS (SELECT chrom, MIN(start) AS start, MAX("end") AS "end", {", ".join(f"AVG({v}_{s}) AS avg_{v}_{s}" for v in _AVG if v != "num_calls" for s in ("case", "control"))}, AVG(meth_diff) AS avg_meth_diff, COUNT(*) AS num_windows FROM grouped GROUP BY chrom, run)"""
_QS = ", ".join(map(str, qc.QUANTILES))
_ERFC = "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda j: pow(-1, j) * pow(x, 2 * j + 1) / (exp(lgamma(j + 1)) * (2 * j + 1)))))"
_WILCOX = f"""{_WINW}, fr AS (SELECT chrom, start, "end", sample_name LIKE 'case%' AS is_case, num_calls, mh_counts, mh_counts / num_calls AS f FROM win),
    base AS (SELECT chrom, start, "end", {", ".join(f"COUNT(*) FILTER ({c}) AS num_samples_{s}, CAST(COALESCE(SUM(num_calls) FILTER ({c}), 0) AS BIGINT) AS num_calls_{s}, CAST(COALESCE(SUM(mh_counts) FILTER ({c}), 0) AS BIGINT) AS mh_counts_{s}, AVG(f) FILTER ({c}) AS mh_frac_{s}" for s, c in (("case", "is_case"), ("control", "NOT is_case")))} FROM fr GROUP BY ALL),
    w AS (SELECT a.chrom, a.start, SUM(CASE WHEN b.f < a.f THEN 1.0 WHEN b.f = a.f THEN 0.5 ELSE 0 END) AS w FROM fr a JOIN fr b ON a.chrom = b.chrom AND a.start = b.start AND a.is_case AND NOT b.is_case GROUP BY ALL),
    ties AS (SELECT chrom, start, SUM(t * t * t - t) AS tt FROM (SELECT chrom, start, f, COUNT(*) AS t FROM fr GROUP BY ALL) GROUP BY ALL),
    joined AS (SELECT base.*, mh_frac_case - mh_frac_control AS meth_diff, w, tt, CAST(num_samples_case AS DOUBLE) AS nx, CAST(num_samples_control AS DOUBLE) AS ny FROM base LEFT JOIN w USING (chrom, start) LEFT JOIN ties USING (chrom, start)),
    zed AS (SELECT *, w - nx * ny / 2 AS dev, sqrt(nx * ny / 12 * ((nx + ny + 1) - tt / ((nx + ny) * (nx + ny - 1)))) AS sigma FROM joined),
    xed AS (SELECT *, abs(dev - 0.5 * sign(dev)) / nullif(sigma, 0) / sqrt(2) AS x FROM zed),
    tested AS (SELECT chrom, start, "end", num_samples_case, num_samples_control, num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, mh_frac_case, mh_frac_control, meth_diff,
      CASE WHEN nx = 0 OR ny = 0 THEN NULL WHEN tt = 0 THEN CASE WHEN nx * ny = 1 THEN 1.0 WHEN nx * ny = 2 THEN CASE WHEN w = 1 THEN 1.0 ELSE 2.0 / 3 END ELSE CASE w WHEN 2 THEN 1.0 WHEN 1 THEN 2.0 / 3 WHEN 3 THEN 2.0 / 3 ELSE 1.0 / 3 END END
           WHEN sigma = 0 THEN NULL ELSE least(1.0, {_ERFC}) END AS p_val FROM xed),
    diff AS ({_adjusted("tested")})"""


def _quantile_sql(value: str) -> str:
    return f"""{_POSW} SELECT prob, round(value, 6) AS value FROM (SELECT unnest([{_QS}]::DOUBLE[]) AS prob, unnest(quantile_cont(CAST({value} AS DOUBLE), [{_QS}])) AS value FROM pos)"""


def _corr_sql(table: str, value: str, missing: str) -> str:
    return f"""f AS (SELECT DISTINCT chrom, start, "end" FROM {table}), s AS (SELECT DISTINCT sample_name FROM {table}),
    cell AS (SELECT f.*, s.sample_name, {missing} AS v FROM f CROSS JOIN s LEFT JOIN {table} t ON t.chrom = f.chrom AND t.start = f.start AND t.sample_name = s.sample_name)
    SELECT a.sample_name AS sample_x, b.sample_name AS sample_y, round(corr(a.v, b.v), 6) AS corr FROM cell a JOIN cell b ON a.chrom = b.chrom AND a.start = b.start GROUP BY ALL""".replace("t.value", f"t.{value}")


_TSV = f"""{_WITH}, arch AS (SELECT CASE ref_position % 2 WHEN 0 THEN 's1' ELSE 's2' END AS sample_name, regexp_replace(read_id, '^.*-', '') AS read_id, chrom, CASE WHEN ref_mod_strand = '-' AND query_kmer = 'CG' THEN ref_position - 1 ELSE ref_position END AS start,
      CASE WHEN ref_mod_strand = '+' AND query_kmer = 'CG' THEN ref_position + 2 ELSE ref_position + 1 END AS "end", forward_read_position AS read_position, query_kmer, call_code, read_length, call_prob, base_qual, flag
      FROM raw WHERE NOT (ref_mod_strand = '-' AND ref_position = 0))"""
_STATS = """SELECT COUNT(*) AS num_calls, COUNT(DISTINCT read_id) AS num_reads, round(AVG(read_length), 6) AS avg_read_length, COUNT(*) FILTER (call_prob >= 0.9) AS high_conf_calls, round(COUNT(*) FILTER (call_prob >= 0.9) / COUNT(*) * 100, 6) AS high_conf_percent,
      COUNT(*) FILTER (base_qual >= 10) AS high_qual_calls, round(COUNT(*) FILTER (base_qual >= 10) / COUNT(*) * 100, 6) AS high_qual_percent FROM"""
#: erfc of a non-negative x: the series of erf, from 4 on an asymptotic one
_ERFC_WIDE = """CASE WHEN x < 4 THEN 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 120), lambda j: exp(j * ln(2) + (2 * j + 1) * ln(greatest(x, 1e-300)) - (lgamma(2 * j + 2) - j * ln(2) - lgamma(j + 1)))))
      ELSE exp(-x * x) / (x * sqrt(pi())) * (1 - 1 / (2 * x * x) + 3 / (4 * pow(x, 4)) - 15 / (8 * pow(x, 6)) + 105 / (16 * pow(x, 8))) END"""
_G = " + ".join(f"CASE WHEN {c} > 0 THEN 2 * {c} * ln({c} * CAST(tot AS DOUBLE) / ({r} * CAST({k} AS DOUBLE))) ELSE 0 END" for c, r, k in (("mh_counts_case", "num_calls_case", "mod"), ("c_counts_case", "num_calls_case", "un"), ("mh_counts_control", "num_calls_control", "mod"), ("c_counts_control", "num_calls_control", "un")))


def _log_reg() -> str:
    pooled = _fisher(_TAILS).split("cells AS")[0].rstrip().rstrip(",")
    return f"""{_WINW}, {pooled}, wide AS (SELECT *, mh_counts_case + mh_counts_control AS mod, c_counts_case + c_counts_control AS un, num_calls_case + num_calls_control AS tot FROM dat),
    rooted AS (SELECT *, sqrt(greatest({_G}, 0) / 2) AS x FROM wide),
    tested AS (SELECT chrom, start, "end", num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, c_counts_case, c_counts_control,
      CASE WHEN num_calls_case > 0 THEN mh_counts_case / num_calls_case END AS mh_frac_case, CASE WHEN num_calls_control > 0 THEN mh_counts_control / num_calls_control END AS mh_frac_control,
      CASE WHEN num_calls_case > 0 AND num_calls_control > 0 THEN mh_counts_case / num_calls_case - mh_counts_control / num_calls_control END AS meth_diff,
      CASE WHEN num_calls_case > 0 AND num_calls_control > 0 THEN {_ERFC_WIDE} END AS p_val FROM rooted),
    diff AS ({_adjusted("tested")})"""


def _pca_sql() -> str:
    """Eigenvectors of the samples' products by power iteration, each after the ones before are taken out; the last value of centred rows is 0."""
    names, xs = [*CASES, *CONTROLS], range(4)
    dot = lambda i, t: " + ".join(f"g{i}{j} * {t}{j}" for j in xs)
    parts = [
        "wide AS (SELECT " + ", ".join(f"AVG(m_frac) FILTER (sample_name = '{n}') AS s{i}" for i, n in enumerate(names)) + ' FROM win GROUP BY chrom, start, "end" HAVING ' + " AND ".join(f"COUNT(m_frac) FILTER (sample_name = '{n}') > 0" for n in names) + ")",
        "scaled AS (SELECT " + ", ".join(f"(s{i} - AVG(s{i}) OVER ()) / stddev_samp(s{i}) OVER () AS s{i}" for i in xs) + " FROM wide)",
        "centred AS (SELECT " + ", ".join(f"s{i} - (s0 + s1 + s2 + s3) / 4 AS s{i}" for i in xs) + " FROM scaled)",
        "gram1 AS (SELECT " + ", ".join(f"SUM(s{i} * s{j}) AS g{i}{j}" for i in xs for j in xs) + " FROM centred)",
    ]
    for c in (1, 2, 3):
        step = ", ".join(f"{dot(i, 'v')} AS w{i}" for i in xs)
        norm = "sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3)"
        parts += [
            f"it{c} AS (SELECT 0 AS k, 0.9::DOUBLE AS v0, -0.3::DOUBLE AS v1, 0.2::DOUBLE AS v2, -0.7::DOUBLE AS v3 UNION ALL SELECT k + 1, " + ", ".join(f"w{i} / {norm}" for i in xs) + f" FROM (SELECT k, {step} FROM it{c}, gram{c} WHERE k < 3000))",
            f"vec{c} AS (SELECT {c} AS pc, v0, v1, v2, v3, " + " + ".join(f"v{i} * ({dot(i, 'v')})" for i in xs) + f" AS value FROM it{c}, gram{c} WHERE k = 3000)",
            f"gram{c + 1} AS (SELECT " + ", ".join(f"g{i}{j} - value * v{i} * v{j} AS g{i}{j}" for i in xs for j in xs) + f" FROM gram{c}, vec{c})",
        ]
    parts.append("vecs AS (SELECT * FROM vec1 UNION ALL SELECT * FROM vec2 UNION ALL SELECT * FROM vec3 UNION ALL SELECT 4, 0, 0, 0, 0, 0)")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS sample_name, pc, v{i} AS v, value FROM vecs" for i, n in enumerate(names))
    return f"{_WINW.replace('WITH', 'WITH RECURSIVE', 1)}, {', '.join(parts)} SELECT sample_name, CAST(pc AS INT) AS pc, round(abs(v * sqrt(value)), 4) AS score, round(sqrt(value / 3), 4) AS sdev, round(100 * value / (SELECT SUM(value) FROM vecs), 4) AS percent FROM ({rows})"


_CUSTOM = {"u": "'-', 'h'", "a": "'a'", "mh": "'m', 'h'"}
ORACLES: dict[str, str] = {
    "archive_coords": f"""{_WITH} SELECT 's1' AS sample_name, regexp_replace(read_id, '^.*-', '') AS read_id, chrom, CASE WHEN ref_mod_strand = '-' AND query_kmer = 'CG' THEN ref_position - 1 ELSE ref_position END AS start,
      CASE WHEN ref_mod_strand = '+' AND query_kmer = 'CG' THEN ref_position + 2 ELSE ref_position + 1 END AS "end", forward_read_position AS read_position, read_length, query_kmer, call_prob, call_code, base_qual, flag
      FROM raw WHERE NOT (ref_mod_strand = '-' AND ref_position = 0)""",
    "ingest_filter": f"{_WITH} SELECT * FROM calls WHERE chrom IN ('chr1', 'chr2') AND read_length >= 500 AND call_prob >= 0.95 AND base_qual >= 10 AND flag = 0",
    "sample_names": f"{_WITH} SELECT DISTINCT sample_name FROM calls",
    "positions": f"{_WITH} {_pos()}",
    "positions_custom_codes": f"{_WITH} {_pos('calls', _CUSTOM, "start > 0 AND chrom IN ('chr1', 'chr3') AND sample_name IN ('case1', 'ctrl1')")}",
    "positions_min_calls": f"{_WITH} {_pos(having=4)}",
    "windows_overlap": f"{_POSW} {_win(1000, 100)}",
    "windows_tiled": f"{_POSW} {_win(500, 500, 20)}",
    "windows_uneven_step": f"{_POSW} {_win(1000, 30, where="sample_name = 'case1'")}",
    "regions_inner": f"{_WITH}, {_ANN} {_reg('JOIN')}",
    "regions_left": f"{_WITH}, {_ANN} {_reg('LEFT JOIN')}",
    "regions_right": f"""{_WITH}, {_ANN}, some_ann AS (SELECT * FROM ann WHERE "end" < 9000 UNION ALL SELECT 'chr9', start, "end", region_name FROM ann WHERE start >= 9000), inn AS ({_reg("JOIN", "some_ann", 0)})
      SELECT * FROM inn UNION ALL SELECT NULL, region_name, chrom, start, "end", 1, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL FROM some_ann a, (SELECT DISTINCT sample_name AS s FROM good) b
      WHERE NOT EXISTS (SELECT 1 FROM inn i WHERE i.sample_name = b.s AND i.region_name = a.region_name AND i.chrom = a.chrom AND i.start = a.start AND i."end" = a."end")""",
    "reads": f"{_WITH} {_reads('good c', 3)}",
    "reads_in_regions": f"""{_WITH}, {_ANN} {_reads('good c JOIN ann k ON c.chrom = k.chrom AND c.start BETWEEN k.start AND k."end"', 2)}""",
    "trim_end": f"{_WITH} SELECT * FROM calls WHERE read_position < CAST(read_length AS DOUBLE) * CAST(0.9 AS DOUBLE)",
    "trim_both": f"{_WITH} SELECT * FROM calls WHERE read_position >= CAST(read_length AS DOUBLE) * CAST(0.15 AS DOUBLE) AND read_position < CAST(read_length AS DOUBLE) * CAST(0.85 AS DOUBLE)",
    "filter_table": f"{_POSW} SELECT * FROM pos WHERE num_calls >= 2 AND mh_frac > 0.25 AND chrom <> 'chr2'",
    "rename_samples": f"{_POSW} SELECT * REPLACE (CASE sample_name WHEN 'case1' THEN 'treated' WHEN 'ctrl1' THEN 'plain' ELSE sample_name END AS sample_name) FROM pos",
    "cpg_count": f"""{_WITH} SELECT COUNT(*) AS num_cpgs FROM (SELECT DISTINCT start, "end" FROM good)""",
    "cpg_count_by_chrom": f"""{_WITH} SELECT COUNT(*) AS num_cpgs FROM (SELECT DISTINCT chrom, start, "end" FROM good)""",
    "table_info": f"{_WITH} SELECT sample_name, COUNT(*) AS num_rows FROM good GROUP BY ALL",
    "archive_stats": f"{_WITH} {_STATS} calls",
    "coverage_by_threshold": f"{_WITH}, loci AS (SELECT chrom, start, COUNT(*) AS n FROM calls GROUP BY ALL) SELECT CAST(x AS BIGINT) AS min_reads, COUNT(*) FILTER (n >= x) AS covered, round(COUNT(*) FILTER (n >= x) / COUNT(*) * 100, 6) AS percent FROM loci, (SELECT unnest([1, 5, 10, 15]) AS x) GROUP BY x",
    "flag_counts": f"{_WITH} SELECT flag, COUNT(*) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM calls) * 100, 6) AS percent FROM calls GROUP BY flag",
    "coverage_quantiles": _quantile_sql("num_calls"),
    "modfrac_quantiles": _quantile_sql("100 * mh_frac"),
    "coverage_summary": f"{_POSW} SELECT CAST(MIN(num_calls) AS DOUBLE) AS min, quantile_cont(num_calls, 0.25) AS q1, quantile_cont(num_calls, 0.5) AS median, round(AVG(num_calls), 6) AS mean, quantile_cont(num_calls, 0.75) AS q3, CAST(MAX(num_calls) AS DOUBLE) AS max FROM pos",
    "coverage_hist": f"{_POSW} SELECT CAST(ceil((log10(num_calls) - CAST(0.125 AS DOUBLE)) / CAST(0.25 AS DOUBLE)) AS BIGINT) AS bin, COUNT(*) AS n FROM pos GROUP BY ALL",
    "modfrac_hist": f"{_POSW} SELECT CAST(ceil((100 * mh_frac - 5) / 10) AS BIGINT) AS bin, COUNT(*) AS n FROM pos GROUP BY ALL",
    "diff_fast_fisher": f"{_DIFFW} SELECT {_FISHER_COLS}, {_ROUND} FROM diff",
    "diff_positions": f"{_POSW}, {_fisher(_TAILS, source='pos')} SELECT {_FISHER_COLS}, {_ROUND} FROM diff",
    "diff_r_fisher": f"{_WINW}, {_fisher(_EXACT)} SELECT {_FISHER_COLS}, {_ROUND} FROM diff",
    "diff_wilcoxon": f"""{_WILCOX} SELECT chrom, start, "end", num_samples_case, num_samples_control, num_calls_case, num_calls_control, mh_counts_case, mh_counts_control, {_ROUND} FROM diff""",
    "bh_adjust": f"""WITH tested AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_partkey % 997) * (l_suppkey % 13) / 12000.0 END AS p_val FROM lineitem), adj AS ({_adjusted("tested")})
      SELECT l_orderkey, l_linenumber, round(p_val, 9) AS p_val, round(p_adjust, 9) AS p_adjust FROM adj""",
    "collapse_windows": f"{_DIFFW}, {_COLLAPSE} SELECT chrom, start, \"end\", {', '.join(f'round(avg_{v}_{s}, 6) AS avg_{v}_{s}' for v in _AVG if v != 'num_calls' for s in ('case', 'control'))}, round(avg_meth_diff, 6) AS avg_meth_diff, num_windows FROM merged",
    "classify_reads": f"""{_DIFFW}, {_COLLAPSE}, rd AS ({_reads("good c", 5)}) SELECT r.sample_name, read_id, first_cpg_pos, last_cpg_pos, mh_frac,
      CASE WHEN abs(mh_frac - avg_mh_frac_control) <= 0.1 THEN 'control' WHEN abs(mh_frac - avg_mh_frac_case) <= 0.1 THEN 'case' ELSE 'unknown' END AS classification FROM rd r JOIN merged k ON r.chrom = k.chrom AND r.first_cpg_pos <= k."end" AND r.last_cpg_pos >= k.start""",
    "sample_corr": f"{_WINW}, {_corr_sql('win', 'm_frac', 'COALESCE(t.value, 0)')}",
    "sample_corr_positions": f"{_POSW}, {_corr_sql('pos', 'mh_frac', 't.value')}",
    "volcano_raster": f"""{_DIFFW}, pts AS (SELECT round(meth_diff, 6) AS x, -log10(round(p_val, 6)) AS y FROM diff WHERE meth_diff IS NOT NULL AND round(p_val, 6) > 0),
      edge AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM pts)
      SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 100)), 99) AS BIGINT) AS x_bin, CAST(least(floor((y - y0) / ((y1 - y0) / 100)), 99) AS BIGINT) AS y_bin, COUNT(*) AS n FROM pts, edge GROUP BY ALL""",
    "significant_rows": f"{_DIFFW} SELECT win.* FROM win JOIN diff USING (chrom, start) WHERE round(diff.p_val, 6) <= 0.05",
    "sample_pca": _pca_sql(),
    "diff_log_reg": f"{_log_reg()} SELECT {_FISHER_COLS}, {_ROUND} FROM diff",
    "kde_grid": f"""{_DIFFW}, pts AS (SELECT mh_frac_case AS a, mh_frac_control AS b FROM diff WHERE mh_frac_case IS NOT NULL AND mh_frac_control IS NOT NULL),
      wide AS (SELECT COUNT(*) AS n, 1.06 * least(stddev_samp(a), (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) / 1.34) * pow(COUNT(*), -0.2) AS ha, 1.06 * least(stddev_samp(b), (quantile_cont(b, 0.75) - quantile_cont(b, 0.25)) / 1.34) * pow(COUNT(*), -0.2) AS hb FROM pts),
      few AS (SELECT a, b, COUNT(*) AS w FROM pts GROUP BY a, b), grid AS (SELECT i, i / 249.0::DOUBLE AS g FROM range(0, 250) t(i))
      SELECT x.i / 249.0::DOUBLE AS x, y.i / 249.0::DOUBLE AS y, round(SUM(w * exp(-pow((x.g - a) / ha, 2) / 2) * exp(-pow((y.g - b) / hb, 2) / 2) / (2 * pi() * n * ha * hb)), 5) AS z FROM few, wide, grid x, grid y GROUP BY x.i, y.i""",
    "sample_rows": f"""{_POSW} SELECT * FROM pos ORDER BY md5(concat_ws('|', '0', sample_name, chrom, start, "end", num_calls, {", ".join(_NAMES)})) LIMIT 100""",
    "archives_to_calls": f"{_TSV} SELECT * FROM arch WHERE read_length >= 50 AND call_prob >= 0.95 AND base_qual >= 10",
    "archive_report": f"{_TSV} {_STATS} arch",
    "annotation_csv": f"WITH {_ANN} SELECT * FROM ann",
    "annotation_bed": f"""WITH {_ANN} SELECT * REPLACE (concat(chrom, '_', start, '_', "end") AS region_name) FROM ann""",
    "regions_from_file": f"{_WITH}, {_ANN} {_reg('JOIN')}",
    "reads_from_key_table": f"""{_WITH}, {_ANN} {_reads('good c JOIN ann k ON c.chrom = k.chrom AND c.start BETWEEN k.start AND k."end"', 2)}""",
    "csv_round_trip": f"{_WITH} {_pos()}",
    "run_analysis": f"{_DIFFW}, {_COLLAPSE} SELECT chrom, start, \"end\", {', '.join(f'round(avg_{v}_{s}, 6) AS avg_{v}_{s}' for v in _AVG if v != 'num_calls' for s in ('case', 'control'))}, round(avg_meth_diff, 6) AS avg_meth_diff, num_windows FROM merged",
    "rename_preview": f"{_POSW} SELECT sample_name, CASE WHEN sample_name LIKE 'case%' THEN 'treated' ELSE sample_name END AS new_name, COUNT(*) AS num_rows FROM pos GROUP BY sample_name",
    "sql_table": f"{_WITH} SELECT chrom, COUNT(*) AS n, MAX(start) AS last FROM good WHERE sample_name LIKE 'case%' GROUP BY chrom",
}
