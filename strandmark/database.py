"""A folder of Parquet tables with the operators as methods."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import differential, filters, summarize
from .plans import qc, workflow
from .session import ship_package
from .sources import annotation, archive, paths, sinks


@dataclass(frozen=True)
class Database:
    """Immutable handle; methods that write a table return a handle whose current_table it is, so calls chain."""

    spark: SparkSession
    root: str
    current_table: str | None = None

    def __post_init__(self) -> None:
        ship_package(self.spark)

    # ------------------------------------------------------------ tables

    def path(self, name: str) -> str:
        if not isinstance(name, str) or not re.fullmatch(r"\w+", name):
            raise ValueError("a table name must be a non-empty word")
        return f"{self.root.rstrip('/')}/{name}"

    def has(self, name: str) -> bool:
        return paths.exists(self.spark, self.path(name))

    def tables(self) -> list[str]:
        if not paths.exists(self.spark, self.root):
            return []
        fs, p = paths.hadoop(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and re.fullmatch(r"\w+", s.getPath().getName()))

    def table(self, name: str | None = None) -> DataFrame:
        name = name or self.current_table
        if not name or not self.has(name):
            raise ValueError(f"{name} table does not exist")
        # sample names such as 001 must stay text when they are partition values
        key = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            return self.spark.read.parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)

    def write(self, df: DataFrame, name: str, overwrite: bool = True, partition_by: list[str] | None = None) -> Database:
        sinks.write_table(df, self.path(name), "overwrite" if overwrite else "append", partition_by)
        return replace(self, current_table=name)

    def remove(self, name: str) -> bool:
        return self.has(name) and paths.delete(self.spark, self.path(name))

    def columns(self, name: str | None = None) -> list[str]:
        return self.table(name).columns

    def collect(self, name: str | None = None, max_rows: int | None = None) -> pd.DataFrame:
        """The table, or a random sample of max_rows rows; empty if there is no such table."""
        if not (name or self.current_table) or not self.has(name or self.current_table):
            return pd.DataFrame()
        return qc.sample_rows(self.table(name), max_rows, check=False).toPandas()

    def info(self) -> dict:
        """Size in MB, tables, and the samples of calls."""
        names = [r[0] for r in self.table("calls").select("sample_name").distinct().orderBy("sample_name").collect()] if self.has("calls") else []
        return {"size_mb": paths.size_of(self.spark, self.root) / 1e6, "tables": self.tables(), "samples": names}

    def table_info(self, name: str | None = None) -> dict:
        df = self.table(name)
        counts = {r["sample_name"]: r["num_rows"] for r in filters.sample_counts(df).collect()} if "sample_name" in df.columns else {}
        return {"rows": df.count(), "per_sample": counts, "columns": df.columns}

    def cpg_count(self, name: str = "calls", by_chrom: bool = False) -> int:
        return filters.cpg_count(self.table(name), by_chrom).first()[0]

    def export(self, names: str | Sequence[str], out_path: str) -> list[str]:
        """CSV files; out_path with a trailing slash, or for several tables, is a folder."""
        names = [names] if isinstance(names, str) else list(names)
        return [sinks.write_csv(self.table(n), f"{out_path.rstrip('/')}/{n}.csv" if out_path.endswith("/") or len(names) > 1 else out_path) for n in names if self.has(n)]

    def __repr__(self) -> str:
        return f"Database({self.root!r}, tables={self.tables()}, current={self.current_table!r})"

    # ------------------------------------------------------------ ingest

    @classmethod
    def create(cls, spark: SparkSession, root: str, files, **ingest) -> Database:
        """Ingest archives into calls, partitioned by sample; tables that were in root are dropped."""
        calls = archive.read_archives(spark, files, **ingest)
        db = cls(spark, root)
        for name in db.tables():
            db.remove(name)
        return db.write(calls, "calls", partition_by=["sample_name"])

    # ------------------------------------------------------------ operators

    def summarize_positions(self, input_table: str = "calls", output_table: str = "positions", overwrite: bool = True, **args) -> Database:
        return self.write(summarize.positions(self.table(input_table), **args), output_table, overwrite)

    def summarize_windows(self, input_table: str = "calls", output_table: str = "windows", overwrite: bool = True, **args) -> Database:
        return self.write(summarize.windows(self.table(input_table), **args), output_table, overwrite)

    def summarize_regions(self, region_file: str, input_table: str = "calls", output_table: str = "regions", overwrite: bool = True, **args) -> Database:
        return self.write(summarize.regions(self.table(input_table), annotation.read_annotation(self.spark, region_file), **args), output_table, overwrite)

    def summarize_reads(self, input_calls_table: str = "calls", output_reads_table: str = "reads", regions_table: str | None = None, **args) -> Database:
        key = annotation.read_key_table(self.spark, regions_table) if regions_table else None
        return self.write(summarize.reads(self.table(input_calls_table), key, **args), output_reads_table)

    def trim_reads(self, input_table: str = "calls", output_table: str = "calls_trimmed", **args) -> Database:
        return self.write(filters.trim_reads(self.table(input_table), **args), output_table)

    def filter_table(self, input_table: str, output_table: str, *conditions: Column | str) -> Database:
        return self.write(filters.filter_rows(self.table(input_table), *conditions), output_table)

    def rename_preview(self, table: str, samples_map: Mapping[str, str], strict: bool = True) -> DataFrame:
        return filters.rename_preview(self.table(table), samples_map, strict)

    def rename_samples(self, table: str, samples_map: Mapping[str, str], strict: bool = True) -> Database:
        return self.write(filters.rename_samples(self.table(table), samples_map, strict), table)

    def calc_diff(self, call_type: str = "positions", output_table: str | None = None, overwrite: bool = True, **args) -> Database:
        name = output_table or f"mod_diff_{call_type}"
        if self.has(name) and not overwrite:
            raise ValueError(f"table {name} exists; overwrite it or choose another output_table")
        diff = differential.calc_diff(self.table(call_type), **args)
        order = [c for c in ("chrom", "start", "end", "region_name") if c in diff.columns]  # many loci share a p-value: they alone would be one range
        return self.write(diff.orderBy(F.asc_nulls_last("p_adjust"), *order), name)

    def collapse_windows(self, input_table: str = "mod_diff_windows", output_table: str = "collapsed_windows", **args) -> Database:
        return self.write(differential.collapse_windows(self.table(input_table), **args).orderBy("chrom", "start"), output_table)

    def classify_reads(self, key_table: str, reads_table: str = "reads", output_table: str = "classified_reads", **args) -> Database:
        key = annotation.read_key_table(self.spark, key_table, differential.KEY_COLUMNS)
        return self.write(differential.classify_reads(self.table(reads_table), key, **args), output_table)

    # ------------------------------------------------------------ queries

    def sql(self, query: str) -> DataFrame:
        """Any Spark SQL; the tables are views of the session under their names."""
        for name in self.tables():
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def transform(self, table: str, fn: Callable[[DataFrame], DataFrame], mode: str = "collect", output_table: str | None = None):
        """fn of a table, as a local frame (collect) or written as output_table (compute)."""
        if mode not in ("collect", "compute"):
            raise ValueError("mode must be collect or compute")
        out = self.table(table).transform(fn)
        if mode == "collect":
            return out.toPandas()
        if not output_table:
            raise ValueError("compute needs an output_table")
        return self.write(out, output_table)

    # ------------------------------------------------------------ what plots draw

    def archive_report(self, files, **args) -> dict[str, DataFrame]:
        return qc.archive_report(self.spark, files, **args)

    def plot_coverage(self, table: str = "positions", max_rows: int | None = None) -> dict[str, DataFrame]:
        return workflow.coverage_plot(qc.sample_rows(self.table(table), max_rows))

    def plot_fractions(self, table: str = "positions", max_rows: int | None = None) -> dict[str, DataFrame]:
        return workflow.fraction_plot(qc.sample_rows(self.table(table), max_rows))

    def plot_pca(self, table: str = "positions", value: str = "m_frac", max_rows: int | None = None) -> DataFrame:
        return qc.sample_pca(qc.sample_rows(self.table(table), max_rows), value)

    def plot_diff(self, table: str = "mod_diff_positions", bins: int = 100) -> DataFrame:
        return qc.volcano_raster(self.table(table), bins)

    def plot_diff_density(self, table: str = "mod_diff_positions", n: int = 250) -> DataFrame:
        return qc.kde_grid(self.table(table), n=n)

    # ------------------------------------------------------------ workflows

    def run_qc(self, **args) -> dict[str, DataFrame]:
        return workflow.run_qc(self, **args)

    def run_analysis(self, out_path: str, **args) -> dict[str, str]:
        return workflow.run_analysis(self, out_path, **args)
