"""Ingest, tables, workflows and streaming end to end."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmark import Database
from strandmark.operators import filters
from strandmark.plans import qc
from strandmark.sources import annotation, archive, paths
from strandmark.streaming.positions import stream_positions

HEADER = ["read_id", "forward_read_position", "chrom", "ref_position", "ref_mod_strand", "read_length", "query_kmer", "call_prob", "call_code", "base_qual", "flag"]


def write_tsv(path, rows):
    with open(path, "w") as f:
        csv.writer(f, delimiter="\t").writerows([HEADER, *rows])


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    """Four samples; cases are modified in the first half, controls in the second."""
    out = tmp_path_factory.mktemp("archives")
    rng = np.random.default_rng(0)
    for sample in ("case1", "case2", "ctrl1", "ctrl2"):
        rows = []
        for r in range(60):
            start = int(rng.integers(1, 4000))
            for k in range(12):
                pos = start + 20 * k
                often = 0.9 if (pos < 2000) == sample.startswith("case") else 0.1
                rows.append([f"x-y-{sample}{r}", k * 20, "chr1", pos, "+", 300, "CG", 0.99, "m" if rng.random() < often else "-", 40, 0])
        rows.append(["bad", 0, "chr1", 100, "+", 300, "CG", 0.5, "m", 40, 0])
        write_tsv(out / f"{sample}.tsv", rows)
        archive.make_archive(spark, str(out / f"{sample}.tsv"), sample, str(out))
    return out


@pytest.fixture
def db(spark, archives, tmp_path):
    return Database.create(spark, str(tmp_path / "db"), str(archives))


def test_coordinates(spark, tmp_path):
    rows = [["a-b-c", 1, "chr1", 10, s, 100, k, 0.9, "m", 20, 0] for s in "+-" for k in ("CG", "CA")] + [["plain", 1, "chr1", 0, "-", 100, "CG", 0.9, "m", 20, 0]]
    write_tsv(tmp_path / "x.tsv", rows)
    df = archive.to_archive(archive.read_call_tsv(spark, str(tmp_path / "x.tsv")), "s")
    assert sorted((r.start, r.end, r.read_id) for r in df.collect()) == [(9, 11, "c"), (10, 11, "c"), (10, 11, "c"), (10, 12, "c")]
    assert archive.to_archive(archive.read_call_tsv(spark, str(tmp_path / "x.tsv")), "s", short_ids=False).first().read_id == "a-b-c"


def test_paths(spark, archives, tmp_path):
    assert {s for s, _ in paths.resolve(spark, str(archives))} == {"case1", "case2", "ctrl1", "ctrl2"}
    one = paths.resolve(spark, str(archives))[0][1]
    assert paths.resolve(spark, f"me={one}")[0][0] == "me" and paths.resolve(spark, {"you": one})[0][0] == "you"
    assert paths.sample_name("/a/S-1.CH3") == "S" and paths.sample_name("x.ch3") == "x"
    with pytest.raises(FileNotFoundError):
        paths.resolve(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        paths.resolve(spark, str(tmp_path))


def test_filters_reach_the_scan(spark, archives):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = archive.read_archives(spark, str(archives))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(call_prob,0.9)" in plan and "GreaterThanOrEqual(base_qual,10)" in plan


def test_tables(db, spark):
    info = db.info()
    assert info["samples"] == ["case1", "case2", "ctrl1", "ctrl2"] and info["tables"] == ["calls"] and info["size_mb"] > 0
    assert db.table_info("calls")["rows"] == 4 * 720 == db.table("calls").count()
    db = db.summarize_positions()
    assert db.current_table == "positions" and db.has("positions") and "positions" in repr(db)
    before = db.table().count()
    db = db.summarize_positions(overwrite=False)
    assert db.table().count() == 2 * before
    db = db.filter_table("positions", "positions", "num_calls > 1", F.col("mh_frac") > 0)  # reads what it replaces
    assert db.table().where("num_calls <= 1 OR mh_frac <= 0").count() == 0
    assert db.sql("SELECT count(*) AS n FROM positions").first().n == db.table().count()
    assert len(db.transform("positions", lambda d: d.limit(3))) == 3
    assert db.transform("positions", lambda d: d.limit(3), "compute", "few").table().count() == 3
    assert len(db.collect("positions", max_rows=5)) == 5 and db.collect("nothing").empty
    assert db.remove("few") and not db.remove("few")
    with pytest.raises(ValueError):
        db.columns("few")
    with pytest.raises(ValueError):
        db.remove("")


def test_rename_trim_and_counts(db):
    renamed = db.rename_samples("calls", {"case1": "001"})
    assert renamed.info()["samples"] == ["001", "case2", "ctrl1", "ctrl2"]
    calls = renamed.table("calls")
    assert filters.check_samples_map(calls, {"case2": "ctrl1"}) == ["several samples become 'ctrl1'"]
    with pytest.raises(ValueError):
        renamed.rename_samples("calls", {"nobody": "x"})
    renamed.rename_samples("calls", {"nobody": "x"}, strict=False)
    with pytest.raises(ValueError):
        renamed.rename_samples("calls", {})
    t = renamed.trim_reads(by_frac=0.2, trim_start=True).table()
    assert t.where("read_position < 60 OR read_position >= 240").count() == 0 and t.count() > 0
    for bad in ({"by_frac": 0}, {"by_frac": 1}, {"trim_end": False}):
        with pytest.raises(ValueError):
            renamed.trim_reads(**bad)
    assert renamed.cpg_count() == renamed.cpg_count(by_chrom=True) == renamed.table("calls").select("start", "end").distinct().count()


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("chrom,start,end,region_name\nchr1,1,5,\nchr2,3,4,x\n")
    (tmp_path / "b.bed").write_text("chr1\t1\t5\nchr2\t3\t4\n")
    assert [r.region_name for r in annotation.read_annotation(spark, str(tmp_path / "a.csv")).orderBy("chrom").collect()] == [None, "x"]
    assert [r.region_name for r in annotation.read_annotation(spark, str(tmp_path / "b.bed")).orderBy("chrom").collect()] == ["chr1_1_5", "chr2_3_4"]
    with pytest.raises(ValueError):
        annotation.read_annotation(spark, "x.txt")
    with pytest.raises(ValueError):
        annotation.read_key_table(spark, str(tmp_path / "a.csv"), ("avg_meth_diff",))


def test_analysis_and_classification(db, tmp_path):
    out = db.run_analysis(str(tmp_path / "out"), cases=["case1", "case2"], controls=["ctrl1", "ctrl2"], call_type="windows", window_size=500, step_size=250)
    with open(out["Sig_CpGs"]) as f:
        merged = list(csv.DictReader(f))
    assert [m["num_windows"] > "0" for m in merged] and float(merged[0]["avg_meth_diff"]) > 0.5
    out2 = db.run_analysis(str(tmp_path / "out2"), cases=["case1"], controls=["ctrl1"])
    with open(out2["mod_diff"]) as f:
        p = [float(r["p_adjust"]) for r in csv.DictReader(f) if r["p_adjust"]]
    assert p == sorted(p)
    done = db.collapse_windows()
    key = done.export("collapsed_windows", f"{tmp_path}/")[0]
    said = done.summarize_reads().classify_reads(key).table()
    best = {r["sample_name"][:4]: r["classification"] for r in said.groupBy("sample_name", "classification").count().orderBy("count").collect()}
    assert best == {"case": "case", "ctrl": "control"}
    with pytest.raises(ValueError):
        db.calc_diff("windows", cases=["case1"], controls=["ctrl1"], overwrite=False)
    (tmp_path / "r.csv").write_text("chrom,start,end,region_name\nchr1,1,1999,first\nchr1,2000,5000,second\n")
    assert {r.region_name for r in db.summarize_regions(str(tmp_path / "r.csv")).table().collect()} == {"first", "second"}


def test_qc(db):
    out = db.run_qc(call_type="calls")
    pos = db.table("positions").toPandas()
    q = out["coverage"].orderBy("prob").toPandas()
    assert np.allclose(q["value"], np.quantile(pos["num_calls"], qc.QUANTILES))
    assert out["modfrac_hist"].agg(F.sum("n")).first()[0] == len(pos) == out["coverage_hist"].agg(F.sum("n")).first()[0]
    wide = pos.pivot_table(index="start", columns="sample_name", values="m_frac")
    corr = out["correlation"].toPandas().pivot(index="sample_x", columns="sample_y", values="corr")
    assert np.allclose(corr, wide.corr(), equal_nan=True)


def test_pca_and_density(spark):
    rng = np.random.default_rng(2)
    x = rng.random((50, 4))
    rows = [(f"s{j}", "chr1", i, i, 10, float(x[i, j])) for i in range(50) for j in range(4)] + [("s0", "chr1", 99, 99, 10, 0.5)]
    df = spark.createDataFrame(rows, "sample_name string, chrom string, start long, end long, num_calls long, m_frac double")
    got = qc.sample_pca(df).toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    z = (z - z.mean(1, keepdims=True)).T
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(got.query("pc < 4").pivot(index="sample_name", columns="pc", values="score").abs(), np.abs(u * s)[:, :3])
    assert np.allclose(got.query("sample_name == 's0' and pc < 4")["sdev"], s[:3] / np.sqrt(3))
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in rng.random((200, 2))], "mh_frac_case double, mh_frac_control double")
    grid = qc.kde_grid(pts, n=40)
    total = grid.agg(F.sum("z")).first()[0] / 39**2
    assert grid.count() == 1600 and 0.7 < total < 1.0
    assert qc.sample_pca(df.where("start = 1")).count() == 0
    with pytest.raises(ValueError):
        qc.kde_grid(pts.limit(5))
    with pytest.raises(ValueError):
        qc.sample_rows(pts, 500)


def test_streaming_positions_equal_batch(db, spark, archives):
    schema = spark.read.parquet(paths.resolve(spark, str(archives))[0][1]).schema
    q = stream_positions(spark, str(archives), schema).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    from strandmark.operators.summarize import positions

    batch = positions(spark.read.option("pathGlobFilter", "*.ch3").parquet(str(archives)))
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, batch.collect()))
