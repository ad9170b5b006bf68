"""Positions, windows, regions and reads on hand-made boundary rows."""

import pytest
from pyspark.sql import functions as F

from strandmark.operators import intervals, summarize
from strandmark.schema import parse_mods

SCHEMA = "sample_name string, read_id string, chrom string, start long, end long, read_position long, query_kmer string, call_code string, read_length long, call_prob double, base_qual long, flag long"


def call(start, code="m", sample="s1", chrom="chr1", read="r1", pos=100, length=1000):
    return (sample, read, chrom, start, start + 2, pos, "CG", code, length, 0.99, 30, 0)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_labels():
    specs = parse_mods(["m + h", "21839"], "-", "c")
    assert [(s.column, s.codes) for s in specs] == [("c", ("-",)), ("mh", ("m", "h")), ("m_21839", ("21839",))]


def test_positions_leave_out_coordinate_zero_and_foreign_chromosomes(make):
    df = make([call(0), call(5), call(5, "-"), call(5, "a"), call(7, chrom="X"), call(7, chrom="chrUn")])
    rows = summarize.positions(df).collect()
    assert [(r.start, r.end, r.num_calls, r.c_counts, r.m_counts, r.mh_counts, r.mh_frac) for r in rows] == [(5, 5, 3, 1, 1, 1, 1 / 3)]
    assert summarize.positions(df, chrs=None).count() == 3
    assert summarize.positions(df, samples=["nobody"]).count() == 0
    assert summarize.positions(df, min_num_calls=4).count() == 0


def test_windows_use_the_truncated_remainder(make):
    got = {r.start for r in summarize.windows(make([call(5)]), 1000, 10).collect()}
    assert got == {5 - int((5 - o) - 1000 * int((5 - o) / 1000)) for o in range(1, 1000, 10)}
    assert 11 in got


@pytest.mark.parametrize("size,step", [(1000, 10), (1000, 999), (1000, 1500), (100, 7), (2, 1), (37, 36)])
def test_windows_match_the_definition(make, size, step):
    at = [1, 2, size - 1, size, size + 1, 2 * size + 1, 11, 12, 1010, 1011, 5000, 5036]
    want: dict = {}
    for p in set(at):
        for o in range(1, size, step):
            rest = (p - o) % size if p >= o else -((o - p) % size)
            key = p - rest
            n = want.setdefault(key, [0, 0])
            n[0] += 1
            n[1] += at.count(p)
    got = {r.start: [r.num_CpGs, r.num_calls] for r in summarize.windows(make([call(p) for p in at]), size, step).collect()}
    assert got == want


def test_windows_of_one_offset_partition_the_calls(make):
    df = make([call(p, "m" if p % 3 else "-") for p in range(1, 400, 7)])
    tiled = summarize.windows(df, 50, 50).agg(F.sum("num_calls"), F.sum("c_counts"), F.max("mh_frac")).first()
    flat = summarize.positions(df).agg(F.sum("num_calls"), F.sum("c_counts")).first()
    assert tuple(tiled)[:2] == tuple(flat) and tiled[2] <= 1
    with pytest.raises(ValueError):
        summarize.windows(df, 1, 1)


@pytest.mark.parametrize("large", [False, True])
def test_regions(make, spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    df = make([call(10), call(20), call(21), call(900, sample="s2"), call(20, chrom="chr2")])
    ann = spark.createDataFrame([("1", 10, 20, "a"), ("1", 15, 30_000, "b"), ("2", 500, 600, "lonely"), ("3", 9, 5, "reversed")], "chrom string, start long, end long, region_name string")
    got = {(r.sample_name, r.region_name): r.num_CpGs for r in summarize.regions(df, ann).collect()}
    assert got == {("s1", "a"): 2, ("s1", "b"): 2, ("s2", "b"): 1}
    left = {(r.sample_name, r.region_name): r.num_CpGs for r in summarize.regions(df, ann, "left").collect()}
    assert left == got | {("s1", None): 1}
    right = [(r.sample_name, r.region_name, r.num_CpGs, r.num_calls, r.mh_frac) for r in summarize.regions(df, ann, "right", min_num_calls=0).collect()]
    lone = [r for r in right if r[0] is None]
    assert sorted(r[1] for r in lone) == ["a", "lonely", "lonely", "reversed", "reversed"] and all(r[2:] == (1, 0, None) for r in lone)
    assert len(right) == 8 and summarize.regions(df, ann, "right").count() == 3
    half = {(r.sample_name, r.region_name): r.num_CpGs for r in summarize.regions(df, ann, half_open=True).collect()}
    assert half["s1", "a"] == 1
    with pytest.raises(ValueError):
        summarize.regions(df, ann, "outer")


def test_reads_and_the_compatible_bucket(make, spark):
    df = make([call(12_000 + i, read="far") for i in range(6)] + [call(9_000, "h", read="near"), call(9_100, read="near")])
    ann = spark.createDataFrame([("chr1", 8_000, 33_000)], "chrom string, start long, end long")
    assert {r.read_id: r.total_calls for r in summarize.reads(df, ann, min_CGs=1).collect()} == {"far": 6, "near": 2}
    assert {r.read_id for r in summarize.reads(df, ann, min_CGs=1, compat_bucket=True).collect()} == {"near"}
    r = summarize.reads(df, min_CGs=2).where("read_id = 'near'").first()
    assert (r.first_cpg_pos, r.last_cpg_pos, r.h_counts, r.mh_frac) == (9_000, 9_102, 1, 1.0)
    assert summarize.reads(df, min_length=2000).count() == 0


def test_interval_joins_have_bins_as_keys(make, spark):
    df = make([call(10)])
    ann = spark.createDataFrame([("chr1", 10, 20, "a")], "chrom string, start long, end long, region_name string")
    for out in (summarize.regions(df, ann), summarize.regions(df, ann, "left"), summarize.reads(df, ann)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [chrom" in plan and "__bin" in plan.split("BroadcastHashJoin [chrom")[1].split("\n")[0]


def test_windows_match_plain_python(make):
    import random

    rng = random.Random(4)
    df = make([call(rng.randint(1, 700), rng.choice("mh-")) for _ in range(300)])
    at = [r.start for r in df.collect()]
    for size, step in ((100, 10), (100, 30), (70, 69), (50, 50)):
        want = {}
        for o in range(1, size, step):
            for p in set(at):
                w = o if p < o else p - (p - o) % size
                n, c = want.get(w, (0, 0))
                want[w] = (n + 1, c + at.count(p))
        got = summarize.windows(df, size, step)
        assert {r.start: (r.num_CpGs, r.num_calls) for r in got.collect()} == want
        assert got.count() == len(want)


def test_binned_joins_equal_broadcast_joins(spark):
    import random

    rng = random.Random(0)
    spans = spark.createDataFrame([(i, f"chr{i % 2}", s := rng.randint(0, 90_000), s + rng.randint(0, 25_000)) for i in range(80)], "id int, chrom string, first long, last long")
    ranges = spark.createDataFrame([(j, f"chr{j % 2}", s := rng.randint(0, 90_000), s + rng.randint(-5, 40_000)) for j in range(40)], "j int, i_chrom string, i_start long, i_end long")
    pairs = lambda df: sorted((r.id, r.j) for r in df.collect())
    assert pairs(intervals.overlap_join(spans, ranges, "first", "last", small=True)) == pairs(intervals.overlap_join(spans, ranges, "first", "last", small=False))
    assert pairs(intervals.point_join(spans, ranges, "first", small=True)) == pairs(intervals.point_join(spans, ranges, "first", small=False))
