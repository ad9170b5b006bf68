"""Tests by locus, adjustment, merging and classification."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmark.functions import stats
from strandmark.operators import differential


def one(fn, *args):
    """A test of one row."""
    return fn(*[[a] for a in args])[0]

TWO_LOCI = [(s, "chr1", p, p + 1, n, m) for p, rows in ((100, ((10, 7), (12, 8), (11, 3), (9, 4))), (200, ((8, 2), (10, 2), (12, 6), (7, 3)))) for s, (n, m) in zip(("case1", "case2", "ctrl1", "ctrl2"), rows, strict=True)]
SCHEMA = "sample_name string, chrom string, start long, end long, num_calls long, mh_counts long"
CASES, CONTROLS = ["case1", "case2"], ["ctrl1", "ctrl2"]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(TWO_LOCI, SCHEMA)


@pytest.mark.parametrize("table,mid,exact", [((7, 3, 3, 7), 0.10095477278, 0.17889540800), ((8, 2, 4, 6), 0.09478447249, 0.16980233389), ((10, 0, 0, 10), 5.412544e-06, 1.0825088e-05), ((12, 5, 8, 15), 0.03154055057, 0.05355099258)])
def test_known_tables(table, mid, exact):
    a, b, c, d = table
    assert one(stats.mid_p, b, a + b, c + d, b + d) == pytest.approx(mid, rel=1e-6)
    assert one(stats.fisher_exact, a, b, c, d) == pytest.approx(exact, rel=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 60)] * 4))
def test_p_values_equal_exact_rationals(table):
    a, b, c, d = table
    m, n, k = a + b, c + d, a + c
    ways = {i: math.comb(m, i) * math.comb(n, k - i) for i in range(max(0, k - n), min(m, k) + 1)}
    total = sum(ways.values())
    half = Fraction(ways[a], 2)
    tail = min(sum(v for i, v in ways.items() if i > a) + half, sum(v for i, v in ways.items() if i < a) + half)
    assert one(stats.mid_p, a, m, n, k) == pytest.approx(float(2 * tail / total), abs=1e-10)
    assert one(stats.fisher_exact, a, b, c, d) == pytest.approx(float(Fraction(sum(v for v in ways.values() if v <= ways[a] * (1 + 1e-7)), total)), abs=1e-9)


def test_rank_sum():
    assert one(stats.rank_sum, [1, 2], [3, 4]) == pytest.approx(1 / 3)
    assert one(stats.rank_sum, [1, 2, 3], [4, 5, 6, 7]) == pytest.approx(2 / math.comb(7, 3))
    assert math.isnan(one(stats.rank_sum, [], [1.0])) and math.isnan(one(stats.rank_sum, [1, 1], [1]))
    assert one(stats.rank_sum, [1, 1, 2], [2, 3, 3]) == pytest.approx(math.erfc(3.5 / math.sqrt(4.8) / math.sqrt(2)))
    rng = np.random.default_rng(0)
    assert one(stats.rank_sum, list(rng.normal(size=60)), list(rng.normal(1, size=60))) < 0.01


def test_rows_are_independent(monkeypatch):
    monkeypatch.setattr(stats, "HELD", 50)
    rng = np.random.default_rng(1)
    tables = rng.integers(0, 30, (4, 200))
    for fn in (stats.mid_p, stats.fisher_exact):
        a, b, c, d = tables
        args = (a, a + b, c + d, a + c) if fn is stats.mid_p else tables
        assert fn(*args) == pytest.approx([one(fn, *r) for r in zip(*args, strict=True)], abs=1e-13)
    x, y = ([list(rng.integers(0, 6, rng.integers(0, 5)) / 4) for _ in range(100)] for _ in range(2))
    assert stats.rank_sum(x, y) == pytest.approx([one(stats.rank_sum, u, v) for u, v in zip(x, y, strict=True)], nan_ok=True)
    grid = np.linspace(0, 12, 500)
    assert stats.erfc(grid) == pytest.approx([math.erfc(v) for v in grid], rel=1e-10)


def brute_rank_sum(x, y):
    from itertools import combinations

    both = sorted(x + y)
    w = sum(a > b for a in x for b in y)
    all_w = [sum(a > b for a in c for b in both if b not in c) for c in combinations(both, len(x))]
    tail = sum(v >= w for v in all_w) if w > len(x) * len(y) / 2 else sum(v <= w for v in all_w)
    return min(2 * tail / len(all_w), 1.0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=8, unique=True), st.data())
def test_rank_sum_equals_enumeration(values, data):
    k = data.draw(st.integers(1, len(values) - 1))
    assert one(stats.rank_sum, values[:k], values[k:]) == pytest.approx(brute_rank_sum(values[:k], values[k:]))


def test_fisher_on_two_loci(two):
    got = {r.start: r for r in differential.calc_diff(two, CASES, CONTROLS, calc_type="fast_fisher").collect()}
    assert got[100].p_val == pytest.approx(0.0387231267) and got[200].p_val == pytest.approx(0.1286843812)
    assert got[100].meth_diff == pytest.approx(0.3318181818) and got[200].meth_diff == pytest.approx(-0.2514619883)
    assert "mh_counts_case" in got[100].asDict() and all(0 <= r.p_adjust <= 1 for r in got.values())
    exact = {r.start: r.p_val for r in differential.calc_diff(two, CASES, CONTROLS, calc_type="r_fisher").collect()}
    assert exact[100] == pytest.approx(0.0622614981) and exact[200] == pytest.approx(0.1704467856)


def test_default_test_and_groups(spark, two):
    wil = differential.calc_diff(two, CASES, CONTROLS).collect()
    assert wil[0].num_samples_case == 2
    assert "num_samples_case" not in differential.calc_diff(two, ["case1"], ["ctrl1"]).columns
    both = differential.calc_diff(two, ["case1", "ctrl1"], ["ctrl1", "ctrl2"], calc_type="fast_fisher").where("start = 100").first()
    assert (both.num_calls_case, both.num_calls_control) == (21, 9)
    only = spark.createDataFrame([*TWO_LOCI, ("case1", "chr1", 300, 301, 5, 5)], SCHEMA)
    r = differential.calc_diff(only, CASES, CONTROLS, calc_type="fast_fisher").where("start = 300").first()
    assert (r.p_val, r.mh_frac_control, r.meth_diff) == (1.0, None, None)
    assert differential.calc_diff(only, CASES, CONTROLS, calc_type="wilcox").where("start = 300").first().p_val is None


def test_errors(spark, two):
    with pytest.raises(ValueError, match="Requested mod_type 'h' not found"):
        differential.calc_diff(two, CASES, CONTROLS, mod_type="h")
    with pytest.raises(ValueError, match="^Check case names"):
        differential.calc_diff(two, ["nobody"], CONTROLS)
    with pytest.raises(ValueError, match="^Check control names"):
        differential.calc_diff(two, CASES, ["nobody"])
    with pytest.raises(ValueError, match="wilcox"):
        differential.calc_diff(two, CASES, CONTROLS, calc_type="magic")


def test_log_reg_is_the_likelihood_ratio_test(two):
    p = differential.calc_diff(two, CASES, CONTROLS, calc_type="log_reg").where("start = 100").first().p_val
    obs = np.array([[15.0, 7.0], [7.0, 13.0]])
    exp = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    assert p == pytest.approx(math.erfc(math.sqrt((2 * (obs * np.log(obs / exp)).sum()) / 2)))


def brute_bh(p):
    ok = [v for v in p if v is not None and not math.isnan(v)]
    rank = {v: sum(w <= v for w in ok) for v in ok}
    q = {v: v * len(ok) / rank[v] for v in ok}
    return [None if v is None or math.isnan(v) else min(1.0, min(q[w] for w in ok if w >= v)) for v in p]


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_bh(spark, monkeypatch, one_task):
    monkeypatch.setattr(stats, "ONE_TASK", one_task)
    rng = np.random.default_rng(1)
    for p in ([0.01, 0.02, 0.02, None, 0.5], [0.0, 0.0, 1e-300, 1.0, float("nan")], [None], rng.beta(0.3, 3, 400).tolist() + [1.0] * 20):
        got = [r.p_adjust for r in stats.bh_adjust(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_val double")).orderBy("i").collect()]
        assert got == brute_bh(p)


def diff_rows(spark, rows):
    return spark.createDataFrame([("chr1", s, e, d, 0.5 + d / 2, 0.01) for s, e, d in rows], "chrom string, start long, end long, meth_diff double, mh_frac_case double, p_adjust double")


@pytest.mark.parametrize("rows,distance,want", [
    ([(1, 1000, 0.6), (2000, 2999, 0.7)], 1000, [2]), ([(1, 1000, 0.6), (2001, 3000, 0.7)], 1000, [1, 1]), ([(1, 1000, 0.6), (500, 1499, -0.6)], 1000, [1, 1]),
    ([(1, 1000, 0.6), (10, 20, 0.6), (1900, 2000, 0.6)], 500, [2, 1]), ([(1, 10, float("nan")), (1, 10, 0.1)], 0, []),
])
def test_collapse(spark, rows, distance, want):
    got = differential.collapse_windows(diff_rows(spark, rows), max_distance=distance).orderBy("start").collect()
    assert [r.num_windows for r in got] == want
    if want == [2]:
        assert got[0].avg_meth_diff == pytest.approx(0.65) and got[0].avg_mh_frac_case == pytest.approx(0.825)


def test_classify(spark):
    reads = spark.createDataFrame([("s", f"r{i}", "chr1", 100, 200, f) for i, f in enumerate([0.1, 0.9, 0.5, None])] + [("s", "out", "chr1", 301, 400, 0.1)], "sample_name string, read_id string, chrom string, first_cpg_pos long, last_cpg_pos long, mh_frac double")
    key = spark.createDataFrame([("chr1", 200, 300, 0.1, 0.9, 0.8)], "chrom string, start long, end long, avg_mh_frac_control double, avg_mh_frac_case double, avg_meth_diff double")
    assert {r.read_id: r.classification for r in differential.classify_reads(reads, key).collect()} == {"r0": "control", "r1": "case", "r2": "unknown", "r3": "unknown"}
    with pytest.raises(ValueError, match="less than half"):
        differential.classify_reads(reads, key, meth_diff_threshold=0.4)
    with pytest.raises(ValueError, match="must include"):
        differential.classify_reads(reads, key.drop("avg_meth_diff"))
