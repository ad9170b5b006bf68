"""Operators 2 and 5 against plain Python, SQL and round trips."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandmark.llm import decontaminate, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def benchmark(texts):
    w = words(texts[60])
    items = [(1, " ".join(w[5:30])), (10, "One"), (2, None), (3, ""), (None, " ".join(w[:12])), (4, " ".join(w[2:12]) + " " + " ".join(w[40:55])), (5, "word word word"), (6, texts[90]), (6, texts[90]), (7, "the the of the")]
    return items


def test_decontamination_matches_brute_force(spark, docs, texts):
    items = benchmark(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    windows = []
    for i, t in items:
        w = words(t)
        if w and i is not None:
            n = min(10, len(w))
            windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1)]
    for d, t in enumerate(texts):
        w = words(t)
        hit, found = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(i))
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert {k for s, e in r.hit_spans for k in range(s, e)} == hit


def test_decontamination_in_many_blocks_and_segments(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame(benchmark(texts), "item_id long, text string")
    one = sorted(decontaminate.contamination(docs, bench).drop("items", "hit_spans").collect())
    index = decontaminate.build_index(docs)
    assert sorted(decontaminate.search(index, decontaminate.build_queries(bench.repartition(4))).drop("items", "hit_spans").collect()) == one


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a x x x x b c"), (4, "a b"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index, queries = decontaminate.build_index(docs), decontaminate.build_queries(bench)
    exact = {r.doc_id for r in decontaminate.search(index, queries).where("contaminated").collect()}
    near = {r.doc_id for r in decontaminate.search(index, queries, slop=2).where("contaminated").collect()}
    assert (exact, near) == (set(), {1, 2})


def test_proximity_of_repeated_words(spark):
    """Against all spans: each word of the item as often as the item has it."""
    rng = random.Random(2)
    texts = ["x a y b z w", "a b a", "a x x a b", "b a a", None, "", *[" ".join(rng.choices("aabcx", k=rng.randint(1, 14))) for _ in range(60)]]
    items = [(1, "a a b"), (2, "c c"), (3, "a b c a"), (4, "a")]
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    queries = decontaminate.build_queries(spark.createDataFrame(items, "item_id long, text string"))
    for slop in (0, 1, 3):
        got = {r.doc_id: r["items"] for r in decontaminate.search(index, queries, slop=slop).collect()}
        for d, t in enumerate(texts):
            w = (t or "").split()
            want = [str(i) for i, x in items if any(not Counter(x.split()) - Counter(w[k : k + len(x.split()) + slop]) for k in range(len(w)))]
            assert got[d] == want, (t, slop)


def test_windows_are_filed_under_their_rarest_term(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame(benchmark(texts), "item_id long, text string").repartition(3)
    index, queries = decontaminate.build_index(docs), decontaminate.build_queries(bench)
    often = Counter(w for t in texts for w in words(t))
    h = dict(zip(decontaminate.words_of([" ".join(often).encode()])[0].tolist(), often, strict=True))
    seen = 0
    for row in decontaminate.file_windows(index, queries).collect():
        block = decontaminate.Block(row.asDict())
        anchor = np.repeat(block.anchors, np.diff(block.first))
        for a, window, n in zip(anchor.tolist(), block.words.tolist(), block.length.tolist(), strict=True):
            assert often.get(h.get(a), 0) == min(often.get(h.get(x), 0) for x in window[:n])
            seen += 1
    assert seen > 50
    want = sorted(decontaminate.search(index, queries).drop("items", "hit_spans").collect())
    monkeypatch.setattr(decontaminate, "CACHE_BYTES", 0)
    assert sorted(decontaminate.search(index, queries).drop("items", "hit_spans").collect()) == want


def test_repeated_rows_and_clashing_columns(spark, docs, texts):
    bench = spark.createDataFrame(benchmark(texts), "item_id long, text string").withColumn("block", F.lit("x"))
    want = sorted(decontaminate.contamination(docs, bench).drop("items", "hit_spans").collect())
    clash = docs.withColumns({c: F.lit("x") for c in ("first", "terms", "positions", "n_hit")})
    assert sorted(decontaminate.contamination(clash.union(clash), bench).drop("items", "hit_spans").collect()) == sorted(want * 2)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    clash = df.withColumns({c: F.lit("x") for c in ("digest", "salt", "newest", "key", "file", "refers_to")})
    count = lambda x: Counter(r.key for r in warc.write_archives(x).collect())
    assert count(clash) == count(df)


def test_decontamination_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0


def pages():
    big, small = "x" * 1500, "y" * 900
    rows = [(i, f"http://www.h{i % 3}.example.com/p{i}?q={i}#f", ["A" + big, big, small, "é" * 700, None][i % 5]) for i in range(60)]
    return rows + [(100, None, big), (None, "not a url [", big), (101, "http://[::1", ""), (102, "http://a b\r\nc/ü", "\r\n\r\n" + big), (3, rows[3][1], rows[3][2])]


def test_warc_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op5_warc_index(spark, str(tmp_path)).toArrow().to_pandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP5_SQL).df()
    cols = sorted(want.columns)
    key = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None).values.tolist()))
    as_int = lambda f: f.assign(**{c: f[c].astype("Int64") for c in ("page_id", "refers_to")})
    assert key(as_int(got)) == key(as_int(want))
    assert (got["record_type"] == "revisit").sum() > 10


def test_warc_lookup_reads_only_matching_records(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(df), block=4)
    keys = spark.createDataFrame([(warc.surt(pages()[7][1]),), ("com,nowhere)/",)], "key string")
    found = warc.lookup(keys, index).collect()
    assert [(r.page_id, r.payload_bytes) for r in found] == [(7, 900)]
    assert warc.surt("HTTPS://www.Ex.Com:80/a?b#c") == "com,ex)/a?b"


def test_warc_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc_index(spark, str(tmp_path)).count() == 0


def test_oracle_of_op2_on_fixture(spark, docs, texts, tmp_path):
    docs.where("doc_id < 80").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark(texts), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(decontaminate.OP2_SQL).arrow().read_all() if hasattr(con.sql("SELECT 1").arrow(), "read_all") else con.sql(decontaminate.OP2_SQL).arrow()
    got = decontaminate.op2_decontamination(spark, str(tmp_path))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, (r.values() for r in want.select(cols).to_pylist()))) == sorted(tuple(r[c] for c in cols) for r in got.collect())
