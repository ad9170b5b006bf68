"""Registered queries against their SQL on the driver's tables; very long texts; shared folders."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmark.llm import common, decontaminate, langid, lm, quality, secrets, simhash, suffix
from strandmark.llm.queries import ORACLES, QUERIES
from strandmark.sources import paths

from .conftest import SCHEMA, prose

DATA = "/root/testdata/sf0.001"


def cells(rows, cols):
    norm = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else v
    return sorted(str([norm(r[c]) for c in cols]) for r in rows)


def same(got, con, sql):
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert cells([r.asDict() for r in got.collect()], cols) == cells([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    same(QUERIES[name](spark, DATA), con, ORACLES[name])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_language_id", "op10_suffix_dedup"])
def test_query_matches_sql_on_odd_texts(spark, docs, texts, tmp_path, name):
    rows = [(i, None if t is None else t.replace("\x00", "?"), ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


@pytest.fixture(scope="module")
def long(spark):
    """A text of over 5 MB between short ones, one of which shares a passage with its end."""
    rng = random.Random(1)
    words = [prose(rng, 1) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=600_000))
    text += " " * max(0, 5_100_000 - len(text.encode())) + " " + " ".join(rng.choices(words, k=30)) + " token=abcdefgh12"
    return text, spark.createDataFrame([(1, "short one", "en", "s", 0), (2, text, "en", "s", 0), (3, text[-150:], "de", "s", 0), (4, None, None, None, None)], SCHEMA)


def test_long_text(spark, long):
    text, docs = long
    n = len(text.encode())
    assert n > 5_000_000
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    q = by_id(quality.quality_report(docs))
    assert q[2].n_words == len(text.split()) and q[2].word_chars == sum(map(len, text.split()))
    assert by_id(secrets.secret_spans(docs))[2].spans == f"assign:{len(text) - 16}:{len(text)}"
    assert by_id(langid.predict(docs, langid.learn(docs)))[2].lang_pred == "en"
    bench = spark.createDataFrame([(7, " ".join(text.split()[-15:-3]))], "item_id long, text string")
    hits = by_id(decontaminate.contamination(docs, bench))
    assert hits[2].n_hit >= 10 and hits[1].n_hit == 0
    assert by_id(simhash.near_duplicates(docs))[2].fp != 0
    assert by_id(simhash.similar_documents(docs))[2].component_id == 2
    cut = by_id(suffix.suffix_dedup(docs))
    assert (cut[2].n_bytes, cut[3].n_removed, cut[1].n_removed) == (n, cut[3].n_bytes, 0)
    score = by_id(lm.ctw_scores(docs))
    assert score[2].n_tokens == len(text.split()) + 1 and np.isfinite(score[2].score)


def test_shared_folder_is_needed_off_local_masters():
    class Context:
        def __init__(self, master):
            self.master, self.applicationId = master, f"test-{master}"

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            paths.shared_dir(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert paths.shared_dir(Session(master)).startswith("file://") and paths.shared_dir(Session(master)) == paths.shared_dir(Session(master))


def test_scratch_deletes_what_was_made_inside(spark):
    outside = common.materialize(spark.range(3), "outside")
    with common.scratch(spark):
        inside = common.path_of(common.materialize(spark.range(3), "inside"))
        assert paths.exists(spark, inside)
    assert not paths.exists(spark, inside) and outside.count() == 3


def test_free_names(spark):
    df = spark.range(1).withColumns({"Id2": F.lit(1), "_id2": F.lit(1)})
    assert common.free("id2", df) == "__id2" and common.free("x", df) == "x"


def test_runs_that_share_a_hash_are_told_apart():
    text = b"".join(bytes([97 + k % 3]) * 60 for k in range(9))
    start, size = np.arange(9) * 60, np.full(9, 60)
    size[8] = 55
    where, which = suffix.distinct_runs(text + bytes(8), start, size, np.zeros(9, dtype=np.uint64))
    assert where.tolist() == [0, 1, 2, 8] and which.tolist() == [0, 1, 2, 0, 1, 2, 0, 1, 3]
