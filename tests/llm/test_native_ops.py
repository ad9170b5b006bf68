"""Operators 8 and 9 against SQL and plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandmark.llm import chat, mixing

CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
    (4, 5, "user", "hi"), (4, 9, "assistant", "no"), (5, 0, None, None), (6, 0, None, ""), (6, 1, "user", "x"), (7, 0, "user", "dup"), (7, 0, "user", "dup"), (8, 0, "user", "dup"), (None, 0, "user", "lost"),
    (9, None, "user", "b"), (9, None, "user", "a"), (10, 0, "user", "h"), (10, 1, "i", ""), (11, 0, "user", "é" * 5000), (12, 0, "user", "é" * 5000),
]


def duck(tmp_path, name, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con.sql(sql)


def same(spark_df, duck_rel):
    cols = sorted(spark_df.columns)
    assert sorted(duck_rel.columns) == cols
    return sorted(map(str, (tuple(r[c] for c in cols) for r in spark_df.collect()))) == sorted(map(str, duck_rel.select(*cols).fetchall()))


def test_chat_matches_sql(spark, tmp_path):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op9_chat_snapshots(spark, str(tmp_path))
    assert same(got, duck(tmp_path, "conversations", chat.OP9_SQL))
    kept = {r.conv_id: r.n_copies for r in got.collect()}
    assert kept == {2: 1, 3: 2, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1, 11: 2}


def test_chat_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, k string, h string")
    assert chat.format_chats(none).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a", "k", "h")], "conv_id long, turn long, role string, text string, k string, n string")
    assert chat.format_chats(clash).collect()[0].chat == "<|im_start|>user\na<|im_end|>\n"


def test_mixing_matches_sql(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert same(mixing.op8_poisson_mix(spark, str(tmp_path)), duck(tmp_path, "documents", mixing.OP8_SQL))


@pytest.mark.parametrize("rate", [0.3, 2.5, 16.0, 100.0])
def test_mean_and_variance_follow_poisson(spark, rate):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("x").alias("text"))
    other = spark.range(n, n + 1).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("x" * 100_000).alias("text"))
    share = rate * n / (n + 100_000)
    got = mixing.mix(df.union(other), {"a": share, "b": 1 - share}).where("source = 'a'").groupBy("doc_id").count().agg(F.sum("count").alias("s"), F.sum(F.col("count") ** 2).alias("q")).first()
    mean = got.s / n
    assert abs(mean - rate) < 5 * (rate / n) ** 0.5
    assert abs(got.q / n - mean**2 - rate) < 0.15 * rate


def test_mixing_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    clash = docs.withColumn("mix_copy", F.lit("x")).withColumn("cdf", F.lit(1)).withColumn("size", F.lit(2))
    out = mixing.mix(clash)
    assert set(out.columns) == set(clash.columns) | {"mix_order"} and out.count() > 0
    assert mixing.mix(docs, {"s1": 1.0}).where("source IS NULL OR source <> 's1'").count() == 0


def test_rows_without_id_are_spread(spark):
    n = 3000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("same").alias("text"), (F.col("id") % 7).alias("rate"), F.lit("x").alias("__rate"), F.lit(1).alias("count"), F.lit(2).alias("salt"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix(df).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(r["count"] for r in got)
    assert len(got) == 4 and max(r["count"] for r in got) < 0.4 * total
    assert mixing.mix(df).columns == [*df.columns, "mix_copy", "mix_order"]


def test_one_md5_for_a_draw(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"cast({mixing.SEED} as string)") <= 1 and plan.count("conv(") == 1
