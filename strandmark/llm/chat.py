"""Operator 9, chat formatting by cumulative-snapshot collapse (DataFrame operations only).

Loggers save a conversation after every turn. Each turn is hashed with its position and the
hashes are summed along the conversation, so that a rolling hash identifies every prefix.
A conversation whose whole hash is a prefix of a longer one is dropped by an anti-join; of
equal conversations the smallest id stays. Only the survivors' texts are gathered and rendered.

Defined cases: turns are ordered by turn, role and text, nulls first; repeated rows are turns
like others; a null text renders as empty and a null role as an empty name, but both hash
apart from the empty string; rows with a null conv_id belong to no conversation and are left
out. A conversation is one output row, so its turns are gathered, and it must fit in a string;
a text of any length is taken whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: three 40-bit lanes of an MD5 are summed separately, exact for up to 2^23 turns
LANES = (1, 11, 21)


def turn_hash(position: Column, role: Column, text: Column) -> list[Column]:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.md5(F.concat(position.cast("string"), F.lit("|"), part(role), F.lit("|"), part(text)))
    return [F.conv(F.substring(digest, at, 10), 16, 10).cast("long") for at in LANES]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, h): the hash of each conversation's first k of n turns. Rows of fixed width pass the exchange, no text."""
    fixed = turns.select("conv_id", "turn", "role", F.md5(F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-"))).alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "t")
    numbered = fixed.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    lanes = turn_hash(F.col("k"), F.col("role"), F.col("t"))
    hashed = numbered.select("conv_id", "k", "n", *[x.alias(f"l{i}") for i, x in enumerate(lanes)])
    w = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.select("conv_id", "k", "n", *[F.sum(f"l{i}").over(w).alias(f"l{i}") for i in range(len(LANES))])
    return sums.select("conv_id", "k", "n", F.concat_ws("-", *[F.col(f"l{i}").cast("string") for i in range(len(LANES))]).alias("h"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that prefix no longer one, one of each group of equals."""
    prefixes = materialize(prefix_hashes(turns), "prefixes")  # read twice
    longer = prefixes.where("k < n").groupBy("k", "h").agg(F.lit(1).alias("one")).select("k", "h")
    whole = prefixes.where("k = n").groupBy("k", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(longer, ["k", "h"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, chat): turns in order, each between markers."""
    t = F.col("x")
    line = lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "t", "text"))).alias("x")).select("conv_id", F.concat_ws("", F.transform(t, line)).alias("chat"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included), chat."""
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where("conv_id IS NOT NULL")
    kept = maximal(turns)
    mine = turns.withColumn("t", F.md5(F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-")))).join(kept.select("conv_id"), "conv_id", "left_semi")
    return kept.join(render(mine), "conv_id")


def op9_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = """
WITH turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce('+' || text, '-'))) AS k
               FROM conversations WHERE conv_id IS NOT NULL),
digests AS (SELECT conv_id, k, sha256(concat(k, '|', coalesce(concat(length(role), ':', role), '-'), '|', coalesce(concat(length(text), ':', text), '-'))) AS d FROM turns),
prefixes AS (SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY k) AS h FROM digests),
whole AS (SELECT k, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE k = n GROUP BY k, h),
kept AS (SELECT conv_id, k AS n_turns, n_copies FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.k < p.n AND p.k = w.k AND p.h = w.h))
SELECT conv_id, n_turns, n_copies, string_agg(concat('<|im_start|>', coalesce(role, ''), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)), '' ORDER BY k) AS chat
FROM kept JOIN turns USING (conv_id) GROUP BY conv_id, n_turns, n_copies
"""
