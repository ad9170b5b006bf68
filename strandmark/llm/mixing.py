"""Operator 8, mixing sources to target weights by Poisson replication (DataFrame operations only).

A source's mean repetition rate is target share x output size / source size. A document's
uniform number is hashed from seed and id and put through the inverse Poisson distribution
of that mean; the document is exploded by the count and all copies are dealt to
partitions and sorted by a hash of id, copy and text, a global shuffle of one exchange.

Defined cases: a null source is a source of its own; a null or empty text has size 0 and
is drawn at its source's rate; a source of size 0 has rate 1; rows with equal (or null)
ids draw the same count. Rows that agree in id, copy and text tie in the shuffle order and lie next to
each other, if they have an id; those without are dealt to partitions by their place in the input, so that
any number of them is spread. An empty table gives no rows; texts of any length pass whole; columns
mix_copy and mix_order of the input are replaced, all others pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize

#: without given weights, a source's weight is its size to this power
TEMPERATURE = 0.5
SEED = 17
#: a larger mean is the sum of independent draws of at most this mean, so that exp(-mean) never underflows
MEAN = 16.0
#: the distribution is tabulated up to this count; beyond it lies less than 2^-52 of a mean of 16
COUNTS = 80
#: source tables up to this many rows (of about 700 bytes) are broadcast; larger ones are joined by an exchange of the documents
BROADCAST_SOURCES = 10_000


def unit(*parts) -> Column:
    """A number in [0, 1), 52 bits of the MD5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each source: size in characters, mean repetition rate, draws a document takes, the tabulated distribution of one draw."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0))
    total = sizes.select("source", "size", weight.alias("weight")).agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rates = sizes.select("source", "size", weight.alias("weight")).join(F.broadcast(total))  # one row
    rate = F.when(F.col("size") > 0, F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(1.0)
    draws = F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1)).cast("int")
    p0 = F.exp(-F.col("mean"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(COUNTS)),
        F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k).alias("p"),
            (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"),
            F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return rates.withColumn("rate", rate).withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws")).select("source", "size", "rate", "draws", table.alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs' columns with mix_copy (1..n) and mix_order (the key of the shuffle); rows come in shuffled order."""
    docs = docs.drop("mix_copy", "mix_order")
    rate, count, salt = (free(n, docs) for n in ("rate", "count", "salt"))
    # rows without id are numbered once, in a written table: a number that a lost task gave anew would move rows
    numbered = materialize(docs.where(F.col(id_col).isNull()).withColumn(salt, F.monotonically_increasing_id()), "without-id")
    docs = docs.where(F.col(id_col).isNotNull()).withColumn(salt, F.lit(None).cast("long")).unionByName(numbered)
    rates = source_rates(docs, weights, temperature, source_col, text_col)
    rates = materialize(rates.select(F.struct("source", "cdf", "draws").alias(rate)), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    doc_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    numbers = F.transform(F.sequence(F.lit(1), F.col(f"{rate}.draws")), lambda d: unit(seed, d.cast("string"), doc_id))
    copies = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(f"{rate}.cdf"), lambda c: c <= u)))
    drawn = docs.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(f"{rate}.source")))
    drawn = drawn.withColumn(count, copies).drop(rate).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col(count)))).where("mix_copy > 0").drop(count)
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), doc_id, F.col("mix_copy").cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    return drawn.withColumn("mix_order", order).repartition("mix_order", salt).sortWithinPartitions("mix_order", id_col, "mix_copy").drop(salt)


def op8_poisson_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix_copy", "mix_order", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = f"""
WITH sizes AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size, {TEMPERATURE}) AS weight FROM sizes),
total AS (SELECT sum(size) AS all_size, sum(weight) AS all_weight FROM weighted),
rated AS (SELECT source, CASE WHEN size > 0 THEN weight / all_weight * all_size / size ELSE 1.0 END AS rate FROM weighted, total),
means AS (SELECT source, rate, CAST(greatest(ceil(rate / {MEAN}), 1) AS INT) AS draws, rate / CAST(greatest(ceil(rate / {MEAN}), 1) AS INT) AS mean FROM rated),
cdf AS (SELECT source, mean, draws, k, sum(exp(-mean) * exp(CASE WHEN k = 0 THEN 0 ELSE k * ln(mean) - lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c
        FROM means, range(0, {COUNTS + 1}) t(k)),
tables AS (SELECT source, draws, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, draws),
drawn AS (SELECT d.doc_id, d.source, d.text,
            CAST(list_sum(list_transform(range(1, t.draws + 1), lambda j: len(list_filter(t.cdf, lambda c: c <= CAST(concat('0x', substr(md5(concat('{SEED}:', j, ':', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) / {float(1 << 52)}))) ) AS INT) AS n
          FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(j AS INT) AS mix_copy, md5(concat('order{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', j, ':', md5(coalesce(text, '')))) AS mix_order, sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM drawn WHERE n > 0)
"""
