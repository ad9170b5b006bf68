"""Operator 4, language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (n = 1..3, words padded by one
blank), ranked by count. Language profiles are counted over all labelled training rows:
tasks count in numpy, Spark sums and ranks. A document goes to the language with
the least out-of-place distance; an n-gram that a profile lacks costs the profile's length.

Defined cases: a null text or one without letters is `und` with score 0, and so is
every text if nothing was learned; equal counts rank by code points, equal distances go
to the first language in sorted order; rows with a null language teach nothing; a null
doc_id hashes as the empty string. Training texts are whole and never sampled; texts of any length
are counted whole, one over some MB in a slice of its own. Repeated rows teach as often as they
occur and are predicted alike; an empty table teaches nothing and gives no rows; other columns pass
through predict, but for those of the names that it appends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs, small_batches, spark_schema

SIZES = (1, 2, 3)
#: n-grams in a profile
PROFILE = 400
#: profiles are broadcast: languages x PROFILE x 12 bytes; more labels than this are refused
MAX_LANGUAGES = 10_000
SLICE_POINTS = 1_000_000
#: code points to the lower-case letter, 1 for anything else, 0 for not yet looked up
_LETTER = np.zeros(0x110000, dtype=np.int32)


def letters(points: np.ndarray) -> np.ndarray:
    low = _LETTER[points]
    new = np.unique(points[low == 0])
    if len(new):
        for p in new.tolist():
            c = chr(p)
            _LETTER[p] = 1 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else p
        low = _LETTER[points]
    return low


def gram_counts(texts: list[str], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), sorted by owner and n-gram; a text's owner is its index unless given.

    An n-gram is its code points, 21 bits each, left-aligned, blank = 1, so that order is by code points.
    """
    owner = np.arange(len(texts)) if owner is None else owner
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    between = np.zeros(len(points), dtype=np.int64)  # the blanks before, between and after texts
    between[np.concatenate(([0], np.cumsum(lens + 1)))] = 1
    low = letters(points)
    start, end = runs(low == 1)
    keep = low != 1
    keep[start] = True
    seen = np.concatenate(([0], np.cumsum(between)))
    cut = np.zeros(len(points), dtype=bool)
    cut[start] = seen[end] > seen[start]
    text = np.minimum(seen[1:] - 1, max(len(texts) - 1, 0))
    low, cut, text = low[keep], cut[keep], text[keep]
    alphabet, code = np.unique(low, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    code = (code + 1).astype(np.uint64)
    mine = owner[text].astype(np.uint64) << np.uint64(3 * bits) if len(texts) else np.zeros(len(low), dtype=np.uint64)
    keys = []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        gram = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(bits)) | code[j : m + j]
        letter = low[:m] != 1
        if n == 1:
            keys.append((mine[:m] | (gram << np.uint64(2 * bits)))[letter])
        else:
            ok = ~cut[1 : m + 1] if n == 3 else np.ones(m, dtype=bool)
            keys.append((np.where(letter, mine[:m], mine[1 : m + 1]) | (gram << np.uint64(bits * (3 - n))))[ok])
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    count = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    full = np.concatenate(([0], alphabet)).astype(np.uint64)
    grams = np.zeros(len(key), dtype=np.uint64)
    for j in (2, 1, 0):
        grams = (grams << np.uint64(21)) | full[((key >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    return (key >> np.uint64(3 * bits)).astype(np.int64), grams, count


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        texts = b.column(text_col).to_pylist()
        at = size = 0
        for k, t in enumerate(texts):
            n = len(t or "") + 1
            if k > at and (size + n > SLICE_POINTS or k - at >= 4000):
                yield b.slice(at, k - at), texts[at:k]
                at, size = k, 0
            size += n
        if texts:
            yield b.slice(at), texts[at:]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of each language's profile, from whole texts of all rows with both text and language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    small_batches(labelled.sparkSession)

    def count(batches):
        sums: dict = {}

        def rows(lang):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(sums[lang][0]), pa.string()), pa.array(sums[lang][0].astype(np.int64)), pa.array(sums[lang][1])], schema=schema)

        for b, texts in text_slices(batches):
            langs, which = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            who, grams, counts = gram_counts(texts, which)
            for k, lang in enumerate(langs.tolist()):
                gram, n = grams[who == k], counts[who == k]
                if lang in sums:
                    gram, inv = np.unique(np.concatenate((sums[lang][0], gram)), return_inverse=True)
                    n = np.bincount(inv, weights=np.concatenate((sums[lang][1], n))).astype(np.int64)
                sums[lang] = (gram, n)
            while sum(len(g) for g, _ in sums.values()) > 2_000_000:  # partial sums are sent early, nothing is lost
                lang = max(sums, key=lambda x: len(sums[x][0]))
                yield rows(lang)
                del sums[lang]
        for lang in sums:
            yield rows(lang)

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, spark_schema(schema)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("rank")
    return sums.select("lang", "gram", rank).where(F.col("rank") <= profile)


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", profile: int = PROFILE, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the prediction and its score appended, row for row; a column of such a name is replaced."""
    table = profiles.limit(MAX_LANGUAGES * profile + 1).toPandas()  # rank by rank of each language, a bounded table
    langs = sorted(table["lang"].unique())
    if len(table) > MAX_LANGUAGES * profile:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grams = np.unique(table["gram"].to_numpy(dtype=np.int64)).astype(np.uint64)
    ranks = np.full((len(grams), len(langs)), -1, dtype=np.int32)
    ranks[np.searchsorted(grams, table["gram"].to_numpy(dtype=np.int64).astype(np.uint64)), [langs.index(x) for x in table["lang"]] if len(table) else []] = table["rank"].to_numpy(dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((langs, grams, ranks))
    kept = docs.drop(pred_col, score_col)
    small_batches(docs.sparkSession)

    def run(batches):
        langs, grams, ranks = shared.value
        for b, texts in text_slices(batches, text_col):
            who, gram, count = gram_counts([t or "" for t in texts])
            m = len(texts)
            order = np.argsort(who.astype(np.int64) * (1 << 40) + (int(count.max(initial=0)) - count), kind="stable")
            who, gram = who[order], gram[order]
            at = np.searchsorted(who, np.arange(m))
            rank = np.arange(len(who)) - at[who] + 1
            top = rank <= profile
            who, gram, rank = who[top], gram[top], rank[top]
            size = np.bincount(who, minlength=m)
            pred, score = np.full(m, "und", dtype=object), np.zeros(m)
            if len(langs) and len(who):
                k = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known = grams[k] == gram
                far = np.stack([np.bincount(who, weights=np.where(known & (ranks[k, j] > 0), np.minimum(np.abs(ranks[k, j] - rank), profile), profile), minlength=m) for j in range(len(langs))], axis=1)
                some = size > 0
                best = np.argmin(far, axis=1)
                pred[some] = np.array(langs, dtype=object)[best[some]]
                score[some] = 1 - far[some, best[some]] / (size[some] * profile)
            yield b.append_column(pred_col, pa.array(pred.tolist(), pa.string())).append_column(score_col, pa.array(score, pa.float64()))

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def split_by_crc(docs: DataFrame, k: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo k, as a column."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % k


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = split_by_crc(docs, 4) == 2
    profiles = learn(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


#: CRC-32 bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_CRC} % 4 = 2 AS held_out, text IS NOT NULL AS present, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), ' ') || ' ' AS s FROM documents),
parts AS (SELECT r, substr(s, o, {200 + max(SIZES) - 1}) AS s FROM (SELECT r, s, unnest(range(1, length(s) + 1, 200)) AS o FROM d WHERE length(s) > 2)),
grams AS (SELECT r, g, count(*) AS c FROM (SELECT r, n, substr(s, k, n) AS g FROM (SELECT r, s, n, unnest(range(1, least(length(s), 200) + 1)) AS k FROM parts, (SELECT unnest({list(SIZES)}) AS n))) WHERE length(g) = n AND g <> ' ' GROUP BY r, g),
learned AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) AS k FROM grams JOIN d USING (r) WHERE NOT held_out AND present AND lang IS NOT NULL GROUP BY lang, g) WHERE k <= {PROFILE}),
mine AS (SELECT * FROM (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY c DESC, g) AS k FROM grams) WHERE k <= {PROFILE}),
far AS (SELECT r, l.lang, count(*) AS size, sum(least(coalesce(abs(p.k - m.k), {PROFILE}), {PROFILE})) AS far FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN learned p ON p.lang = l.lang AND p.g = m.g GROUP BY r, l.lang),
best AS (SELECT r, lang, 1 - CAST(far AS DOUBLE) / (size * {PROFILE}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY far, lang) AS k FROM far) WHERE k = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM d LEFT JOIN best USING (r)
"""
