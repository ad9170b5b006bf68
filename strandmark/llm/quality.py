"""Operator 1, quality rules by repetition coverage.

Rolling hashes of word n-grams (one multiply-add per length) mark n-grams and lines
that repeat within a document; the verdict looks at the share of the document's word
characters inside repeats. Everything is computed on whole texts, in slices of a few MB.

Lines that seem to repeat are compared by their bytes. Words of n-grams are compared by 62-bit hashes.

Defined cases: a null or empty text has zero of everything and fails the base rule;
a null doc_id is kept as null; repeated rows give one row each; ties cannot occur
(the most frequent n-gram is measured by the largest covered length); an empty table gives
no rows; a text of any length is measured whole, one over some MB in a slice of its own; other
columns are not read by quality_report, and pass through quality_filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, WS, by_slice, counts_in, id_text, joined, mix, runs, small_batches, spark_schema

#: largest share of word characters in the most frequent n-gram, by n (published corpus-cleaning rules)
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: largest share of word characters in n-grams seen before in the text, by n
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: largest share of characters in lines seen before
DUP_LINE_CHARS = 0.20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STEP = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_frac", pa.float64()), ("dup_line_char_frac", pa.float64())]
    + [(f"top_{n}gram_frac", pa.float64()) for n in TOP]
    + [(f"dup_{n}gram_frac", pa.float64()) for n in DUPLICATED]
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return np.flatnonzero(twice[at] == keys)


def not_first(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the indexes `among`, those whose key stands at a smaller index too."""
    _, first = np.unique(keys[among], return_index=True)
    later = np.ones(len(among), dtype=bool)
    later[first] = False
    return among[later]


def equal_before(buf: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the lines `among`, those with the same bytes as an earlier one of their document."""
    seen, out = set(), []
    for k, d, a, b in zip(among.tolist(), doc[among].tolist(), begins[among].tolist(), ends[among].tolist(), strict=True):
        line = (d, buf[a:b].tobytes())
        if line in seen:
            out.append(k)
        seen.add(line)
    return np.array(out, dtype=np.int64)


def measure(ids: list, texts: list) -> dict:
    buf, t0, t1 = joined(texts)
    m = len(ids)
    start, end = runs(~WS[buf])
    n_words = counts_in(t0, t1, start)
    doc = np.repeat(np.arange(m), n_words)
    chars_before = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    wchars = chars_before[end] - chars_before[start]
    by_doc = lambda w, d: np.bincount(d, weights=w, minlength=m)
    word_chars = by_doc(wchars, doc)
    out: dict = {"doc_id": ids, "n_words": n_words, "word_chars": word_chars.astype(np.int64)}
    out["n_symbols"] = counts_in(t0, t1, np.flatnonzero(SYMBOLS[buf]))
    rolling = Rolling(buf)
    share = np.maximum(word_chars, 1)

    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    has_word = counts_in(begins, ends, start) > 0
    begins, ends = begins[has_word], ends[has_word]
    line_doc = np.searchsorted(t1, begins)
    keys = mix(rolling.spans(begins, ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(7)))
    later = equal_before(buf, line_doc, begins, ends, repeated(keys))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=m)
    lchars = chars_before[ends] - chars_before[begins]
    out["dup_line_frac"] = out["n_dup_lines"] / np.maximum(np.bincount(line_doc, minlength=m), 1)
    out["dup_line_char_frac"] = by_doc(lchars[later], line_doc[later]) / np.maximum(by_doc(lchars, line_doc), 1)

    words = rolling.spans(start, end)
    salt = mix(doc.astype(np.uint64) + np.uint64(0x51ED))
    wpos = np.concatenate(([0], np.cumsum(wchars)))
    gram = words
    for n in range(2, 11):
        gram = gram[: max(len(gram) - 1, 0)] * STEP + words[n - 1 :]
        inside = np.flatnonzero(doc[: len(gram)] == doc[n - 1 :]) if len(gram) else np.empty(0, dtype=np.int64)
        keys = mix(gram[inside] ^ salt[inside])
        again = repeated(keys)
        at = inside[again]
        if n == 3:
            out["n_repeat_words"] = np.bincount(doc[covered(at, n, len(words))], minlength=m)
        if n in TOP:
            best = np.zeros(m)
            if len(at):
                _, first, count = np.unique(keys[again], return_index=True, return_counts=True)
                p = at[first]
                np.maximum.at(best, doc[p], count * (wpos[p + n] - wpos[p]))
            out[f"top_{n}gram_frac"] = best / share
        if n in DUPLICATED:
            words_in = covered(inside[not_first(keys, again)], n, len(words))
            out[f"dup_{n}gram_frac"] = by_doc(wchars[words_in], doc[words_in]) / share

    failed = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    over = out["dup_line_char_frac"] > DUP_LINE_CHARS
    for n, most in TOP.items():
        over |= out[f"top_{n}gram_frac"] > most
    for n, most in DUPLICATED.items():
        over |= out[f"dup_{n}gram_frac"] > most
    return out | {"base_failed": failed, "kept": ~failed & ~over}


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Word indexes inside the n-grams that start at the given words."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and verdicts for each document row."""
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(by_slice(SCHEMA, measure), spark_schema(SCHEMA))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose verdict is to keep them (rows with a null id are never kept)."""
    good = quality_report(docs, id_col, text_col).where("kept").select("doc_id").distinct()
    return docs.join(good, docs[id_col] == good["doc_id"], "left_semi")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_N = sorted({3, *TOP, *DUPLICATED})
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, length(unnest(w)) AS c FROM d),
size AS (SELECT d.r, len(w) AS n_words, CAST(coalesce(sum(c), 0) AS BIGINT) AS word_chars FROM d LEFT JOIN words USING (r) GROUP BY d.r, len(w)),
lines AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup FROM (SELECT r, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT r, string_split(text, chr(10)) AS l FROM d)) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_line AS (SELECT r, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup, sum(length(line)) AS c, coalesce(sum(length(line)) FILTER (dup), 0) AS dup_c FROM lines GROUP BY r),
grams AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT unnest({_N}) AS n) WHERE len(w) >= n)),
often AS (SELECT *, count(*) OVER (PARTITION BY r, n, g) AS times, row_number() OVER (PARTITION BY r, n, g ORDER BY k) AS turn FROM grams),
again AS (SELECT * FROM often WHERE times > 1),
top AS (SELECT r, n, max(times * (length(g) - n + 1)) AS best FROM again GROUP BY r, n),
inside AS (SELECT DISTINCT r, n, unnest(range(k, k + n)) AS k FROM again WHERE n IN ({", ".join(map(str, DUPLICATED))}) AND turn > 1),
share AS (SELECT r, n, sum(c) AS c FROM inside JOIN words USING (r, k) GROUP BY r, n),
windows AS (SELECT r, count(DISTINCT k) AS n_repeat FROM (SELECT r, unnest(range(k, k + 3)) AS k FROM again WHERE n = 3) GROUP BY r),
wide AS (SELECT s.r, {", ".join([f"coalesce(max(best) FILTER (t.n = {n}), 0) / greatest(word_chars, 1) AS top_{n}gram_frac" for n in TOP])} FROM size s LEFT JOIN top t USING (r) GROUP BY s.r, word_chars),
dups AS (SELECT s.r, {", ".join([f"coalesce(max(h.c) FILTER (h.n = {n}), 0) / greatest(word_chars, 1) AS dup_{n}gram_frac" for n in DUPLICATED])} FROM size s LEFT JOIN share h USING (r) GROUP BY s.r, word_chars),
measured AS (SELECT d.doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
    coalesce(n_dup / n_lines, 0) AS dup_line_frac, coalesce(dup_c / greatest(l.c, 1), 0) AS dup_line_char_frac, wide.* EXCLUDE (r), dups.* EXCLUDE (r)
  FROM d JOIN size USING (r) JOIN wide USING (r) JOIN dups USING (r) LEFT JOIN by_line l USING (r) LEFT JOIN windows USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND dup_line_char_frac <= {DUP_LINE_CHARS} AND {" AND ".join([f"top_{n}gram_frac <= {x}" for n, x in TOP.items()] + [f"dup_{n}gram_frac <= {x}" for n, x in DUPLICATED.items()])} AS kept FROM failed
"""
