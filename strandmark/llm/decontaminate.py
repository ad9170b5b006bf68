"""Operator 2, benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each segment of a few MB of text keeps its sorted
distinct terms (62-bit hashes), and for each term the delta-coded list of its positions.
Segments are one table of binary columns in the shared folder. The benchmark is a stated query
set, packed into blocks of windows. Each block's terms are first counted in the whole index, and
its windows filed under their rarest term there (the anchor). A search then takes each block to
each segment: of a block it touches only the windows whose anchor the segment holds, of those it
drops the ones with an absent term, and the rest start from the positions of their rarest term in
the segment, less its offset, and intersect them with the offset-adjusted lists of the other terms,
the rarer first. So the work in a segment follows its own terms and true candidates, not the size
of the benchmark. Blocks are of bounded size; tasks read them from the shared folder and keep as
many as CACHE_BYTES allow.

Defined cases: null texts have no words; null item ids are left out; an item without words
matches nothing; equal items count by their id, equal ids count once; windows whose terms are equally
rare are filed under the first of them; document rows repeat as they are; an empty table of documents
gives no rows, an empty benchmark no hits; texts of any length are indexed whole, one over some MB in a
segment of its own; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, counts_in, find, id_text, joined, materialize, path_of, read_blocks, runs, slices, small_batches, spark_schema
from .segments import as_table, first_row, pack, pack_ints, spread, unpack, unpack_ints

#: words in a window
WINDOW = 10
SEGMENT_BYTES = 2_000_000
#: bytes of benchmark text in a block of queries
BLOCK_BYTES = 2_000_000
#: bytes of decoded blocks that a task keeps
CACHE_BYTES = 256_000_000
#: candidate positions that are intersected at once
CHUNK = 2_000_000
WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("first", pa.binary()), ("terms", pa.binary()), ("sizes", pa.binary()), ("positions", pa.binary())])
#: for each window its item, its number of words and their hashes
BLOCKS = pa.schema([("block", pa.int64()), ("items", pa.list_(pa.string())), ("item", pa.binary()), ("length", pa.binary()), ("words", pa.binary())])
#: the same in the order of their anchors; first: where the windows of each distinct anchor begin
FILED = pa.schema([*BLOCKS, pa.field("anchors", pa.binary()), pa.field("first", pa.binary())])
#: occurrences in a part of the index of each distinct term of a block
COUNTS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])
#: parts whose counts are summed first, so that no task sums those of all tasks
PARTS = 1024
HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.list_(pa.int64())))])


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    buf, t0, t1 = joined(texts)
    buf = LOWER[buf]
    start, end = runs(WORD[buf])
    return Rolling(buf).spans(start, end), counts_in(t0, t1, start)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings table, one row for each segment, written to the shared folder."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SEGMENT_BYTES):
            words, n = words_of(texts)
            order = np.argsort(words, kind="stable")
            sorted_words = words[order]
            head = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1]))) if len(words) else np.empty(0, dtype=np.int64)
            step = np.diff(order, prepend=0)
            step[head] = order[head]
            row = [ids, pack(np.concatenate(([0], np.cumsum(n)))), pack(sorted_words[head]), pack(np.diff(np.concatenate((head, [len(words)]))).astype(np.int32)), pack(step.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, INDEX, strict=True)], schema=INDEX)

    return materialize(id_text(docs, id_col, text_col).mapInArrow(run, spark_schema(INDEX)), "postings")


def build_queries(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Blocks of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for k, (ids, texts) in enumerate(slices(batches, BLOCK_BYTES)):
            words, n = words_of(texts)
            first = np.concatenate(([0], np.cumsum(n)))
            item, length, rows = [], [], []
            for i in range(len(ids)):
                own = words[first[i] : first[i + 1]]
                if len(own) and ids[i] is not None:
                    w = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                    rows.append(np.pad(w, ((0, 0), (0, window - w.shape[1]))))
                    item += [i] * len(w)
                    length += [w.shape[1]] * len(w)
            packed = np.concatenate(rows) if rows else np.empty((0, window), dtype=np.uint64)
            row = [number + k, ids, pack(np.array(item, dtype=np.int32)), pack(np.array(length, dtype=np.int32)), pack(packed)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

    rows = benchmark.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, spark_schema(BLOCKS)), "windows")


class Block:
    """Decoded windows of a row of BLOCKS, and their anchors if it is one of FILED."""

    def __init__(self, row: dict):
        self.items = row["items"]
        self.item, self.length = unpack(row["item"], np.int32), unpack(row["length"], np.int32).astype(np.int64)
        self.words = unpack(row["words"], np.uint64).reshape(len(self.length), -1) if len(self.length) else np.empty((0, 1), dtype=np.uint64)
        self.real = np.arange(self.words.shape[1]) < self.length[:, None]
        self.anchors, self.first = (unpack(row[c], t) if c in row else None for c, t in (("anchors", np.uint64), ("first", np.int64)))

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.words[self.real])

    def filed_under(self, terms: np.ndarray) -> np.ndarray:
        """Windows whose anchor is among the sorted terms, in time that follows the shorter of both lists."""
        few, many = (terms, self.anchors) if len(terms) < len(self.anchors) else (self.anchors, terms)
        if not len(few):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        met = many[at] == few
        k = at[met] if many is self.anchors else np.flatnonzero(met)
        return spread(self.first[k], self.first[k + 1] - self.first[k])


class Blocks:
    """The blocks of a written table, read again and again; the first ones, as many as CACHE_BYTES allow, are kept."""

    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema, self.held, self.more, self.bytes = path, schema, [], True, 0

    def __iter__(self) -> Iterator[Block]:
        yield from self.held
        if not self.more:
            return
        seen, have = 0, len(self.held)
        self.more = False
        for batch in read_blocks(self.path, self.schema.names):
            for row in batch.to_pylist():
                seen += 1
                if seen <= have:
                    continue
                block = Block(row)
                self.bytes += block.words.nbytes + block.real.nbytes
                if self.bytes <= CACHE_BYTES:
                    self.held.append(block)
                else:
                    self.more = True
                yield block


def file_windows(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The blocks with their windows filed under the term that is rarest in the whole index."""
    blocks = path_of(queries)
    small_batches(index.sparkSession)

    def merge(terms: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *terms]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([np.empty(0), *sizes]), minlength=len(keys)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sizes, held = [], [], 0
        for b in batches:
            for t, n in zip(b.column("terms").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                terms.append(unpack(t, np.uint64))
                sizes.append(unpack(n, np.int32))
                held += len(terms[-1])
                if held > 4_000_000:
                    t, n = merge(terms, sizes)
                    terms, sizes, held = [t], [n], 0
        if not terms:
            return
        keys, n = merge(terms, sizes)
        part = TaskContext.get().partitionId() % PARTS
        for batch in read_blocks(blocks, BLOCKS.names):
            for row in batch.to_pylist():
                at = find(keys, Block(row).vocabulary())
                found = np.where(at >= 0, n[at] if len(n) else 0, 0)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((row["block"], part, pack_ints(found)), COUNTS, strict=True)], schema=COUNTS)

    def total(table: pa.Table) -> np.ndarray | int:
        return sum(unpack_ints(x.as_py()) for x in table["counts"])

    def add(table: pa.Table) -> pa.Table:
        return as_table([[table["block"][0].as_py(), table["part"][0].as_py(), pack_ints(total(table))]], COUNTS)

    def file(left: pa.Table, right: pa.Table) -> pa.Table:
        row = first_row(left)
        q = Block(row)
        vocabulary = q.vocabulary()
        often = total(right) if right.num_rows else np.zeros(len(vocabulary), dtype=np.int64)
        if not len(q.length):
            return as_table([[*row.values(), pack(vocabulary), pack(np.zeros(1, dtype=np.int64))]], FILED)
        at = np.minimum(np.searchsorted(vocabulary, q.words), len(vocabulary) - 1)
        rare = np.where(q.real, often[at], np.iinfo(np.int64).max).argmin(axis=1)
        anchor = q.words[np.arange(len(rare)), rare]
        order = np.argsort(anchor, kind="stable")
        anchors, first = np.unique(anchor[order], return_index=True)
        return as_table([[row["block"], row["items"], pack(q.item[order]), pack(q.length[order].astype(np.int32)), pack(q.words[order]), pack(anchors), pack(np.append(first, len(order)).astype(np.int64))]], FILED)

    counts = index.select("terms", "sizes").mapInArrow(count, spark_schema(COUNTS)).groupBy("block", "part").applyInArrow(add, spark_schema(COUNTS))
    return materialize(queries.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(file, spark_schema(FILED)), "filed-windows")


class Segment:
    """Postings of one segment: the list of term t is positions[start[t]:start[t + 1]], ascending. Lists are decoded when one is asked for."""

    def __init__(self, row: dict):
        self.ids, self.packed = row["doc_ids"], row["positions"]
        self.first = unpack(row["first"], np.int64)
        self.terms = unpack(row["terms"], np.uint64)
        self.sizes = unpack(row["sizes"], np.int32)
        self.start = np.concatenate(([0], np.cumsum(self.sizes)))

    @functools.cached_property
    def positions(self) -> np.ndarray:
        step = unpack(self.packed, np.int32).astype(np.int64)
        total = np.cumsum(step)
        before = total[self.start[:-1]] - step[self.start[:-1]] if len(self.sizes) else np.empty(0, dtype=np.int64)
        return total - np.repeat(before, self.sizes)

    @functools.cached_property
    def keys(self) -> np.ndarray:
        """One ascending key over all lists, so that many lists are searched in one call."""
        return (np.repeat(np.arange(len(self.sizes), dtype=np.int64), self.sizes) << 32) | self.positions

    def starts(self, term: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For rows of rarest terms: (row, position) of their postings, some at a time."""
        total = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
            row = np.repeat(np.arange(at, end), size[at:end])
            yield row, self.positions[self.start[term[row]] + np.arange(len(row)) - (total[row] - total[at])]
            at = end

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (position >= 0)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def lists(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms all occur here: their indexes, terms, list sizes and term offsets from the rarest on."""
        term = find(self.terms, words.ravel()).reshape(words.shape)
        real = np.arange(words.shape[1]) < length[:, None]
        alive = np.flatnonzero(((term >= 0) | ~real).all(axis=1))
        term, real = term[alive], real[alive]
        size = np.where(real, self.sizes[term] if len(self.sizes) else 0, np.iinfo(np.int32).max)
        return alive, term, size, np.argsort(size, axis=1, kind="stable")

    def phrases(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of all exact occurrences inside one document."""
        alive, term, size, order = self.lists(words, length)
        rare = order[:, 0]
        every = np.arange(len(alive))
        found_w, found_p = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for row, pos in self.starts(term[every, rare], size[every, rare]):
            pos = pos - rare[row]
            for j in range(1, words.shape[1]):
                more = length[alive[row]] > j
                if not more.any():
                    break
                k = order[row, j]
                ok = ~more | self.has(term[row, k], pos + k)
                row, pos = row[ok], pos[ok]
            inside = (pos >= 0) & (self.doc_of(pos) == self.doc_of(pos + length[alive[row]] - 1))
            found_w.append(alive[row[inside]])
            found_p.append(pos[inside])
        return np.concatenate(found_w), np.concatenate(found_p)

    def near(self, words: np.ndarray, length: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of spans of length + slop words of a document that hold all the window's words, each as often as the window does, in any order."""
        alive, term, size, order = self.lists(words, length)
        every = np.arange(len(alive))
        real = np.arange(words.shape[1]) < length[alive][:, None]
        times = ((term[:, :, None] == term[:, None, :]) & real[:, None, :]).sum(axis=2)  # how often a window has each of its words
        found = set()
        for row, pos in self.starts(term[every, order[:, 0]], size[every, order[:, 0]]):
            doc = self.doc_of(pos)
            for back in range(int(length.max(initial=0)) + slop):
                span = length[alive[row]] + slop
                p = np.maximum(pos - back, self.first[doc])
                stop = np.minimum(p + span, self.first[doc + 1])
                ok = back < span
                for j in range(words.shape[1]):
                    k = order[row, j]
                    t = np.maximum(term[row, k], 0)
                    last = np.searchsorted(self.keys, (t << 32) | p) + times[row, k] - 1
                    hit = (last < len(self.keys)) & (self.keys[np.minimum(last, len(self.keys) - 1)] < ((t << 32) | stop))
                    ok &= hit | (length[alive[row]] <= j)
                found.update(zip(alive[row[ok]].tolist(), p[ok].tolist(), strict=True))
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def search(index: DataFrame, queries: DataFrame, slop: int | None = None) -> DataFrame:
    """One row for each document: words, words inside matches, matching items, match spans (word positions, end exclusive).

    Matches are exact phrases, or with slop also spans of at most that many more words that hold all of a window's words, repeated ones as often.
    """
    filed = path_of(file_windows(index, queries))
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(filed, FILED)
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                total = int(seg.first[-1])
                edge = np.zeros(total + 1, dtype=np.int64)
                matched: dict[int, set] = {}
                for block in blocks:
                    near = block.filed_under(seg.terms)
                    if not len(near):
                        continue
                    words, length, item = block.words[near], block.length[near], block.item[near]
                    for w, p, more in [(*seg.phrases(words, length), 0)] + ([] if slop is None else [(*seg.near(words, length, slop), slop)]):
                        np.add.at(edge, p, 1)
                        doc = seg.doc_of(p)
                        np.add.at(edge, np.minimum(p + length[w] + more, seg.first[doc + 1]), -1)
                        for d, i in set(zip(doc.tolist(), item[w].tolist(), strict=True)):
                            matched.setdefault(d, set()).add(block.items[i])
                hit = np.cumsum(edge[:-1]) > 0
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[seg.first])
                starts, ends = runs(hit)
                spans: dict[int, list] = {}
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    while s < e:  # a run of hits may go on into the next document
                        d = int(seg.doc_of(np.array([s]))[0])
                        stop = min(e, int(seg.first[d + 1]))
                        spans.setdefault(d, []).append([s - int(seg.first[d]), stop - int(seg.first[d])])
                        s = stop
                items = [sorted(matched.get(d, ())) for d in range(len(seg.ids))]
                cols = [seg.ids, np.diff(seg.first), n_hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], n_hit > 0, items, [spans.get(d, []) for d in range(len(seg.ids))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HITS, strict=True)], schema=HITS)

    return index.mapInArrow(run, spark_schema(HITS))


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int | None = None) -> DataFrame:
    return search(build_index(docs), build_queries(benchmark), slop)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.p = x.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
