"""Documents packed into segments, and exchanges of packed arrays through a tree of bounded fan.

A segment is some MB of whole documents. Its text lies compressed in a file of the shared folder
and is read there by the tasks that need it; the table has one small row for each segment, so that
no exchange carries a text.

Per-token or per-position facts travel as packed arrays, one row for each receiver. Receivers are
ranges of a hash whose number follows the input; a sender that wrote to all of them would make rows
that grow with the square of the input. So facts climb a tree: a segment writes to FAN nodes at
most, whatever the size of the input; a node takes the facts of about FAN segments for its part of
the hash, merges what is equal, and writes to at most FAN nodes of the next level, until a node's
part of the hash is small enough to hold the facts of all segments. Rows are FAN a segment and level
at most, in proportion to the input, and a node holds about as much as a segment. Answers go back
the same way. One level serves 2 GB of text, two 500 GB, three 130 TB.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, find, id_text, materialize, mix, new_path, slices, small_batches, spark_schema

SEGMENT_BYTES = 4_000_000
#: bytes of input text to each node of the last level
BUCKET_BYTES = 8_000_000
#: rows that a segment, or a node, writes in an exchange
FAN = 256
#: segments to a task that reads texts
SEGMENTS_A_TASK = 16

SEGMENTS = pa.schema([("seg", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("size", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("length", pa.int64())])


def pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if dtype is None else np.frombuffer(raw, dtype=dtype)


def pack_ints(a: np.ndarray) -> bytes:
    """64-bit values as differences, in byte planes: small differences leave planes of zeros."""
    step = np.diff(a, prepend=a.dtype.type(0)) if len(a) else a
    return pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T))


def unpack_ints(b: bytes, dtype=np.int64) -> np.ndarray:
    step = np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(dtype).ravel()
    return np.cumsum(step, dtype=dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack_ints(a.astype(np.uint64))


def unpack_sorted(b: bytes) -> np.ndarray:
    return unpack_ints(b, np.uint64)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# ------------------------------------------------------------------ segments


@dataclass(frozen=True)
class Segments:
    table: DataFrame
    folder: str
    count: int
    size: int

    @property
    def tasks(self) -> int:
        """Tasks that read texts: rows are small, so Spark would choose too few."""
        return max(1, min(self.count, max(int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.count // SEGMENTS_A_TASK))))

    def map(self, schema: pa.Schema, fn: Callable[[dict], list[list]]) -> DataFrame:
        return map_rows(self.table.repartition(self.tasks), schema, fn)

    def map_with(self, facts: DataFrame, schema: pa.Schema, fn: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """fn of a segment's row and of the rows of facts with its seg."""
        mine, theirs = (x.repartition(self.tasks, "seg").groupBy("seg") for x in (self.table, facts))
        return mine.cogroup(theirs).applyInArrow(fn, spark_schema(schema))

    def loader(self) -> Callable[[dict], tuple[list[bytes], np.ndarray]]:
        """A function that tasks call with a segment's row for its texts and their lengths."""
        folder = self.folder

        def load(row: dict) -> tuple[list[bytes], np.ndarray]:
            files, path = filesystem(folder)
            with files.open_input_file(f"{path}/{row['name']}") as f:
                text = unpack(f.read_at(row["length"], row["at"]))
            lens = unpack(row["lens"], np.int64)
            return [text[e - n : e] for e, n in zip(np.cumsum(lens).tolist(), lens.tolist(), strict=True)], lens

        return load


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Segments:
    """Write the segments; a null text is an empty one, a text over SEGMENT_BYTES a segment of its own."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        first, name, at = task.partitionId() << 24, str(task.taskAttemptId()), 0  # a file of this attempt only: those of failed ones are never asked for
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            for k, (ids, texts) in enumerate(slices(batches, SEGMENT_BYTES)):
                blob = b"".join(t or b"" for t in texts)
                packed = pack(blob)
                out.write(packed)
                row = [first + k, ids, pack(np.array([len(t or b"") for t in texts], dtype=np.int64)), len(blob), name, at, len(packed)]
                at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENTS, strict=True)], schema=SEGMENTS)

    table = materialize(id_text(docs, id_col, text_col).mapInArrow(run, spark_schema(SEGMENTS)), "segments")
    count, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return Segments(table, folder, count, size)


# ------------------------------------------------------------------ tables of large rows


def each_row(schema: pa.Schema, fn: Callable[[dict], list[list]]) -> Callable:
    """mapInArrow body for tables of large rows: fn gives a row's result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if out := fn(row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def map_rows(table: DataFrame, schema: pa.Schema, fn: Callable[[dict], list[list]]) -> DataFrame:
    small_batches(table.sparkSession)
    return table.mapInArrow(each_row(schema, fn), spark_schema(schema))


def as_table(rows: list[list], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def first_row(table: pa.Table) -> dict:
    return {n: table[n][0].as_py() for n in table.column_names}


# ------------------------------------------------------------------ the tree

#: node: the digits of the hash so far; group: which senders' facts it holds; child: the sender, a seg or a group of the level before
COUNTED = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("group", pa.int64()), ("child", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
#: asked: for each child, the indexes among keys of those that it sent, in its order
SUMMED = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("group", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("children", pa.list_(pa.int64())), ("asked", pa.list_(pa.binary()))])
#: to the node and group of a child, or at last to a seg (node 0): a value for each key that it sent to this digit
ANSWERS = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("group", pa.int64()), ("digit", pa.int64()), ("values", pa.binary())])
NODE = ["kind", "node", "group"]


class Tree:
    def __init__(self, size: int, count: int):
        """For so many bytes of text in so many segments."""
        self.fans, buckets = [FAN], -(-size // BUCKET_BYTES)
        while (have := math.prod(self.fans)) < buckets:
            self.fans.append(min(FAN, -(-buckets // have)))
        self.groups = [-(-count // FAN**k) for k in range(1, len(self.fans))] + [1]

    @property
    def levels(self) -> int:
        return len(self.fans)

    def deal(self, hashes: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray]]:
        """(digit at the level, from 0; indexes of its hashes in order)."""
        fan = self.fans[level]
        digit = ((hashes // np.uint64(math.prod(self.fans[:level]))) % np.uint64(fan)).astype(np.int64)
        order = np.argsort(digit, kind="stable")
        cut = np.searchsorted(digit[order], np.arange(fan + 1))
        for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield k, order[cut[k] : cut[k + 1]]

    def group_of(self, child: int, level: int) -> int:
        """The group that takes a child's facts at a level, from 0."""
        return child % self.groups[level] if level else int(mix(np.array([child], dtype=np.uint64))[0] % np.uint64(self.groups[0]))

    def down(self, row: dict, values: np.ndarray, encode: Callable, size: np.ndarray | None = None) -> list[list]:
        """Rows of ANSWERS to the children of a node. values: those of its keys, size of them for each key, else one."""
        fan = self.fans[self.level_of(row) - 1]
        out = []
        begin = None if size is None else np.cumsum(size) - size
        for child, asked in zip(row["children"], row["asked"], strict=True):
            at = unpack(asked, np.int32)
            out.append([row["kind"], row["node"] // fan, child, row["node"] % fan, encode(values[at if size is None else spread(begin[at], size[at])])])
        return out

    def level_of(self, row: dict) -> int:
        return row["level"] if "level" in row else self.levels


def sum_counts(table: pa.Table) -> pa.Table:
    """A node of COUNTED rows: total counts of its distinct keys, and which of them each child sent."""
    asked = [unpack_sorted(x.as_py()) for x in table["keys"]]
    every = np.concatenate(asked)
    keys = np.unique(every)
    at = find(keys, every)
    counts = np.bincount(at, weights=np.concatenate([unpack_ints(x.as_py()) for x in table["counts"]]), minlength=len(keys)).astype(np.int64)
    cut = np.cumsum([len(a) for a in asked])[:-1]
    head = [table[n][0].as_py() for n in NODE]
    return as_table([[*head, int(counts.sum()), int((counts > 0).sum()), pack_sorted(keys), pack_ints(counts), table["child"].to_pylist(), [pack(x.astype(np.int32)) for x in np.split(at, cut)]]], SUMMED)


def climb(sent: DataFrame, tree: Tree, merge: Callable, held: pa.Schema, again: Callable[[dict, int], list[list]], label: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of all levels but the last, written; and the rows sent to the last level. again: a node's rows to the given level."""
    schema, nodes = sent.schema, []
    for level in range(1, tree.levels):
        nodes.append(materialize(sent.groupBy(*NODE).applyInArrow(merge, spark_schema(held)), label))
        sent = nodes[-1].mapInArrow(each_row(_arrow(schema), lambda row, level=level: again(row, level)), schema)
    return nodes, sent


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def counts_again(tree: Tree, hash_of: Callable[[int, np.ndarray], np.ndarray]) -> Callable[[dict, int], list[list]]:
    """Sends a node of SUMMED on as COUNTED."""

    def again(row: dict, level: int) -> list[list]:
        keys, counts = unpack_sorted(row["keys"]), unpack_ints(row["counts"])
        head = [tree.group_of(row["group"], level), row["group"]]
        return [[row["kind"], row["node"] * tree.fans[level] + d, *head, pack_sorted(keys[at]), pack_ints(counts[at])] for d, at in tree.deal(hash_of(row["kind"], keys), level)]

    return again


def descend(nodes: list[DataFrame], answers: DataFrame, tree: Tree, hashes: Callable[[dict], np.ndarray], codec: Callable[[int], tuple], size: Callable[[dict], np.ndarray | None] = lambda row: None) -> DataFrame:
    """Answers of the last level's nodes, passed on through the nodes before them to the segments (seg, kind, digit, values).

    hashes, size: of the keys of a node's row; codec: of a kind, the type of a value, its encoder and its decoder.
    """

    def pass_on(level: int):
        def fn(left: pa.Table, right: pa.Table) -> pa.Table:
            row = first_row(left) | {"level": level}
            dtype, encode, decode = codec(row["kind"])
            n, h = size(row), hashes(row)
            values = np.zeros(len(h) if n is None else int(n.sum()), dtype=dtype)
            begin = None if n is None else np.cumsum(n) - n
            told = dict(zip(right["digit"].to_pylist(), right["values"].to_pylist(), strict=True))
            for d, at in tree.deal(h, level):
                if d in told:
                    values[at if n is None else spread(begin[at], n[at])] = decode(told[d])
            return as_table(tree.down(row, values, encode, n), ANSWERS)

        return fn

    for level in range(len(nodes), 0, -1):
        answers = nodes[level - 1].groupBy(*NODE).cogroup(answers.groupBy(*NODE)).applyInArrow(pass_on(level), spark_schema(ANSWERS))
    return answers.select(F.col("group").alias("seg"), "kind", "digit", "values")
