"""Shared pieces: the cluster's shared folder, Arrow slicing, byte scanning and rolling hashes.

Every operator projects the id and text columns first, so extra columns, whatever
their names, never reach its internal stages.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paths

#: bytes of text handled at once inside a task; one longer document forms a slice alone
SLICE_BYTES = 2_000_000

#: the ASCII whitespace of the word definition: space and \x09-\x0D
WS = np.zeros(256, dtype=bool)
WS[[0x20, *range(0x09, 0x0E)]] = True


# ------------------------------------------------------------------ folders


#: paths made inside each open scratch()
_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = paths.new_path(spark, label)
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at a successful end, the intermediate tables and files made inside; what is lazily read from them must be written by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
    for path in made:
        paths.delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow filesystem and path of a shared-folder URI (file, hdfs, s3, gs...)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_blocks(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a materialized table, read inside a task file by file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, base = filesystem(path)
    for info in sorted(files.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(columns=columns)


def path_of(df: DataFrame) -> str:
    """Folder of a table made by materialize()."""
    return os.path.dirname(df.inputFiles()[0])


# ------------------------------------------------------------------ rows to slices


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free(name: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


#: bounds of an Arrow batch that goes to Python (documents and packed rows have up to many MB each): one value for all operators, so that a plan's batches do not depend on which ran last
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def small_batches(spark: SparkSession) -> None:
    for k, v in BATCH.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, UTF-8 texts) groups of about limit bytes; a null text stays None."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            n = len(t) if t is not None else 0
            if ids and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n + 1
    if ids:
        yield ids, texts


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def by_slice(schema: pa.Schema, fn: Callable[[list, list], dict], limit: int = SLICE_BYTES) -> Callable:
    """mapInArrow body: fn gives the columns of a slice's result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, limit):
            cols = fn(ids, texts)
            if cols is not None:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    return run


def joined(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte buffer with a newline after each text; starts and ends of the texts in it."""
    blob = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(blob) + b"\n", dtype=np.uint8)
    lens = np.fromiter((len(t) for t in blob), dtype=np.int64, count=len(blob))
    ends = np.cumsum(lens + 1) - 1
    return buf, ends - lens, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the True runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def counts_in(starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many of the sorted points lie in each [start, end)."""
    return np.searchsorted(points, ends) - np.searchsorted(points, starts)


# ------------------------------------------------------------------ hashing

_RNG = np.random.default_rng(20240229)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


PRIME = (1 << 31) - 1


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, a Mersenne prime: its digits to the base 2^31 are added up."""
    p, s = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


class Powers:
    """Powers of a base and of its inverse modulo 2^64, or modulo PRIME, as many as were asked for so far."""

    def __init__(self, base: int, modulus: int = 1 << 64):
        self.modulus, self.bases = modulus, (base, pow(base, -1, modulus))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) <= n:
            more = [t * np.uint64(pow(base, len(t), self.modulus)) for t, base in zip((self.up, self.down), self.bases, strict=True)]
            self.up, self.down = (np.concatenate((t, reduce(x) if self.modulus == PRIME else x)) for t, x in zip((self.up, self.down), more, strict=True))


class Rolling:
    """Hashes of any spans of a buffer, from prefix sums of polynomials modulo 2^31 - 1 in two lanes of different bases: 62 bits.

    Unlike a modulus of 2^64, a prime has no strings (such as Thue-Morse words) that collide whatever the base. Buffers of up to 2^32 bytes.
    """

    def __init__(self, buf: np.ndarray):
        self.sums = []
        for powers, values in _LANES:
            powers.grow(len(buf))
            sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(reduce(values[buf] * powers.up[: len(buf)]), out=sums[1:])
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (reduce(reduce(s[ends] - s[starts]) * p.down[starts]) for s, (p, _) in zip(self.sums, _LANES, strict=True))
        return mix(((a << np.uint64(31)) | b) ^ mix((ends - starts).astype(np.uint64)))


_LANES = [(Powers(int(_RNG.integers(1 << 20, PRIME)), PRIME), _RNG.integers(1, PRIME, 256, dtype=np.uint64)) for _ in range(2)]


class Quick:
    """Rolling modulo 2^64: half the work, for hashes that only propose what bytes then decide."""

    POWERS = Powers(0x9E3779B97F4A7C15)
    BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, buf: np.ndarray):
        self.POWERS.grow(len(buf))
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.BYTES[buf] * self.POWERS.up[: len(buf)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.POWERS.down[starts] + (ends - starts).astype(np.uint64))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in the sorted unique keys of each wanted value, -1 where absent: a direct-address probe, binary search for its collisions."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    if not len(wanted):
        return np.empty(0, dtype=np.int64)
    bits = max(8, int(4 * len(keys)).bit_length())
    shift, odd = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << bits, dtype=np.int32)
    table[(keys * odd) >> shift] = np.arange(len(keys), dtype=np.int32)
    at = table[(wanted * odd) >> shift].astype(np.int64)
    off = np.flatnonzero(keys[at] != wanted)
    if len(off):
        again = np.minimum(np.searchsorted(keys, wanted[off]), len(keys) - 1)
        at[off] = np.where(keys[again] == wanted[off], again, -1)
    return at
