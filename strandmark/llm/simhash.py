"""Operator 7, SimHash near-duplicates with BK-trees.

Fingerprints of 64 bits come from XXH64 of word shingles. The distinct fingerprints are
dealt to shards without loss: if two differ in at most r of 64 bits and the bits are cut
into b blocks, at least b - r blocks are equal, so for each choice of b - r blocks their
value is a shard. More blocks make smaller shards; b grows with the number of fingerprints.
In each shard a BK-tree is built (children keyed by their Hamming distance to the parent)
and searched along the edges within the radius. A shard's tree goes to the one task that
holds the shard, by the exchange: all trees together grow with the data, so they are never
broadcast. Shards over a bound are dealt anew by blocks of their other bits, and what is still over
it is tiled into pairs of chunks; neither loses a pair.
Linked fingerprints leave a shard as a star, and the stars are joined to components by
minimum labels with pointer jumping, each round written to the shared folder.

similar_documents finds similarities that differ in more bits than blocks can be equal in:
fingerprints of 256 bits of the shingle sets, linked below the distance that the similarity implies, are dealt
to tables of sampled bits, as many tables as find a pair of just that similarity, whose
distance is binomial, with probability RECALL (texts of about 4 distinct shingles less, as ties of even counts go to 0:
README), and the same trees are built and searched in their shards. Each
pair of different sets that a search finds is judged there on its shingle sets, in the first table that holds it, unless pairs judged
similar already connect it: only verified pairs unite. The sets lie in files of the shared folder and are read as pairs ask for them.

Defined cases: a null, empty or blank text has fingerprint 0, linked like any other; fewer
words than a shingle make one shingle; repeated rows get one row each; null ids count as
larger than any other and get their component's smallest id, null if it has none; an empty table gives
no rows; texts of any length are fingerprinted whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, filesystem, id_text, materialize, mix, new_path, slices, small_batches, spark_schema

SHINGLE, RADIUS, SEED = 4, 4, 42
#: mean shard size that decides the number of blocks, and the size above which a shard is tiled
SHARD, TILE = 1000, 20_000
#: rows of whole shards that a task handles at once
ROWS = 200_000
#: (query, node) pairs on one level of a search
FRONTIER = 2_000_000
#: the bits of each byte value, one in each byte of a 64-bit word, so that eight counters add at once
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


#: words of a wide fingerprint; mean shard size and recall that decide its tables
WIDE, WIDE_SHARD, RECALL = 4, 32, 0.995
WIDE_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [(f"w{k}", pa.int64()) for k in range(WIDE)] + [("size", pa.int64()), ("loc", pa.int64())])
#: set hashes that a task holds, and asks for at once; pairs judged at once; bits of a set's parity; bits of a place in a file of sets
HELD, ASKED, PAIRS, PARITY, PLACE = 16_000_000, 4_000_000, 20_000, 2048, 36


def shingle_hashes(texts: list, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and their number in each text."""
    digest = xxhash.xxh64_intdigest
    hashes, n = [np.empty(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        words = (t or b"").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        space = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        m = max(len(words) - shingle + 1, 1)
        if m == 1:
            hashes.append(np.array([digest(line, SEED)], dtype=np.uint64))
        else:
            start = np.concatenate(([0], space + 1))[:m].tolist()
            end = np.concatenate((space, [len(line)]))[shingle - 1 :].tolist()
            hashes.append(np.fromiter(map(digest, [line[a:b] for a, b in zip(start, end, strict=True)], repeat(SEED)), dtype=np.uint64, count=m))
        n[k] = m
    return np.concatenate(hashes), n


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have."""
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(hashes):
        return out
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    first = np.concatenate(([0], np.cumsum(n)))
    steps = -(-n // 255)  # a lane counts to 255
    owner = np.repeat(np.arange(len(n)), steps)
    cut = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps))
    part = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).astype(np.int64)
    some = np.flatnonzero(n)
    total = np.add.reduceat(part, (np.cumsum(steps) - steps)[some], axis=0)
    out[some] = np.packbits(2 * total > n[some, None], axis=1).view(np.uint64).ravel()
    return out


def simhash(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes, repeats included."""
    return majority(*shingle_hashes(texts, shingle))


def wide_simhash(texts: list, shingle: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From each text's set of shingles, repeats left out: a hash of the set; a fingerprint of WIDE words, each from another mix of the hashes; and 32 bits of each."""
    hashes, n = shingle_hashes(texts, shingle)
    full = [np.unique(h) for h in np.split(hashes, np.cumsum(n)[:-1])] if len(n) else []
    hashes, n = np.concatenate([np.empty(0, dtype=np.uint64), *full]), np.array([len(h) for h in full], dtype=np.int64)
    wide = np.stack([majority(hashes if k == 0 else mix(hashes + np.uint64(k)), n) for k in range(WIDE)], axis=1)
    fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in full], dtype=np.uint64)
    return fp, wide, [np.unique(h.astype(np.uint32)) for h in full]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(by_slice(FINGERPRINTS, lambda ids, texts: {"doc_id": ids, "fp": simhash(texts, shingle).view(np.int64)}), spark_schema(FINGERPRINTS))


# ------------------------------------------------------------------ BK-trees


class Forest:
    """A BK-tree for each group of fingerprints, all built and searched level by level in numpy."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """fp: one row of 64-bit words each; group: ascending; the first member of a group is its root."""
        self.fp = fp
        self.far = 64 * fp.shape[1] + 1
        n = len(fp)
        self.parent, self.edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        head = np.concatenate(([True], group[1:] != group[:-1])) if n else np.empty(0, dtype=bool)
        self.root = np.flatnonzero(head)[np.cumsum(head) - 1] if n else np.empty(0, dtype=np.int64)
        rest, node = np.flatnonzero(~head), self.root[~head]
        while len(rest):
            slot = node * self.far + self.distance(rest, node)
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            new = np.concatenate(([True], slot[1:] != slot[:-1]))
            child = rest[new]
            self.parent[child], self.edge[child] = slot[new] // self.far, slot[new] % self.far
            node = child[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        inner = np.flatnonzero(self.parent >= 0)
        slot = self.parent[inner] * self.far + self.edge[inner]
        order = np.argsort(slot, kind="stable")
        self.slots, self.children = slot[order], inner[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int64)

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of a group at most radius apart, some at a time, each pair in either order or both."""
        at, batch = 0, 4096
        while at < len(self.fp):
            q = np.arange(at, min(at + batch, len(self.fp)))
            at += len(q)
            node, widest = self.root[q], 0
            while len(q):
                widest = max(widest, len(q))
                far = self.distance(q, node)
                hit = (far <= radius) & (q > node)
                if hit.any():
                    yield q[hit], node[hit]
                lo = np.searchsorted(self.slots, node * self.far + np.maximum(far - radius, 0))
                n = np.searchsorted(self.slots, node * self.far + np.minimum(far + radius, self.far - 1), "right") - lo
                q = np.repeat(q, n)
                node = self.children[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
            batch = int(np.clip(batch * FRONTIER / max(widest, 1), 64, 65536))


def stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], judge=None) -> np.ndarray:
    """The smallest linked index of each of n nodes. judge(a, b) says which of the first pairs it takes are links; connected pairs are not judged."""
    label = np.arange(n)

    def settle(a, b):
        while len(a):
            x, y = label[a], label[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            live = lo != hi
            if not live.any():
                return
            a, b = a[live], b[live]
            np.minimum.at(label, hi[live], lo[live])
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    for a, b in pairs:
        if judge is None:
            settle(a, b)
            continue
        while len(a):
            live = label[a] != label[b]
            a, b = a[live], b[live]
            ok = judge(a, b)
            k = len(ok)
            settle(a[:k][ok], b[:k][ok])
            a, b = a[k:], b[k:]
    return label


class Sets:
    """Shingle sets in files of a shared folder, read as pairs ask for them."""

    def __init__(self, folder: str):
        self.files, self.path = filesystem(folder)
        self.open: dict = {}
        self.held: dict = {}
        self.total = 0

    def get(self, loc: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A set, and the parity of its members in each of PARITY classes."""
        if (loc, size) not in self.held:
            name, at = loc >> PLACE, loc & ((1 << PLACE) - 1)
            if name not in self.open:
                if len(self.open) >= 64:
                    self.open.popitem()[1].close()
                self.open[name] = self.files.open_input_file(f"{self.path}/{name}")
            hashes = np.frombuffer(self.open[name].read_at(4 * size, 4 * at), dtype=np.uint32)
            odd = (np.bincount(hashes & np.uint32(PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)
            self.held[loc, size] = hashes, np.packbits(odd).view(np.uint64)
            self.total += size + PARITY // 32
        return self.held[loc, size]

    def alike(self, a: np.ndarray, b: np.ndarray, loc: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
        """Whether pairs have that Jaccard similarity, for the first pairs whose sets fit in memory.

        Sets differ in at least as many members as their parities differ in bits: pairs too far apart by that bound need no intersection.
        """
        k = min(max(int(np.searchsorted(np.cumsum(size[a] + size[b]), ASKED)), 1), PAIRS, len(a))
        a, b = a[:k], b[:k]
        if self.total > HELD:
            self.held, self.total = {}, 0
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        if not len(nodes):
            return np.zeros(0, dtype=bool)
        sets = [self.get(x, n) for x, n in zip(loc[nodes].tolist(), size[nodes].tolist(), strict=True)]
        parity = np.stack([p for _, p in sets])
        differ, total = np.bitwise_count(parity[at[:k]] ^ parity[at[k:]]).sum(axis=1, dtype=np.int64), size[a] + size[b]
        ok = total - differ >= similarity * (total + differ) - 1e-6
        for i in np.flatnonzero(ok):
            both = len(np.intersect1d(sets[at[i]][0], sets[at[k + i]][0], assume_unique=True))
            ok[i] = both >= similarity * (total[i] - both)
        return ok


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shard_links(radius: int, words: list[str], similar: tuple | None):
    """mapInArrow body over rows sorted by shard: links that connect what is connected in a shard, at most one for each fingerprint.

    similar: a similarity, the folder of the sets and the masks of the tables. Pairs within the radius are then links if
    their sets are similar; the smaller must have that share of the larger one's size at least, and no earlier table may hold both.
    """
    extra = ["size", "loc"] if similar else []

    def found(tree, size, which):
        similarity, _, masks = similar
        for a, b in tree.within(radius):
            ok = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = a[ok], b[ok]
            for t in range(int(which[a].max(initial=0))):
                new = (which[a] <= t) | ((tree.fp[a] ^ tree.fp[b]) & masks[t]).any(axis=1)
                a, b = a[new], b[new]
            order = np.argsort(tree.distance(a, b), kind="stable")
            yield a[order], b[order]

    def links(sets, key, tile, which, fp, *bits):
        if similar:
            *bits, size, loc = bits
        change = (key[1:] != key[:-1]) | (which[1:] != which[:-1]) | (tile[1:] != tile[:-1])
        group = np.concatenate(([0], np.cumsum(change)))
        tree = Forest(np.stack(bits, axis=1).view(np.uint64), group)
        if similar:
            label = stars(len(fp), found(tree, size, which), lambda a, b: sets.alike(a, b, loc, size, similar[0]))
        else:
            label = stars(len(fp), tree.within(radius))
        a = np.flatnonzero(label != np.arange(len(fp)))
        a, b = fp[a], fp[label[a]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        sets = Sets(similar[1]) if similar else None
        for b in batches:
            held.append([b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tile", "which", "fp", *words, *extra)])
            size += b.num_rows
            if size < ROWS:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(sets, *[c[:cut] for c in cols])
            held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if size:
            yield links(sets, *[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks whose values are the shards, for n distinct fingerprints: the fewest blocks with a mean shard of at most SHARD."""
    for blocks in range(radius + 1, radius + 5):
        same = blocks - radius
        if n <= SHARD * 2 ** (64 * same / blocks):
            break
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, same)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect what is connected by distances of at most radius. distinct: one fp a row, materialized."""
    masks = shard_masks(distinct.count(), radius)
    tables = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("s")).select("fp", "s.which", "s.key")
    large = materialize(rows.groupBy("which", "key").count().where(F.col("count") > TILE).select("which", "key"), "hot-shards")
    if not large.isEmpty():
        # two of a shard differ in radius bits of the others at most: of radius + 1 blocks of those, one is equal
        finer = [F.array(*[F.struct(F.lit(len(masks) + i * (radius + 1) + j).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m | block))).alias("key")) for j, block in enumerate(other_blocks(m, radius + 1))]) for i, m in enumerate(masks)]
        hot = rows.join(large, ["which", "key"], "left_semi").select("fp", F.explode(F.element_at(F.array(*finer), F.col("which") + 1)).alias("s")).select("fp", "s.which", "s.key")
        rows = rows.join(large, ["which", "key"], "left_anti").select("fp", "which", "key").union(hot)
    return _search(rows, radius, ["fp"])


def other_blocks(mask: int, blocks: int) -> list[int]:
    """The bits outside the mask, cut into blocks."""
    bits = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(blocks)]


def _search(rows: DataFrame, radius: int, words: list[str], similar: tuple | None = None) -> DataFrame:
    """Links inside the shards (which, key) of rows. A shard over TILE becomes the pairs of its chunks."""
    large = materialize(rows.groupBy("which", "key").count().where(F.col("count") > TILE).select("which", "key", F.ceil(F.col("count") / (TILE / 2)).cast("int").alias("chunks")), "large-shards")
    if large.isEmpty():
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    else:
        dealt = rows.join(large, ["which", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("mine"))
        pair = F.transform(others, lambda j: (F.least(j, F.col("mine")) * F.col("chunks") + F.greatest(j, F.col("mine"))).cast("long") + 1)
        rows = dealt.withColumn("tile", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair))).drop("mine", "chunks")
    rows = rows.repartition("which", "key", "tile").sortWithinPartitions("which", "key", "tile", "fp")
    return rows.select("which", "key", "tile", *dict.fromkeys(["fp", *words, *(["size", "loc"] if similar else [])])).mapInArrow(_shard_links(radius, words, similar), spark_schema(LINKS)).distinct()


def wide_plan(n: int, similarity: float) -> tuple[int, list[list[int]]]:
    """Radius of n wide fingerprints, and the bits that key each table."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi  # share of equal bits at this Jaccard similarity
    bits = 64 * WIDE
    radius = round(bits * (1 - same) + 3 * math.sqrt(bits * same * (1 - same)))
    key = min(max(12, math.ceil(math.log2(max(n, 1) / WIDE_SHARD))), 60)
    chance = [math.comb(bits, d) * (1 - same) ** d * same ** (bits - d) for d in range(radius + 1)]
    missed = lambda t: sum(p * (1 - ((bits - d) / bits) ** key) ** t for d, p in enumerate(chance)) / sum(chance)
    tables = math.ceil(math.log(1 - RECALL) / math.log1p(-(same**key)))
    while missed(tables) > 1 - RECALL:
        tables += 1
    rng = np.random.default_rng(SEED)
    return radius, [sorted(rng.choice(bits, key, replace=False).tolist()) for _ in range(tables)]


def wide_links(distinct: DataFrame, similarity: float, folder: str) -> DataFrame:
    """distinct: fp, its words, and size and place of its set in the folder, materialized."""
    radius, tables = wide_plan(distinct.count(), similarity)
    words = [f"w{k}" for k in range(WIDE)]
    schema = pa.schema([("which", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())] + [(w, pa.int64()) for w in words] + [("size", pa.int64()), ("loc", pa.int64())])
    masks = np.array([[sum(1 << (x % 64) for x in bits if x // 64 == k) for k in range(WIDE)] for bits in tables], dtype=np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in words]
            for t, bits in enumerate(tables):
                key = np.zeros(b.num_rows, dtype=np.int64)
                for x in bits:
                    key = (key << 1) | ((cols[x // 64] >> (x % 64)) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, dtype=np.int32)), pa.array(key), b.column("fp"), *[b.column(w) for w in (*words, "size", "loc")]], schema=schema)

    return _search(distinct.select("fp", *words, "size", "loc").mapInArrow(deal, spark_schema(schema)), radius, words, (similarity, folder, masks))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the (a, b) edges is connected with. Hubs are pre-aggregated, and split by AQE in joins."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = label.join(near, "node").join(up, "label", "left").select("node", F.least("label", "near", F.coalesce("up", "label")).alias("new"), "label")
        new = materialize(new, "labels")
        moved = new.where("new <> label").limit(1).count()
        label = new.select("node", F.col("new").alias("label"))
        if not moved:
            return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed), component_id for each document row; links are 64-bit fingerprints at most radius apart, none of which is lost."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _grouped(prints, distinct, links(distinct.select("fp"), radius))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a hash of the set of shingles), component_id for each document row; links are Jaccard similarities of shingle sets of at least the given one."""
    small_batches(docs.sparkSession)
    folder = new_path(docs.sparkSession, "sets")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name, at = TaskContext.get().taskAttemptId(), 0  # of this attempt only: places of a failed one are never asked for
        with files.open_output_stream(f"{path}/{name}") as out:
            for ids, texts in slices(batches):
                fp, wide, sets = wide_simhash(texts, shingle)
                size = np.array([len(x) for x in sets], dtype=np.int64)
                loc = (name << PLACE) + at + np.cumsum(size) - size
                out.write(np.concatenate(sets).tobytes())
                at += int(size.sum())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp.view(np.int64)), *[pa.array(np.ascontiguousarray(wide[:, k]).view(np.int64)) for k in range(WIDE)], pa.array(size), pa.array(loc)], schema=WIDE_PRINTS)

    prints = materialize(id_text(docs, id_col, text_col).mapInArrow(rows, spark_schema(WIDE_PRINTS)), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in (*[f"w{k}" for k in range(WIDE)], "size", "loc")]), "distinct")
    edges = materialize(wide_links(distinct, similarity, folder), "links")
    return _grouped(prints.select("doc_id", "fp"), distinct.select("fp", "least"), edges)


def _grouped(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    label = components(edges)
    joined = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    joined = materialize(joined, "members")
    # a component's id comes from its members other than the label node and from that node itself
    smallest = joined.where(F.col("label") != F.col("fp")).groupBy("label").agg(F.min("least").alias("other"))
    root = joined.where("label = fp").select(F.col("fp").alias("label"), F.col("least").alias("own"))
    ids = root.join(smallest, "label", "left").select("label", F.least("own", "other").alias("component_id"))
    by_print = joined.select("fp", "label").join(ids, "label").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
