"""Operator 6, language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; a decision has a node at every context depth 0..DEPTH
(the preceding bytes), with a Krichevsky-Trofimov estimator. The context-tree weighting
recursion Pw = (Pe + product of the children's Pw) / 2 gives each node its weight, and the
predictive probability mixes the estimates of all depths. Pe depends on counts alone, so the
model of the whole training corpus follows from its (DEPTH + 1)-gram counts in any order.

Grams and words are counted over all training texts: segments send their distinct keys up a tree
of bounded fan (segments.py). Grams are dealt by their LOW latest context bytes, so that a node of
its last level holds whole contexts: 2^(8 (DEPTH - LOW + 1)) grams of one at most. It runs the
recursion down to depth LOW; depth 2 is summed from all nodes by an aggregation, depths 0 and 1
from it (at most 255 x 256 rows reach the driver), and the mixtures of depth 2 go back to the
nodes that hold their contexts. Log-probabilities and word counts go down the tree to the segments
that asked, so neither vocabulary nor model is ever broadcast or collected, and a hot word or gram
costs one entry a segment.

Words are keyed by 62-bit hashes. A text starts in a context of 0xFF bytes and ends with
0xFF, which UTF-8 never holds, so probabilities sum to one over all texts.

Defined cases: null and empty texts are one end token; a null id hashes as the empty string;
without training rows every count is 0 and the model is uniform; repeated rows count as often
as they occur and score alike; an empty table gives no rows; a text of any length is scored whole,
one over some MB in a segment of its own; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, Rolling, counts_in, find, materialize, mix, runs, spark_schema
from .decontaminate import LOWER
from .segments import ANSWERS, COUNTED, NODE, SUMMED, Tree, as_table, climb, counts_again, descend, first_row, map_rows, pack, pack_ints, pack_sorted, segments, sum_counts, unpack, unpack_ints, unpack_sorted

#: bytes of context; the keys of grams have DEPTH + 1 bytes
DEPTH = 5
#: bytes of context that decide which node holds a gram
LOW = 3
END = 0xFF
WORDS, GRAMS = 0, 1

#: nodes of depth 2 (context and prefix of a symbol's bits), as far as the contexts of one node of the exchange say: counts of zeros and ones, sum of the log weights below
SLOTS = pa.schema([("node", pa.int64()), ("slot", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("below", pa.float64())])
#: the same over all: log weight, share of the own estimate in the mixture, own estimate of a one
PAIRS = pa.schema([("slot", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("weight", pa.float64()), ("beta", pa.float64()), ("one", pa.float64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# ------------------------------------------------------------------ keys of a segment


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words in order, and their number in each text."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens + 1) - 1
    start, end = runs(~WS[buf])
    return Rolling(buf).spans(start, end), counts_in(ends - lens, ends, start)


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text and for its end: the context's bytes and the byte itself; and their number in each text."""
    pad = bytes([END]) * depth
    buf = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    n = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + 1
    key = np.zeros(len(buf) - depth, dtype=np.uint64)
    for j in range(depth + 1):
        key <<= np.uint64(8)
        key |= buf[j : j + len(key)]
    # texts are depth apart, of which the first END is predicted and the others are not
    skip = np.ones(len(key), dtype=bool)
    at = np.cumsum(n) + np.arange(len(n)) * (depth - 1)
    for j in range(depth - 1):
        gap = at[:-1] + j
        skip[gap] = False
    return key[: int(at[-1])][skip[: int(at[-1])]], n


def distinct_counts(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs where train holds."""
    s = np.sort(keys)
    s = s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
    t = np.sort(keys[train])
    head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, dtype=np.int64)
    count = np.zeros(len(s), dtype=np.int64)
    count[np.searchsorted(s, t[head])] = np.diff(np.concatenate((head, [len(t)])))
    return s, count


def hash_of(kind: int, keys: np.ndarray) -> np.ndarray:
    """What decides a key's way up the tree: all of a word, the LOW latest context bytes of a gram."""
    return mix(keys if kind == WORDS else (keys >> np.uint64(8)) & np.uint64((1 << (8 * LOW)) - 1))


def codec(kind: int) -> tuple:
    """Counts of words, float32 log10 probabilities of grams."""
    return (np.int64, pack_ints, unpack_ints) if kind == WORDS else (np.float32, pack, lambda b: unpack(b, np.float32))


def _count(load, tree: Tree, depth: int):
    def fn(row: dict) -> list[list]:
        texts, _ = load(row)
        train = np.array([not held_out(i) for i in row["doc_ids"]])
        out = []
        for kind, (keys, n) in ((WORDS, word_keys(texts)), (GRAMS, gram_keys(texts, depth))):
            keys, count = distinct_counts(keys, np.repeat(train, n))
            out += [[kind, d, tree.group_of(row["seg"], 0), row["seg"], pack_sorted(keys[at]), pack_ints(count[at])] for d, at in tree.deal(hash_of(kind, keys), 0)]
        return out

    return fn


# ------------------------------------------------------------------ context trees


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting x by 8."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


class Contexts:
    """Nodes of some contexts at depths low..depth. A node is a context and a prefix of a symbol's bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: int):
        self.depth, self.low, self.keys = depth, low, keys
        symbol = keys & np.uint64(0xFF)
        self.nodes, self.sizes, self.weight, self.beta = {}, {}, {}, {}
        below = None
        for d in range(depth, low - 1, -1):
            context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            slots = [self.slot(context, symbol, b) for b in range(8)]
            node = np.unique(np.concatenate(slots))
            sizes = np.zeros((2, len(node)))
            for b in range(8):
                bit = (symbol >> np.uint64(7 - b)) & np.uint64(1)
                at = np.searchsorted(node, slots[b])
                for v in (0, 1):
                    sizes[v] += np.bincount(at, weights=np.where(bit == v, counts, 0), minlength=len(node))
            own = log_kt(*sizes)
            if below is None:
                weight = own
            else:
                deeper, logs = below
                up = (((deeper >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | (deeper & np.uint64(0xFF))
                children = np.bincount(np.searchsorted(node, up), weights=logs, minlength=len(node))
                weight = np.logaddexp(own, children) - np.log(2)
            self.nodes[d], self.sizes[d], self.weight[d] = node, sizes, weight
            self.beta[d] = np.ones(len(node)) if d == depth else np.exp(own - np.log(2) - weight)
            below = (node, weight)

    @staticmethod
    def slot(context: np.ndarray, symbol: np.ndarray, bit: int) -> np.ndarray:
        return (context << np.uint64(8)) | np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))

    def bit_probabilities(self, bit: int) -> np.ndarray:
        """For each key: the probability, mixed over depths low..depth, of the given bit of its symbol."""
        symbol = self.keys & np.uint64(0xFF)
        value = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        p = np.zeros(len(self.keys))
        for d in range(self.depth, self.low - 1, -1):
            context = (self.keys >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            at = np.searchsorted(self.nodes[d], self.slot(context, symbol, bit))
            kt = (self.sizes[d][value, at] + 0.5) / (self.sizes[d][:, at].sum(axis=0) + 1)
            p = self.beta[d][at] * kt + (1 - self.beta[d][at]) * p
        return p


def _slots(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, keys, counts in zip(*(b.column(n).to_pylist() for n in ("node", "keys", "counts")), strict=True):
                tree = Contexts(unpack_sorted(keys), unpack_ints(counts), depth, LOW)
                up = pair_slot(tree.nodes[LOW] >> np.uint64(8), tree.nodes[LOW] & np.uint64(0xFF))
                slot, at = np.unique(up, return_inverse=True)
                sums = [np.bincount(at, weights=w, minlength=len(slot)) for w in (*tree.sizes[LOW], tree.weight[LOW])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), node)), pa.array(slot.astype(np.int64)), *map(pa.array, sums)], schema=SLOTS)

    return run


def pair_slot(context: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The node of depth 2 above a context."""
    return ((context & np.uint64(0xFFFF)) << np.uint64(8)) | prefix


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot, n0, n1, below = (b.column(n).to_numpy(zero_copy_only=False) for n in ("slot", "n0", "n1", "below"))
        own = log_kt(n0, n1)
        weight = np.logaddexp(own, below) - np.log(2)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, n0, n1, weight, np.exp(own - np.log(2) - weight), (n1 + 0.5) / (n0 + n1 + 1))], schema=PAIRS)


def top_levels(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """From sums of depth 2 by latest byte and prefix (at most 256 x 255 rows): add[latest byte, prefix, bit] and scale[latest byte, prefix], so that the probability of a bit is add + scale x its probability at depth 2."""
    n1, below = np.zeros((2, 256, 256)), np.zeros((256, 256))
    for r in rows:
        at = divmod(r["slot"], 256)
        n1[:, at[0], at[1]] = r["n0"], r["n1"]
        below[at] = r["weight"]
    own1 = log_kt(*n1)
    weight1 = np.logaddexp(own1, below) - np.log(2)
    n0 = n1.sum(axis=1)
    own0 = log_kt(*n0)
    beta0 = np.exp(own0 - np.logaddexp(own0, weight1.sum(axis=0)))
    beta1 = np.exp(own1 - np.logaddexp(own1, below))
    kt = lambda n: (n + 0.5) / (n.sum(axis=0) + 1)
    add = beta0 * kt(n0)[:, None, :] + (1 - beta0) * beta1 * kt(n1)
    return np.moveaxis(add, 0, -1), (1 - beta0) * (1 - beta1)


def _price(tree: Tree, depth: int, add: np.ndarray, scale: np.ndarray):
    """A node's answers: the log-probability of each of its grams. right: the mixtures of depth 2 over its contexts."""

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        row = first_row(left)
        keys = unpack_sorted(row["keys"])
        contexts = Contexts(keys, unpack_ints(row["counts"]), depth, LOW)
        slots = right["slot"].to_numpy()
        order = np.argsort(slots)
        slots, beta, one = slots[order].astype(np.uint64), right["beta"].to_numpy()[order], right["one"].to_numpy()[order]
        symbol = (keys & np.uint64(0xFF)).astype(np.int64)
        latest = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
        logs = np.zeros(len(keys))
        for b in range(8):
            prefix, bit = (1 << b) | (symbol >> (8 - b)), (symbol >> (7 - b)) & 1
            at = np.searchsorted(slots, pair_slot(keys >> np.uint64(8), prefix.astype(np.uint64)))
            p = beta[at] * np.where(bit == 1, one[at], 1 - one[at]) + (1 - beta[at]) * contexts.bit_probabilities(b)
            logs += np.log10(add[latest, prefix, bit] + scale[latest, prefix] * p)
        return as_table(tree.down(row, logs.astype(np.float32), codec(GRAMS)[1]), ANSWERS)

    return fn


def _answer_words(tree: Tree):
    return lambda row: tree.down(row, unpack_ints(row["counts"]), codec(WORDS)[1])


def _score(load, tree: Tree, depth: int, n: int, v: int, ends: int):
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        row = first_row(left)
        told = dict(zip(zip(right["kind"].to_pylist(), right["digit"].to_pylist(), strict=True), right["values"].to_pylist(), strict=True))

        def answers(kind, keys):
            """What the tree says of each key."""
            asked, _ = distinct_counts(keys, np.zeros(len(keys), dtype=bool))
            dtype, _, decode = codec(kind)
            out = np.empty(len(asked), dtype=dtype)
            for d, at in tree.deal(hash_of(kind, asked), 0):
                out[at] = decode(told[kind, d])
            return out[find(asked, keys)]

        texts, lens = load(row)
        total = lambda x, m: np.bincount(np.repeat(np.arange(len(texts)), m), weights=x, minlength=len(texts))
        words, m = word_keys(texts)
        c = answers(WORDS, words)
        known, score = total(c > 0, m) + (ends > 0), total(base(c), m) + base(ends)
        grams, g = gram_keys(texts, depth)
        logs = total(answers(GRAMS, grams), g)
        bits = -logs * np.log2(10) / np.maximum(lens, 1)
        rows = zip(row["doc_ids"], [held_out(i) for i in row["doc_ids"]], (m + 1).tolist(), known.astype(np.int64).tolist(), [n] * len(texts), score.tolist(), logs.tolist(), bits.tolist(), strict=True)
        return as_table([list(x) for x in rows], SCORES)

    return fn


def ctw_scores(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents under the models learned from the rows that held_out() leaves for training. depth: 3 to 7; with more than 5, a node's grams are bounded by the training texts alone."""
    if not LOW <= depth <= 7:
        raise ValueError(f"depth must be {LOW} to 7")
    segs = segments(docs, id_col, text_col)
    tree, load = Tree(segs.size, segs.count), segs.loader()
    counted = segs.map(COUNTED, _count(load, tree, depth))
    nodes, last = climb(counted, tree, sum_counts, SUMMED, counts_again(tree, hash_of), "counts")
    summed = materialize(last.groupBy(*NODE).applyInArrow(sum_counts, spark_schema(SUMMED)), "counts")
    words, grams = (summed.where(F.col("kind") == k) for k in (WORDS, GRAMS))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).first()
    ids = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("i"))
    ends = ids.where(F.crc32("i") % 10 != 0).count()
    slots = materialize(grams.select("node", "keys", "counts").mapInArrow(_slots(depth), spark_schema(SLOTS)), "slots")
    sums = slots.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    pairs = materialize(sums.mapInArrow(_pairs, spark_schema(PAIRS)), "pairs")
    latest = F.col("slot").bitwiseAND(0xFFFF).alias("slot")
    tops = pairs.groupBy(latest).agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weight")]).collect()  # a byte and a prefix: 256 x 255 rows at most
    mixtures = slots.select("node", "slot").join(pairs.select("slot", "beta", "one"), "slot")
    priced = grams.drop("n", "known").groupBy("node").cogroup(mixtures.groupBy("node")).applyInArrow(_price(tree, depth, *top_levels(tops)), spark_schema(ANSWERS))
    told = map_rows(words.drop("n", "known"), ANSWERS, _answer_words(tree)).union(priced)
    answers = descend(nodes, told, tree, lambda row: hash_of(row["kind"], unpack_sorted(row["keys"])), codec)
    score = _score(load, tree, depth, totals["n"] + ends, totals["known"] + (ends > 0), ends)
    return segs.map_with(answers, SCORES, score)


def op6_ctw_score(spark, sf_dir: str) -> DataFrame:
    return ctw_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
