"""Operator 10, exact-substring dedup with difference-cover blockwise suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.
1. Winnowing: each 50-byte window picks the K-gram with the least hash in it. Equal windows
   pick the same K-gram at the same offset, so a window whose K-gram occurs in one document
   only has no copy. Segments send distinct K-gram hashes up a tree of bounded fan (segments.py)
   and learn which are shared.
2. Runs of windows with one shared K-gram go, with their bytes, up the tree by that hash; all
   copies of a window meet in a node of its last level. Equal runs are sent on once, under their
   smallest id. The runs of a K-gram of very many documents (HOT_DOCUMENTS) would fill a node: its
   windows are asked for one by one, by their own hash, and the shared ones go as runs of one
   window by that hash. They differ in the way that they take, not in how they are compared.
3. A node's distinct runs are one text, whose suffix array is built block by block: suffixes
   at the residues of a difference cover are ranked first; then one block of suffixes that
   share leading bytes at a time is sorted by PREFIX bytes, and longer ties are resolved by
   the ranks of cover positions at the offset that both suffixes share. Only one block's keys
   are in memory besides the ranks. Neighbours in it with 50 equal bytes are one group.
4. Each segment gets back, down the tree, the smallest id of each distinct window that it sent, and
   removes the windows of documents over it. No task holds more than FAN entries for any string.

Hashes decide only who meets; whatever counts as equal, runs and windows, is compared by its bytes.

Defined cases: a null text is empty; texts under 50 bytes keep everything; rows with equal
ids do not remove each other; a null id counts as larger than any other and removes nothing;
an empty table gives no rows; texts of any length are treated whole, one over some MB in a segment
of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Quick, materialize, mix, runs, spark_schema
from .segments import ANSWERS, BUCKET_BYTES, COUNTED, NODE, SUMMED, Tree, as_table, climb, counts_again, descend, first_row, pack, pack_ints, pack_sorted, segments, spread, sum_counts, unpack, unpack_ints, unpack_sorted

LENGTH, K = 50, 20
#: a perfect difference cover: every residue modulo PERIOD is the difference of two of its members
PERIOD, COVER = 13, (0, 1, 3, 9)
#: bytes that are compared before cover ranks, PERIOD at least
PREFIX = 16
#: suffixes in a block, unless more share their first two bytes
BLOCK = 500_000
#: windows of a K-gram of more documents travel one by one: its distinct runs (65 bytes each) could exceed a node's share of the text
HOT_DOCUMENTS = 50_000
#: stands for a null id
NO_ID = np.iinfo(np.int64).max

#: kinds of answers: for each K-gram (GRAMS) and window of a hot one (WINDOWS) ALONE, COMMON or VERY_COMMON; for each window of each run its smallest id (RUNS)
GRAMS, WINDOWS, RUNS = 0, 1, 2
ALONE, COMMON, VERY_COMMON = 0, 1, 2
#: distinct runs of a child: what sends them on (absent at the last level), smallest id, number of windows, bytes
SENT = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("group", pa.int64()), ("child", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("n", pa.binary()), ("text", pa.binary())])
HELD = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("group", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("n", pa.binary()), ("text", pa.binary()), ("children", pa.list_(pa.int64())), ("asked", pa.list_(pa.binary()))])
DEDUPED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


# ------------------------------------------------------------------ suffix arrays


def shared_offsets() -> np.ndarray:
    """offset[a, b]: the least d for which both a + d and b + d are in the cover."""
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


def words_at(text: bytes) -> np.ndarray:
    """Big-endian 8-byte words at every position, zero-padded; a view that copies nothing."""
    padded = text + bytes(64)
    return np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))


def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first one leading, and each element's rank among the distinct ones."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(n: int, words: np.ndarray) -> np.ndarray:
    """Rank + 1 of each suffix at a cover position among all such, 0 elsewhere and beyond the end, by prefix doubling in steps of PERIOD."""
    every = np.arange(n)
    at = every[np.isin(every % PERIOD, COVER)]
    rank = np.zeros(n + 2 * PERIOD, dtype=np.int64)
    if not len(at):
        return rank
    # what lies beyond the end sorts first: the number of bytes left breaks ties of zero padding
    left = np.minimum(n - at, PERIOD)
    _, r = dense(words[at].astype(np.uint64), (words[at + 8].astype(np.uint64) >> np.uint64(64 - 8 * (PERIOD - 8))), left)
    rank[at] = r + 1
    step = PERIOD
    tied = np.arange(len(at))
    while True:
        size = np.bincount(r)
        tied = tied[size[r[tied]] > 1]
        if not len(tied) or step > n:
            return rank
        ahead = at[tied] + step
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n)], 0)
        # ranks are spread so that a class of ties has as many free ranks as members
        order, sub = dense((r[tied].astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64))
        base = np.cumsum(size) - size if step == PERIOD else None
        if base is not None:
            r = base[r]
            rank[at] = r + 1
        group = r[tied][order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(order))
        start = place[first][np.cumsum(first) - 1]
        change = np.concatenate(([True], sub[order][1:] != sub[order][:-1]))
        lead = place[change][np.cumsum(change) - 1]
        new = r.copy()
        new[tied[order]] = group + lead - start
        r = new
        rank[at] = r + 1
        step *= 2


def suffix_blocks(text: bytes, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The given suffixes of text in order, one block of leading bytes at a time."""
    words = words_at(text)
    rank = cover_ranks(len(text), words)
    lead = (words[starts] >> np.uint64(48)).astype(np.int64)
    sizes = np.bincount(lead, minlength=1 << 16)
    block = np.cumsum(sizes) // BLOCK
    by_block = np.argsort(block[lead], kind="stable")
    cut = np.flatnonzero(np.diff(block[lead][by_block])) + 1
    offset = shared_offsets()
    for part in np.split(by_block, cut):
        if len(part):
            yield _sort_block(starts[part], words, rank, offset, len(text))


def _sort_block(pos: np.ndarray, words: np.ndarray, rank: np.ndarray, offset: np.ndarray, n: int) -> np.ndarray:
    keys = [words[pos].astype(np.uint64), words[pos + 8].astype(np.uint64)]
    if int(pos.max()) > n - PREFIX:  # zero padding is less than a zero byte
        keys.append(np.minimum(n - pos, PREFIX))
    order, tie = dense(*keys)
    pos, tie = pos[order], tie[order]
    size = np.bincount(tie)
    many = np.flatnonzero(size[tie] > 1)
    if not len(many):
        return pos
    group, at = tie[many], pos[many]
    place = (np.cumsum(size) - size)[group]
    key = group.astype(np.int64) << 32
    members = [np.flatnonzero(at % PERIOD == c) for c in range(PERIOD)]
    for b in range(PERIOD):
        if not len(members[b]):
            continue
        first = np.concatenate(([0], np.cumsum(np.bincount(group[members[b]], minlength=len(size)))))
        known: dict = {}
        for a in range(PERIOD):
            mine = members[a]
            if not len(mine):
                continue
            d = int(offset[a, b])
            if d not in known:
                known[d] = np.sort(key[members[b]] | rank[at[members[b]] + d])
            # how many members of class b in the same tie come before each of class a
            place[mine] += np.searchsorted(known[d], key[mine] | rank[at[mine] + d]) - first[group[mine]]
    out = pos.copy()
    out[place] = at
    return out


def equal_groups(text: bytes, starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffix starts in order, group number): suffixes with the same first bytes, length of them, are one group."""
    words = words_at(text)
    steps = [*range(0, length - 7, 8), length - 8]
    for block in suffix_blocks(text, starts):
        new = np.zeros(len(block), dtype=bool)
        for s in steps:
            w = words[block + s]
            new[1:] |= w[1:] != w[:-1]
        yield block, np.cumsum(new)


# ------------------------------------------------------------------ windows of a segment


def picks(texts: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Runs of windows that pick the same K-gram: first window, number of windows, the K-gram's hash, document index; and the segment's bytes."""
    blob = b"".join(texts)
    buf = np.frombuffer(blob, dtype=np.uint8)
    m = len(buf) - LENGTH + 1
    if m <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none, blob
    at = np.arange(len(buf) - K + 1)
    hashes = Quick(buf).spans(at, at + K)
    low = (hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    width, have = LENGTH - K + 1, 1
    while have < width:  # minimum over a power of two, then over two overlapping ones
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    pick = (low[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lens)
    window = np.arange(m)
    doc = np.repeat(np.arange(len(lens)), lens)[:m]
    whole = window + LENGTH <= ends[doc]
    new = np.ones(m, dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [m])))
    first, n = first[whole[first]], n[whole[first]]
    return first, n, hashes[pick[first]], doc[first], blob


def short(h: np.ndarray, size: int) -> np.ndarray:
    """As many leading bits as keep chance matches rare for the size of the input: such a match costs work, not correctness."""
    return h >> np.uint64(64 - min(64, 16 + (size + BUCKET_BYTES).bit_length()))


def hash_of(kind: int, keys: np.ndarray) -> np.ndarray:
    return mix(keys)


def differ(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of at least 8 bytes at a and b are not the same."""
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(s, size - 8)
        out |= words[a + at] != words[b + at]
    return out


def distinct_runs(text: bytes, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal runs, in order, and which of them each run is. Hashes propose, bytes decide."""
    words, key = words_at(text), key + size.astype(np.uint64)
    while True:
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        first = where[which]
        other = np.flatnonzero(first != np.arange(len(first)))
        one = first[other]
        wrong = other[(size[other] != size[one]) | differ(words, start[other], start[one], np.minimum(size[other], size[one]))]
        if not len(wrong):
            order = np.argsort(where)
            return where[order], np.argsort(order)[which]
        key[wrong] = mix(key[wrong])


def smallest(ids: np.ndarray, which: np.ndarray, groups: int) -> np.ndarray:
    least = np.full(groups, NO_ID, dtype=np.int64)
    np.minimum.at(least, which, ids)
    return least


def _count_rows(kind: int, row: dict, tree: Tree, h: np.ndarray, doc: np.ndarray) -> list[list]:
    """Distinct hashes with the number of their documents, to the nodes of the first level."""
    if not len(h):
        return []
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    docs = np.bincount(np.cumsum(first) - 1, weights=np.concatenate(([True], first[1:] | (doc[1:] != doc[:-1])))).astype(np.int64)
    keys = h[first]
    return [[kind, d, tree.group_of(row["seg"], 0), row["seg"], pack_sorted(keys[at]), pack_ints(docs[at])] for d, at in tree.deal(hash_of(kind, keys), 0)]


def _grams(load, tree: Tree, size: int):
    def fn(row: dict) -> list[list]:
        _, _, h, doc, _ = picks(*load(row))
        return _count_rows(GRAMS, row, tree, short(h, size), doc)

    return fn


def _shared(tree: Tree, hot: int):
    """Which of a node's hashes are of two documents or more, and which K-grams are hot, told to each child in the order in which it sent them."""

    def fn(table: pa.Table) -> pa.Table:
        row = first_row(sum_counts(table))
        n = unpack_ints(row["counts"])
        state = (n > 1).astype(np.uint8) + (n > hot)
        if row["kind"] == WINDOWS:
            state = np.minimum(state, COMMON)
        return as_table(tree.down(row, state, pack), ANSWERS) if state.any() else as_table([], ANSWERS)

    return fn


class Candidates:
    """A segment's windows with shared K-grams, as runs, each distinct one once. Building it twice gives the same order."""

    def __init__(self, row: dict, told: pa.Table, load, tree: Tree, size: int):
        texts, self.lens = load(row)
        self.told = {(k, d): v for k, d, v in zip(*(told[c].to_pylist() for c in ("kind", "digit", "values")), strict=True)}
        self.tree, self.size = tree, size
        first, n, h, doc, self.blob = picks(texts, self.lens)
        self.quick = Quick(np.frombuffer(self.blob, dtype=np.uint8))
        h = short(h, size)
        state = self.states(GRAMS, h)
        warm = np.flatnonzero(state == VERY_COMMON)
        #: windows of hot K-grams, and their documents
        self.hot, self.hot_doc = spread(first[warm], n[warm]), np.repeat(doc[warm], n[warm])
        self.hot_hash = short(self.quick.spans(self.hot, self.hot + LENGTH), size)
        self.cool = state == COMMON
        self.parts = first, n, h, doc
        self.row = row

    def states(self, kind: int, h: np.ndarray) -> np.ndarray:
        """What the tree says of each hash."""
        keys, at = np.unique(h, return_inverse=True)
        state = np.full(len(keys), ALONE, dtype=np.uint8)
        for d, mine in self.tree.deal(hash_of(kind, keys), 0):
            if (kind, d) in self.told:
                state[mine] = unpack(self.told[kind, d], np.uint8)
        return state[at]

    def runs(self) -> Candidates:
        first, n, h, doc = (x[self.cool] for x in self.parts)
        hot = self.states(WINDOWS, self.hot_hash) == COMMON
        ids = np.array([NO_ID if i is None else i for i in self.row["doc_ids"]], dtype=np.int64)
        self.first = np.concatenate((first, self.hot[hot]))
        self.n = np.concatenate((n, np.ones(int(hot.sum()), dtype=np.int64)))
        self.ids = ids[np.concatenate((doc, self.hot_doc[hot]))]
        keys = np.concatenate((h, self.hot_hash[hot]))
        long = self.n + LENGTH - 1
        self.where, self.which = distinct_runs(self.blob, self.first, long, self.quick.spans(self.first, self.first + long))
        self.least = smallest(self.ids, self.which, len(self.where))
        self.keys = mix(keys[self.where])
        return self


def _windows(load, tree: Tree, size: int):
    """The windows of a segment's hot K-grams, as _grams sends K-grams."""

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not any((unpack(v.as_py(), np.uint8) == VERY_COMMON).any() for v in right["values"]):
            return as_table([], COUNTED)
        c = Candidates(first_row(left), right, load, tree, size)
        return as_table(_count_rows(WINDOWS, c.row, tree, c.hot_hash, c.hot_doc), COUNTED)

    return fn


def _send(load, tree: Tree, size: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return as_table([], SENT)
        c = Candidates(first_row(left), right, load, tree, size).runs()
        own = c.where
        return as_table(_run_rows(tree, 0, 0, c.row["seg"], c.row["seg"], c.keys, c.least, c.n[own], c.blob, c.first[own]), SENT)

    return fn


def _run_rows(tree: Tree, level: int, node: int, group: int, child: int, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, text: bytes, start: np.ndarray) -> list[list]:
    """Runs to the nodes of a level."""
    buf, out = np.frombuffer(text, dtype=np.uint8), []
    for d, at in tree.deal(keys, level):
        body = buf[spread(start[at], n[at] + LENGTH - 1)]
        further = pack(keys[at]) if level + 1 < tree.levels else None
        out.append([RUNS, node * tree.fans[level] + d, tree.group_of(group, level), child, further, pack_ints(ids[at]), pack(n[at].astype(np.uint8)), pack(body)])
    return out


def _join(table: pa.Table) -> tuple[dict, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A node of SENT rows: a HELD row without its text, the distinct runs' text, and where each begins in it; their windows and smallest ids."""
    n = [unpack(x.as_py(), np.uint8).astype(np.int64) for x in table["n"]]
    held = np.concatenate(([0], np.cumsum([len(x) for x in n])))
    n = np.concatenate(n)
    size = n + LENGTH - 1
    start = np.cumsum(size) - size
    texts, content = [], np.empty(len(n), dtype=np.uint64)
    for k, packed in enumerate(table["text"]):
        mine = slice(held[k], held[k + 1])
        texts.append(unpack(packed.as_py()))
        begin = start[mine] - start[mine][:1]
        content[mine] = Quick(np.frombuffer(texts[-1], dtype=np.uint8)).spans(begin, begin + size[mine])
    text = b"".join(texts)
    del texts
    where, which = distinct_runs(text, start, size, content)
    least = smallest(np.concatenate([unpack_ints(x.as_py()) for x in table["ids"]]), which, len(where))
    body = np.frombuffer(text, dtype=np.uint8)[spread(start[where], size[where])].tobytes()
    further = None if table["keys"][0].as_py() is None else pack(np.concatenate([unpack(x.as_py(), np.uint64) for x in table["keys"]])[where])
    row = first_row(table.select(NODE)) | {"keys": further, "children": table["child"].to_pylist(), "asked": [pack(x.astype(np.int32)) for x in np.split(which, held[1:-1])]}
    size = size[where]
    return row, body, np.cumsum(size) - size, n[where], least


def _merge(table: pa.Table) -> pa.Table:
    row, body, _, n, least = _join(table)
    row |= {"ids": pack_ints(least), "n": pack(n.astype(np.uint8)), "text": pack(body)}
    return as_table([[row[f.name] for f in HELD]], HELD)


def _runs_again(tree: Tree):
    def again(row: dict, level: int) -> list[list]:
        n = unpack(row["n"], np.uint8).astype(np.int64)
        size = n + LENGTH - 1
        return _run_rows(tree, level, row["node"], row["group"], row["group"], unpack(row["keys"], np.uint64), unpack_ints(row["ids"]), n, unpack(row["text"]), np.cumsum(size) - size)

    return again


def _group(tree: Tree):
    """A node of the last level: the smallest id of each window of each run, by the suffix array of all."""

    def fn(table: pa.Table) -> pa.Table:
        row, body, start, n, least = _join(table)
        windows, run = spread(start, n), np.repeat(np.arange(len(n)), n)
        window_of = np.full(len(body), -1, dtype=np.int64)
        window_of[windows] = np.arange(len(windows))
        first_id = np.empty(len(windows), dtype=np.int64)
        for block, group in equal_groups(body, windows, LENGTH):
            w = window_of[block]
            first_id[w] = smallest(least[run[w]], group, int(group[-1]) + 1)[group]
        return as_table(tree.down(row, first_id, pack_ints, n), ANSWERS)

    return fn


def _finish(load, tree: Tree, size: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        row = first_row(left)
        texts, lens = load(row)
        edge = np.zeros(int(lens.sum()) + 1, dtype=np.int64)
        if right.num_rows:
            c = Candidates(row, right, load, tree, size).runs()
            # distinct runs' windows in the order of the runs
            sizes = c.n[c.where]
            begin = np.cumsum(sizes) - sizes
            first_id = np.empty(int(sizes.sum()), dtype=np.int64)
            for d, at in tree.deal(c.keys, 0):
                first_id[spread(begin[at], sizes[at])] = unpack_ints(c.told[RUNS, d])
            mark(edge, spread(c.first, c.n)[first_id[spread(begin[c.which], c.n)] < np.repeat(c.ids, c.n)])
        return as_table(cut_out(row["doc_ids"], texts, np.cumsum(edge[:-1]) > 0), DEDUPED)

    return fn


def mark(edge: np.ndarray, windows: np.ndarray) -> None:
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + LENGTH, -1)


def cut_out(ids: list, texts: list[bytes], gone: np.ndarray) -> list[list]:
    rows, at = [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        n = len(text)
        start, end = runs(gone[at : at + n])
        at += n
        pieces, last = [], 0
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            pieces.append(text[last:s])
            last = e
        kept = b"".join([*pieces, text[last:]])
        rows.append([doc_id, n, n - len(kept), len(start), hashlib.sha256(kept).hexdigest(), np.stack([start, end], axis=1).tolist(), kept])
    return rows


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: sizes, removed spans (bytes, end exclusive) and the bytes that stay."""
    segs = segments(docs, id_col, text_col)
    tree, mine = Tree(segs.size, segs.count), (segs.loader(), Tree(segs.size, segs.count), segs.size)

    def flags(sent: DataFrame) -> DataFrame:
        nodes, last = climb(sent, tree, sum_counts, SUMMED, counts_again(tree, hash_of), "counts")
        told = last.groupBy(*NODE).applyInArrow(_shared(tree, HOT_DOCUMENTS), spark_schema(ANSWERS))
        states = lambda row: hash_of(row["kind"], unpack_sorted(row["keys"]))
        return materialize(descend(nodes, told, tree, states, lambda kind: (np.uint8, pack, lambda b: unpack(b, np.uint8))), "shared")

    known = flags(segs.map(COUNTED, _grams(*mine)))
    known = known.union(flags(segs.map_with(known, COUNTED, _windows(*mine))))
    nodes, last = climb(segs.map_with(known, SENT, _send(*mine)), tree, _merge, HELD, _runs_again(tree), "runs")
    told = materialize(last.groupBy(*NODE).applyInArrow(_group(tree), spark_schema(ANSWERS)), "windows")
    windows_of = lambda row: unpack(row["n"], np.uint8).astype(np.int64)
    answers = descend(nodes, told, tree, lambda row: unpack(row["keys"], np.uint64), lambda kind: (np.int64, pack_ints, unpack_ints), windows_of)
    return segs.map_with(known.union(answers), DEDUPED, _finish(*mine))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, doc_id, o, substr(h, 2 * o + 1, {2 * (200 + LENGTH - 1)}) AS h FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2, 200)) AS o FROM d)),
windows AS (SELECT r, doc_id, o + k AS k, substr(h, 2 * k + 1, {2 * LENGTH}) AS w FROM (SELECT r, doc_id, o, h, unnest(range(0, least(len(h) // 2 - {LENGTH - 1}, 200))) AS k FROM parts WHERE len(h) >= {2 * LENGTH})),
again AS (SELECT r, k FROM (SELECT r, k, doc_id, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < coalesce(doc_id, {NO_ID})),
marked AS (SELECT r, k, coalesce(k > lag(k) OVER (PARTITION BY r ORDER BY k) + {LENGTH}, TRUE) AS new FROM again),
numbered AS (SELECT r, k, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY k) AS run FROM marked),
spans AS (SELECT r, min(k) AS a, max(k) + {LENGTH} AS b FROM numbered GROUP BY r, run),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
