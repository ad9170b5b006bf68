"""Operators 6, 7 and 10 against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandmark.llm import lm, segments, simhash, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ------------------------------------------------------------------ 10


def brute_dedup(rows):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 63), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,fan", [(50_000, 256), (5, 8), (1, 8), (5, 3)])
def test_suffix_dedup_matches_brute_force(docs, texts, monkeypatch, hot, fan):
    monkeypatch.setattr(suffix, "BLOCK", 100)
    monkeypatch.setattr(suffix, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(segments, "FAN", fan)
    if fan == 3:  # a tree of many levels
        monkeypatch.setattr(segments, "BUCKET_BYTES", 10_000)
    got = suffix.suffix_dedup(docs.repartition(11) if fan == 3 else docs)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == brute_dedup(list(enumerate(texts)))


def test_a_tree_has_bounded_fan():
    """Rows that segments and nodes write grow with the input, not with its square, and cover all of the hash."""
    for size in (0, 1, 10**9, 3 * 10**10, 10**12, 10**14):
        count = size // segments.SEGMENT_BYTES + 1
        tree = segments.Tree(size, count)
        buckets = math.prod(tree.fans)
        assert buckets * segments.BUCKET_BYTES >= size and max(tree.fans) <= segments.FAN and tree.groups[-1] == 1
        assert size <= 10**9 or buckets <= 3 * size / segments.BUCKET_BYTES
        nodes = 1
        for level, fan in enumerate(tree.fans):
            senders = count if level == 0 else nodes * tree.groups[level - 1]
            assert senders * fan <= 3 * segments.FAN * count  # rows of the level's exchange
            nodes *= fan
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    tree = segments.Tree(3 * 10**8, 75)
    assert sorted(np.concatenate([at for _, at in tree.deal(h, 0)]).tolist()) == list(range(5000))


def test_suffix_dedup_edges(spark, empty, texts):
    assert suffix.suffix_dedup(empty).count() == 0
    rows = [(5, texts[30]), (5, texts[30]), (None, texts[30]), (2, "x" * 50), (3, "x" * 51), (4, "x" * 49), (-1, "y" * 60 + texts[31])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seg", F.lit("clash"))
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.suffix_dedup(df).collect()}
    n = len(texts[30].encode())
    assert got[5, n] == 0 and got[None, n] == n and got[3, 51] == 51 and got[4, 49] == 0 and got[2, 50] == 0


@pytest.mark.parametrize("alphabet,n", [(2, 400), (1, 120), (26, 600), (3, 3000)])
def test_suffix_array(alphabet, n, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 50)
    rng = np.random.default_rng(n)
    text = bytes(rng.integers(0, alphabet, n, dtype=np.uint8))
    text += text[: n // 2] + text[: n // 3]
    got = np.concatenate(list(suffix.suffix_blocks(text, np.arange(len(text)))))
    assert got.tolist() == sorted(range(len(text)), key=lambda k: text[k:])


# ------------------------------------------------------------------ 7


def brute_simhash(t, shingle):
    w = WORD.findall(lower(t))
    sh = [" ".join(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))] if w else []
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def brute_components(ids, prints, radius=4):
    comp = list(range(len(prints)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                comp[top(a)] = top(b)
    least: dict = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(least.get(top(k), i), i)
    return [least[top(k)] for k in range(len(ids))]


def test_near_duplicates_match_brute_force(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_simhash(t, 4) for t in texts]
    comp = brute_components(range(len(texts)), prints)
    for i in range(len(texts)):
        assert got[i].fp & (2**64 - 1) == prints[i]
        assert got[i].component_id == comp[i]


def test_links_with_tiles_and_more_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds[:10]:
        for _ in range(30):
            x = int(s)
            for b in rng.integers(0, 64, 3):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    want = brute_components(range(len(prints)), prints)
    for tile, shard in ((20_000, 1000), (16, 1000), (20_000, 0.001)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "SHARD", shard)
        label = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
        groups = defaultdict(set)
        for k, x in enumerate(prints):
            y = x - (1 << 64) if x >> 63 else x
            groups[label.get(y, y)].add(want[k])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_a_hot_shard_is_dealt_anew(spark, monkeypatch):
    """Fingerprints that agree in a block, some of them linked across any of the others."""
    rng = np.random.default_rng(5)
    prints = {int(x) >> 14 << 14 for x in rng.integers(0, 1 << 63, 400, dtype=np.uint64)}
    for x in list(prints)[:80]:
        for b in rng.integers(14, 64, 4):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    want = brute_components(range(len(prints)), prints)
    monkeypatch.setattr(simhash, "TILE", 100)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    got = [label.get(simhash._signed(x), simhash._signed(x)) for x in prints]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    for m in simhash.shard_masks(1000):
        blocks = simhash.other_blocks(m, 5)
        assert sum(blocks) == (1 << 64) - 1 - m and max(b.bit_count() for b in blocks) - min(b.bit_count() for b in blocks) <= 1


def test_similar_documents_recall_and_precision(spark, monkeypatch):
    """Groups of edited copies at Jaccard 0.8 to 0.95 of five-word shingles against independent texts of the same vocabulary."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, want, near = [], [], 0
    sh = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for g in range(150):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((len(rows), " ".join(base)))
        want.append(rows[-1][0])
        if g % 2:
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rng.randrange(len(copy))] = "edited"
            j = len(sh(base) & sh(copy)) / len(sh(base) | sh(copy))
            rows.append((len(rows), " ".join(copy)))
            want.append(want[-1] if j >= 0.8 else rows[-1][0])
            near += j >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (20_000, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
        found = sum(got[i] == w for i, w in enumerate(want) if w != i)
        assert near > 30 and found >= 0.95 * near
        assert all(got[i] in (i, i - 1) for i in got)  # nothing but a text's own copy


def test_twins_in_a_large_family_of_similar_texts(spark):
    """3,000 edits of one text at 0.7 to each other, all candidates, do not hide 100 twins at 0.86 to their text."""
    import random

    rng = random.Random(12)
    base = ["w%d" % k for k in range(400)]

    def edited(words, slots, mark):
        words = list(words)
        for s in slots:  # each edit has five shingles of its own
            words[5 * s + 2] = f"{mark}x{s}"
        return words

    slots = [rng.sample(range(80), 7) for _ in range(3000)]
    texts = [edited(base, x, i) for i, x in enumerate(slots)]
    twins = rng.sample(range(3000), 100)
    texts += [edited(texts[i], [s for s in rng.sample(range(80), 20) if s not in slots[i]][:6], f"t{i}") for i in twins]
    sh = lambda i: {tuple(texts[i][k : k + 5]) for k in range(396)}
    jaccard = lambda i, j: len(sh(i) & sh(j)) / len(sh(i) | sh(j))
    assert all(jaccard(i, 3000 + k) >= 0.85 for k, i in enumerate(twins)) and 0.68 < jaccard(0, 1) < 0.75
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert sum(got[3000 + k] == got[i] for k, i in enumerate(twins)) >= 99
    where = np.zeros((3100, 80), dtype=int)
    for i, t in enumerate(texts):
        where[i, [s for s in range(80) if t[5 * s + 2] != base[5 * s + 2]]] = 1
    want = list(range(3100))  # with fewer than four places in common, two edits are not similar
    for i, j in sorted(map(tuple, np.argwhere(np.triu(where @ where.T >= 4, 1)))):
        if want[i] != want[j] and jaccard(i, j) >= 0.8:
            least, other = sorted((want[i], want[j]))
            want = [least if x == other else x for x in want]
    assert all(want[c] == want[i] for i, c in got.items())
    assert sum(got[i] == w for i, w in enumerate(want)) >= 3095


def test_similar_documents_with_a_dominant_shingle(spark):
    """One repeated shingle neither unites texts whose other words differ nor parts texts whose sets are similar."""
    words = lambda mark, n: [f"{mark}{k}" for k in range(n)]
    some, more = words("a", 104), words("b", 10)
    texts = [["-"] * 200 + words("x", 40), ["-"] * 200 + words("y", 40), words("z", 30) + ["0"] * 100, words("v", 30) + ["0"] * 100]
    texts += [some, some + more * 30]  # 100 shingles against the same, 14 at the joints and in the line that repeats, and it 30 times
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_near_duplicate_edges(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, None), (7, ""), (3, " \n"), (9, "a b c d e"), (9, "A  b c d e")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 3), (3, 3), (7, 3), (9, 9), (9, 9)]


# ------------------------------------------------------------------ 6


class BruteTree:
    """Context-tree weighting by plain recursion over the training texts' counts."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for ctx, s in self.symbols(t):
                for d in range(depth + 1):
                    c = ctx[depth - d :]
                    for b in range(8):
                        self.n[c, (1 << b) | (s >> (8 - b))][(s >> (7 - b)) & 1] += 1
                    if d < depth:
                        self.children[c].add(ctx[depth - d - 1 :])
        self.memo: dict = {}

    def symbols(self, t):
        b = b"\xff" * self.depth + t + b"\xff"
        return [(b[k - self.depth : k], b[k]) for k in range(self.depth, len(b))]

    def pe(self, node):
        a, b = self.n.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(self, c, prefix):
        if (c, prefix) not in self.memo:
            own = self.pe((c, prefix))
            if len(c) < self.depth:
                own = float(np.logaddexp(own, sum(self.pw(x, prefix) for x in self.children[c] if (x, prefix) in self.n))) - math.log(2)
            self.memo[c, prefix] = own
        return self.memo[c, prefix]

    def p(self, ctx, d, prefix, bit):
        c = ctx[self.depth - d :]
        n = self.n.get((c, prefix), (0, 0))
        kt = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return kt
        beta = math.exp(self.pe((c, prefix)) - math.log(2) - self.pw(c, prefix))
        return beta * kt + (1 - beta) * self.p(ctx, d + 1, prefix, bit)

    def score(self, t):
        return sum(math.log10(self.p(ctx, 0, (1 << b) | (s >> (8 - b)), (s >> (7 - b)) & 1)) for ctx, s in self.symbols(t) for b in range(8))


@pytest.mark.parametrize("depth,fan", [(3, 8), (4, 3), (5, 256)])
def test_scores_match_brute_force(spark, texts, monkeypatch, depth, fan):
    monkeypatch.setattr(segments, "FAN", fan)
    if fan == 3:  # a tree of many levels
        monkeypatch.setattr(segments, "BUCKET_BYTES", 3000)
    small = [t if t is None or len(t) < 3000 else t[:500] for t in texts[:60]]
    df = spark.createDataFrame(list(enumerate(small)), "doc_id long, text string").repartition(11 if fan == 3 else 3).withColumn("seg", F.lit("clash"))
    got = {r.doc_id: r for r in lm.ctw_scores(df, depth).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(small))]
    train = [t or "" for t, h in zip(small, held, strict=True) if not h]
    c = Counter(w for t in train for w in [*WORD.findall(lower(t)), "\n"])
    total = sum(c.values())
    tree = BruteTree([t.encode() for t in train], depth)
    assert len(got) == len(small)
    for i, t in enumerate(small):
        tokens = [*WORD.findall(lower(t)), "\n"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens)) < 1e-6
        assert abs(r.score - tree.score((t or "").encode())) < 1e-6 * max(1, abs(r.score))


def test_probabilities_sum_to_one(spark):
    tree = BruteTree([b"abab", b"ba"], 2)
    assert abs(sum(10 ** sum(math.log10(tree.p(b"ab", 0, (1 << b) | (s >> (8 - b)), (s >> (7 - b)) & 1)) for b in range(8)) for s in range(256)) - 1) < 1e-9


def test_scores_without_rows_or_training(spark, empty):
    assert lm.ctw_scores(empty).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm.ctw_scores(spark.createDataFrame([(out[0], "ab"), (out[1], None), (out[2], "")], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert sorted(round(r.score / math.log10(2)) for r in got) == [-24, -8, -8]
