"""The pipeline against brute force over its stages."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from strandmark.llm import mixing, secrets
from strandmark.llm.common import materialize
from strandmark.sources import paths

from .conftest import SCHEMA, prose
from .test_index_ops import words


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(40)]
    bench = prose(rng, 30)
    texts = [None, "", "!!! ???", *base, *base[:8], *[b + "." for b in base[8:12]], base[20] + " " + bench, base[21] + " password=hunter2hunter2 end", "ж" * 5]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert {0, 1, 2}.isdisjoint(kept["language_id"]) and set(range(3, 43)) <= set(kept["language_id"])
    ids = sorted(kept["language_id"])
    shingles = {i: {tuple(x[k : k + 5]) for x in [texts[i].lower().split()] for k in range(max(len(x) - 4, 1))} for i in ids}
    similar = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    assert set(kept["simhash_near_dedup"]) == {i for i in ids if not any(similar(i, j) for j in ids if j < i)}
    w = words(bench)
    windows = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    dirty = {i for i in kept["simhash_near_dedup"] if any(tuple(x[k : k + 10]) in windows for x in [words(texts[i])] for k in range(len(x)))}
    assert set(kept["decontaminate"]) == set(kept["simhash_near_dedup"]) - dirty and dirty
    assert set(kept["scan_secrets"]) == set(kept["decontaminate"])
    for i, r in kept["scan_secrets"].items():
        assert r.text == secrets.redact(texts[i].encode()).decode() and r.n_chars == len(r.text)
        assert not re.search("password=", r.text)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.mix_copy, r.text) for r in out) == sorted(brute_mix(kept["scan_secrets"])) and len(out) > 10


def brute_mix(rows):
    """(id, copy, text): inverse Poisson of hashed numbers, at rates that give each source the square root of its size as weight."""
    size = Counter()
    for r in rows.values():
        size[r.source] += len(r.text)
    weights = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    for i, r in rows.items():
        rate = weights[r.source] / sum(weights.values()) * sum(size.values()) / size[r.source]
        assert rate <= mixing.MEAN  # a single draw
        u = int(hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        yield from ((i, k, r.text) for k in range(1, n + 1))


def test_stages_on_empty_and_clashing_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (empty, spark.createDataFrame([(1, "a b", "en", "s", 3, 0.5, "x"), (1, "a b", "en", "s", 3, 0.5, "x"), (None, "c", None, None, None, None, None)], SCHEMA + ", score double, component_id string")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            out.count()
            assert out.columns[: len(df.columns)] == df.columns
            df = out


INTERNAL = ["__id", "__key", "__rate", "__score", "__pred", "__n", "id", "key", "removed", "hit", "pred", "rate", "count", "salt", "cdf", "draws", "fp", "seg", "number", "gram", "size", "mark"]


def test_stages_keep_columns_of_any_name(spark, docs, texts, tmp_path):
    spark.createDataFrame([(1, texts[10])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs
    clash = docs.withColumns({c: F.lit(f"<{c}>") for c in INTERNAL})
    for name, stage in corpus_pipeline.STAGES:
        plain, clash = (materialize(stage(spark, df, str(tmp_path)), name) for df in (plain, clash))
        assert set(INTERNAL) <= set(clash.columns)
        assert clash.where(" AND ".join(f"`{c}` = '<{c}>'" for c in INTERNAL)).count() == clash.count() == plain.count()
        assert sorted(map(str, clash.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_language_id_rejects_foreign_text_and_names_languages(spark, tmp_path):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "er", "and", "th"], "de": ["sch", "ein", "ung", "der", "ich"]}
    say = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(n))
    rows = [(i, say(lang, rng.randint(1, 60)), lang if i % 10 else None, "s", 0) for i in range(300) for lang in [("en", "de")[i % 2]]]
    foreign = ["Я помню чудное мгновенье передо мной явилась ты", "ここには日本語の文章があります", "Ὦ ξεῖν ἀγγέλλειν Λακεδαιμονίοις", "12345 67890", None]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None, "s", 0) for i, t in enumerate(foreign)], SCHEMA)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert kept == {i: ("en", "de")[i % 2] for i in range(300)}


def test_run_leaves_one_table(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(paths, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [p.name for p in (tmp_path / "shared").iterdir()]
    assert len(left) == 1 and left[0].startswith("mix_sources")


def test_near_dedup_of_rows_without_id(spark, tmp_path):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " end"), (None, c), (2, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.text not in (b, b + " end")) == sorted([(1, a), (0, c), (2, "")])
    assert sum(r.text in (b, b + " end") for r in kept) == 1


def test_near_dedup_of_an_id_with_two_texts(spark, tmp_path):
    rng = random.Random(10)
    a, b = (prose(rng, 60) for _ in range(2))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(1, a), (5, a + " end"), (5, b), (6, b + " end")]], SCHEMA)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b)]
