import random

import pytest

from strandmark.llm import segments

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "tion", "er", "on", "an", "re", "and", "ñe", "ü", "Is", "a", "q", "x"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(autouse=True)
def narrow(monkeypatch):
    """Small tables need few nodes; a test that asks for another fan sets its own."""
    monkeypatch.setattr(segments, "FAN", 8)


@pytest.fixture(scope="session")
def texts() -> list:
    """Whole range of cases: null, empty, blank, copies, near copies, repeats, very long, no letters."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(3, 400)) for _ in range(60)]
    passage = prose(rng, 80)
    out = [None, "", " \n\t ", "...", "\x00\x00", "one", "a b c", *base]
    out += base[:15] + [b.replace("the", "The") for b in base[15:20]]
    out += [b + " extra words" for b in base[20:30]]
    out += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 20) for _ in range(12)]
    out += ["word " * 300, "a line that repeats\n" * 40, "ab" * 400, prose(rng, 9000), "ÀÉ 漢字漢字 ß ﬁ \U0001f600 " * 30]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
