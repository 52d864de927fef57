import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _id long"


@pytest.fixture(scope="session")
def texts():
    """Texts of many kinds: null, empty, blank, one word, copies, near copies, very long, odd characters."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "naïve", "straße", "of", "the", "a", "1984", "x1", "日本"]
    out = [None, "", "  \t\n ", "word", "two words", "Three Words Here", "a\x1cb \x85c d"]
    for _ in range(30):
        out.append(" ".join(rng.choices(words, k=rng.choice([4, 12, 60, 150]))))
    out += out[7:12]
    out += [t + " end" for t in out[12:16]]
    out.append(" ".join(rng.choices(words, k=20_000)))
    out.append("x" * 60_000)
    out.append("line one here\n" * 40)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts with null and repeated ids, null sources, a hot source, and columns whose names clash."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((None if i == 20 else i, t, "en", None if i % 11 == 0 else ["hot", "hot", "b", "c"][i % 4], len(t or ""), "clash", 7))
    rows.append(rows[9])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
