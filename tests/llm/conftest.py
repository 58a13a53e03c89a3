"""Small tables with everything that may go wrong in a column."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, row string, _id int"


def rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Öl", "über", "日本", "the", "of", "###"]
    base = " ".join(rng.choice(words) for _ in range(60))
    texts = [
        base, base, base.replace("alpha", "omega", 1), None, "", "   \n\t ", "a", "one two three",
        "x" * 5000, "word " * 3000, base + "\n" + base, "🙂 <s> ▁ \u0000 <|endoftext|> <0x41>", base.upper(),
        " ".join(rng.choice(words) for _ in range(4000)), "!!! ??? ###", "line\n" * 40,
    ]
    out = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t or ""), 0.5, 1, "r", 3) for k, t in enumerate(texts)]
    out += [out[0], out[3], (1, "another text of the same id", "de", "s", 27, None, None, None, None)]
    return out + [(None, base, "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
