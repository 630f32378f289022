import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket long, id long"
WORDS = ["the", "of", "lorem", "dolor", "amet", "tion", "under", "wood", "über", "straße", "été", "niño", "42", "x.y", "don't"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in each column, empty and very long texts, equal texts and rows, a hot source, columns of clashing names."""
    rng = random.Random(7)
    rows = []
    for i in range(90):
        rows.append((i, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", i, "k", i, i))
    long = sentence(rng, 30_000)
    words = rows[5][1].split() + sentence(rng, 60).split()
    near = words.copy()
    near[10] = "changed"
    extra = [None, "", " \n ", long, "SAME text Ä here ok", "same TEXT Ä here ok", "same text ä here ok", "same text Ä here ok", " ".join(words), " ".join(near), "a\u0301 b  c\t\u00a0d<|endoftext|>"]
    rows += [(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(extra)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
