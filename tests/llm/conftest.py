import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, component string, anchor string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=1):
    """Nulls, empty and long texts, copies, near copies, repeated rows and lines, odd characters."""
    rng = random.Random(seed)
    base = "\n".join(words(rng, 30) for _ in range(8))
    near = base.replace("w1 ", "v1 ", 2)
    shared = words(rng, 60)
    texts = [
        None, "", " ", "\n\n", "one", "two words", base, base, near, base.upper(), shared, words(rng, 20) + "\n" + shared + "\n" + words(rng, 20), shared + "\n" + words(rng, 5),
        words(rng, 6000), "\n".join(["a line that repeats itself with ten words or more here"] * 5), "ünïcödé text \U0001f600 " * 30, "x" * 3000, "\t\v\f\r mixed \x1c separators here",
        words(rng, 12) + "\r\n" + words(rng, 12), "Released under the MIT License.\n" + words(rng, 30), shared.replace("w", "W"), "0 1 2 3 " * 50,
    ]
    rows = [(i * 3, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 7, "id", "c", "a") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, "a text without an id, but with words enough to be of some use to the operators", "en", "s1", 10, 7, "id", "c", "a"))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
