import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, kept string, score string, sha string, rank string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(3)
    base, shared = words(rng, 120), words(rng, 60)
    texts = {i: words(rng, rng.randrange(1, 90)) for i in range(40)}
    texts |= {40: base, 41: base, 42: base.upper(), 43: base + " tail", 44: "start " + base, 45: base.replace("alpha", "omega", 1)}
    texts |= {46: words(rng, 30) + " " + shared + " " + words(rng, 20), 47: words(rng, 10) + shared + words(rng, 5), 48: shared}
    texts |= {49: "", 50: None, 51: " \n\t ", 52: "É" * 150, 53: "a" * 400, 54: "ab" * 300, 55: words(rng, 20_000), 56: "one", 57: "one two three", 58: "🎉 " * 60, 59: "12 34 ..."}
    out = []
    for i, t in texts.items():
        lang = None if i % 9 == 0 else ["en", "fr"][i % 2]
        source = None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}"
        out.append((i, t, lang, source, None, "x", None, "y", "z", "q"))
    out += [out[3], out[40], out[40], out[55]]  # repeated rows
    out += [(None, base, "en", "hot", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (7, "other text of the same id", "fr", "hot", 1, None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
