import random

import pytest

WORDS = "the of and er in on that is hend nter Ouin thre é für niño Straße eau ch. lle, ob".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, norm string, words int, fp int, id int, key string, leaf int, row int, k1 int, line int, pos int, t string"


def prose(rng, n, line=14):
    words = [rng.choice(WORDS) + rng.choice(["", "a", "tion", "x", "y", "z", "qu"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def texts(seed=3, n=70):
    """Ordinary texts with exact and near copies, ties, and odd ones: null, empty, blank, very long."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(3, 120)) for _ in range(n)]
    for i in range(0, n // 3):
        words = out[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words) if i % 2 else out[i])
    out += [None, None, "", " \t\n ", "x", "one two", "a" * 60_000, "7" * 30_000, "word " * 20_000, "ab  cd", "ab\ncd", "ab cd", "+" * 5000, "@" * 5000 + "a@b.c", "\n" * 3000]
    return out


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(i, t, "en", "s", len(t or ""), *["clash"] * 2, 1, 1, 1, "k", 1, 1, 1, 1, 1, "t") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "no id at all here", None, None, None, *[None] * 12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 4 != 0, i % 5 == 0, None) for i in range(60)], "doc_id long, quality boolean, toxic boolean, text string").selectExpr("doc_id", "int(quality) AS quality", "int(toxic) AS toxic", "text")
