import random

import pytest

WORDS = "the of and river stone light under over green small house turning every window along bright morning cold paper garden".split()


def prose(seed, n):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + (g.choice("abcdefgh") if g.random() < 0.7 else "") + ("." if g.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source, n_chars and clashing columns: nulls, empties, ties, repetitions, near copies, long texts."""
    base = prose(1, 300).split()
    near = base[:]
    near[10], near[200] = "changed", "twice"
    shared = prose(2, 40)
    rows = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, "  \n\t "),
        (7, "word"),
        (8, "Word"),
        (9, "one two three"),
        (10, prose(3, 5000) + "\n" + shared),
        (11, shared + " " + prose(4, 100)),
        (12, "x y " * 60),
        (13, "été naïve Straße 東京 don't <|endoftext|> 42 ½ İΣ \x1c a"),
        (None, prose(5, 50)),
        (None, prose(5, 50)),
        (None, None),
        (14, prose(6, 30)),
        (14, prose(7, 30)),
        (15, prose(8, 25)),
        (15, prose(8, 25)),
        (16, prose(8, 25).upper()),
        (17, "one  two\tthree"),
    ]
    return [(i, t, "en", "s", len(t or ""), 0, "k", 1.0) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _k string, score double"
    return spark.createDataFrame(odd_rows, names).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
