import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, node long, size long"


def build(seed=5, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "re", "th", "on", "ti", "es", "la")) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(n)]
    shared = " ".join(word() for _ in range(55))
    near = " ".join(word() for _ in range(80)).split(" ")
    for i in range(70):  # a crowded group: some near each other, some not quite
        t = list(near)
        for _ in range(r.choice((0, 1, 2, 3))):
            t[r.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [texts[0]] * 6 + [texts[1].upper()] + [f"{word()} {word()} {shared}" for _ in range(30)]
    texts += ["", None, "  \n\t", "one two", "ONE two", "one\x0btwo", "...", "1 2 3", "é" * 50, "long " + " ".join(word() for _ in range(6000))]
    texts += ['mail a.b@c.example.org or 1.2.3.4 password = "abcdefghijkl99"', "call +1 (017) 555-7713 card 4111 1111 1111 1111\nline one\nline one\n", "w " * 30]
    rows = [(i, t, r.choice(("en", "fr", None)), r.choice(("a", "b", "b", "b", "c", None)), len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], None, "a", 3, None, None)]


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KINDS)
