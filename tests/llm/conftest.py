import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_words long, score double, block long, bucket int, label string, class_id long"


def prose(seed, n, words=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(rng.choice(pool))
        out.append(rng.choice([" ", " ", " ", " ", "  ", "\n", ". ", "\t"]))
    return "".join(out)


def corpus():
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, runs of one word, repeated rows and rows without id."""
    base, other, long = prose(1, 150), prose(2, 120), prose(3, 20_000, 4000)
    words = base.split(" ")
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(words))
    passage = prose(4, 70, 200)
    return [
        (11, base), (3, near), (7, base), (5, other + passage), (9, passage + "\n" + prose(5, 40)), (12, long), (13, long[:40_000]), (1, None), (2, ""),
        (4, "   "), (6, "word"), (8, "a " * 120), (10, "b b a a " + "a " * 90 + "c"), (14, "x" * 400), (15, "y" + "x" * 200), (16, "été ça où " * 30),
        (17, "zwei drei " + "été ça où " * 20), (20, other), (20, other), (21, "same line\nnext line\nthird"), (22, "first\nsame line\nnext line\nsame line\nnext line"),
        (None, base), (None, None), (-3, passage), (23, "日本語のテキスト" * 20),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("fr" if t and "é" in t else "en"), "s", 0, "clash", -1, -1.0, -1, -1, "clash", -1) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
