"""Spelling variants against all pairs of words."""
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmap.llm.registry import QUERIES
from rillmap.llm.spelling import LOWER, UPPER, near_words, occurrences, signed, spelling_variants

from .conftest import SCHEMA, corpus

FLAT = str.maketrans(UPPER, LOWER)


def brute_words(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(FLAT)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(count):
    near = {w: [o for o in count if one_edit(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abéß") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    extra = [(1000 + i, " ".join(rng.choice(base).title() for _ in range(60))) for i in range(60)]
    rows = corpus() + extra + [(2000, None), (2001, "ab" * 40_000 + " " + "ab" * 40_000), (2002, "ab" * 40_000)]
    spark.createDataFrame([(d, t, *[None] * 10) for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_forms(brute_words(rows))
    got = found(QUERIES["op12_spelling_variants"](spark, str(tmp_path)))
    assert got == want and sum(v[0] is not None for v in want.values()) > 3


def test_every_edit_is_found(spark):
    """All words at distance one of a few words over a small alphabet, with chains of forms and ties."""
    words = set()
    for w in ("aabbab", "ababababab", "éaébé", "aaaaa", "abcdefghijk"):
        words |= {w} | {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in "abé" for k in (0, 1)}
    count = {w: 3 + len(w) % 3 * 7 + (w.count("b") ** 3) for w in sorted(words) if len(w) >= 5}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert found(spelling_variants(df)) == brute_forms(count)


def test_chain_of_forms(spark):
    chain = [("a" * i + "bcdefg"[:6], 3 * 2 ** i) for i in range(20)]
    got = found(spelling_variants(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in got.values()} == {chain[-1][0]} and got[chain[-1][0]][0] is None


def test_pivots_do_not_overlap_and_are_rarest(spark):
    words = spark.createDataFrame([(w, 3) for w in ("abcde", "abcdeab", "zzzzzz", "ababab", "edcba", "cdcdcdcd")], "word string, n long")
    for r in signed(words).collect():
        a, b = r["pivots"]
        pairs = [(x["c"] + y["c"]) for x in r["prefix"] for y in r["prefix"] if y["p"] - x["p"] >= 2]
        assert b["p"] - a["p"] >= 2 and a["c"] + b["c"] == min(pairs)


@settings(max_examples=200)
@given(st.text("abc", min_size=5, max_size=9), st.text("abc", min_size=5, max_size=9))
def test_one_edit_agrees_with_a_table(a, b):
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, table[0] = table[0], i
        for j, y in enumerate(b, 1):
            last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
    assert one_edit(a, b) == (table[-1] == 1)


def test_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).count() == 0 and near_words(none).count() == 0
    words = spark.createDataFrame([("abcde",), (None,), ("abcde",), ("ab",)], "word string")
    assert [tuple(r) for r in occurrences(words, 2).collect()] == [("abcde", 2)]
    assert [r["root"] for r in spelling_variants(occurrences(words, 2).withColumn("n", F.col("n"))).collect()] == ["abcde"]
