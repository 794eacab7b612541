"""The Jaccard join against all pairs, and connected components."""
import random
import re

import numpy as np
import pytest

from rillmap.llm import near_duplicates as module
from rillmap.llm.components import components
from rillmap.llm.near_duplicates import matching_depth, near_duplicates

from .conftest import SCHEMA, corpus, prose


def brute(rows, threshold=0.8, size=5):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(size, len(w))
        if d is not None:
            sets[d] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if k else frozenset()
    names, links, copies = {d: d for d in sets}, dict.fromkeys(sets, 0), [d for d, _ in rows if d is not None]
    order = sorted(sets)

    def find(x):
        return x if names[x] == x else find(names[x])

    for i, a in enumerate(order):
        for b in order[i:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += copies.count(b) - (a == b)
                links[b] += copies.count(a) if a != b else 0
                x, y = find(a), find(b)
                names[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def group(n, seed, edits):
    """``n`` texts that differ from one text in a few words each."""
    base, rng = prose(seed, 220).split(), random.Random(seed)
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [256, 7])
def test_join(spark, docs, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "COLUMNS", 64)
    rows = corpus() + [(100 + i, t) for i, t in enumerate(group(40, 8, 9))] + [(200 + i, t) for i, t in enumerate(group(12, 9, 3))]
    wide = spark.createDataFrame([(d, t, *[None] * 10) for d, t in rows], SCHEMA).repartition(3)
    found = near_duplicates(wide).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found if r["doc_id"] is not None}
    assert sum(r["class_id"] is None for r in found) == 2
    assert got == want


def test_nothing(no_docs, docs):
    assert near_duplicates(no_docs).count() == 0
    assert [r["n_links"] for r in near_duplicates(docs.where("doc_id IN (1, 2, 4)")).collect()] == [0, 0, 0]


def test_depth_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        d = matching_depth(threshold, recall=0.99)
        assert d == 1 or 1 - (1 - threshold ** d) ** module.TREES >= 0.99
        assert d == module.MOST_DEPTH or 1 - (1 - threshold ** (d + 1)) ** module.TREES < 0.99


def test_recall_of_the_forest(spark):
    """Pairs just above the threshold are found: at least 99 of 100 on average."""
    rng, rows = random.Random(4), []
    for i in range(150):
        words = [f"{rng.randrange(10**6)}" for _ in range(304)]
        other = list(words)
        for at in rng.sample(range(10, 290, 7), 6):
            other[at] = "x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert brute(rows[:40])[1] == (0, 1)
    assert found >= 0.99 * len(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]
    got = module._overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)
