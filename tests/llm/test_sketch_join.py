"""Components by sketches against all pairs of sets."""
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmap.llm import sketch_join as module
from rillmap.llm.registry import QUERIES
from rillmap.llm.sketch_join import estimate, estimates, linked, meet, posting_keys, sketch_components

from .conftest import SCHEMA, corpus, prose

FLAT = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """One entry per row with an id: (doc_id, n_shingles, component_id, kept)."""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FLAT))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w)))
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def hard():
    """A hub whose copies are near to it but not to each other, a chain, small sets around the limits, one text under two ids and one id on two texts."""
    rng = random.Random(9)
    hub = [f"h{i}" for i in range(101)]
    rows = [(500, " ".join(hub))]
    for i in range(90):
        own = list(hub)
        for at in rng.sample(range(1, 100, 2), 5):
            own[at] = f"n{rng.randrange(10**6)}"
        rows.append((501 + i, " ".join(own)))
    step = [f"c{i}" for i in range(80)]
    for i in range(20):
        step[3 * i % 80] = f"d{i}"
        rows.append((700 + i, " ".join(step)))
    for n in range(1, 14):
        text = [f"s{n}x{i}" for i in range(n)]
        rows += [(800 + 10 * n, " ".join(text)), (801 + 10 * n, " ".join(text + ["y"])), (802 + 10 * n, " ".join(["z"] + text + ["y"])), (803 + 10 * n, " ".join(text).upper())]
    common = [f"k{i}" for i in range(12)]
    rows += [(1000 + i, " ".join(rng.sample(common, 9))) for i in range(60)]
    return rows + [(1100, prose(50, 90)), (1100, prose(51, 90)), (1101, prose(51, 90)), (1102, None), (1103, " \n\t"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("short", [64, 4])
def test_query(spark, tmp_path, monkeypatch, short):
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "STAR", 8)
    monkeypatch.setattr(module, "SHORT", short)
    rows = corpus() + hard()
    spark.createDataFrame([(d, t, *[None] * 10) for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_sketch_components"](spark, str(tmp_path)).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(rows)
    assert sorted(r for r in got if r[0] is None) == [(None, 0, None, True), (None, 0, None, True), (None, 1, None, True), (None, len(set(zip(*[corpus()[0][1].split()[k:] for k in (0, 1)]))), None, True)]


def test_nothing(spark, no_docs):
    assert sketch_components(no_docs).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, text string")
    assert sorted(map(tuple, sketch_components(few).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_words_that_collide_in_polynomials_differ(spark):
    """Thue-Morse words have equal polynomial fingerprints modulo 2^64; the texts share no shingle."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    docs = spark.createDataFrame([(1, f"{x} {y} {x}"), (2, f"{y} {x} {y} {y}"), (3, x), (4, y)], "doc_id long, text string")
    assert {r["component_id"] for r in sketch_components(docs).collect()} == {1, 2, 3, 4}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=4, max_size=60), st.data())
def test_near_sets_share_a_list(a, data):
    """Sets that fit into their sketches and share four fifths always meet."""
    pool = sorted(a)
    gone = data.draw(st.sets(st.sampled_from(pool), max_size=max(0, len(pool) // 5)))
    new = data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=len(pool) // 5))
    b = (a - gone) | new
    if 100 * len(a & b) >= 80 * len(a | b) and a != b and len(b) <= module.K:
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert np.intersect1d(posting_keys(x), posting_keys(y)).size
        assert abs(estimate(x, y) - len(a & b) / len(a | b)) < 1e-12


def test_large_sets_share_a_list_and_estimates_hold():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(80, 3000))
        common, own = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64) * np.uint64(2)
        a = np.unique(np.concatenate([common, own[:n // 8]]))
        b = np.unique(np.concatenate([common, own[n // 8:n // 4]]))
        assert np.intersect1d(posting_keys(a[:module.K]), posting_keys(b[:module.K])).size
        assert estimate(a[:module.K], b[:module.K]) > 0.8 - module.MARGIN


def test_links_of_a_block():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    near = linked(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert near[i, j] == (100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)))


@settings(max_examples=300, deadline=None)
@given(st.integers(9, 60), st.data())
def test_sets_above_the_tiny_share_several_lists(size, data):
    """Near sets that fit into their sketches share ``COVER`` lists, wherever the values lie that only one of them has."""
    u = data.draw(st.integers(size, min(module.K, size * 5 // 4)))
    gone = data.draw(st.sets(st.integers(0, u - 1), min_size=u - size, max_size=u - size))
    a, b = np.array([i for i in range(u) if i not in gone], np.uint64), np.arange(u, dtype=np.uint64)
    assert 100 * len(a) >= 80 * u and np.intersect1d(posting_keys(a), posting_keys(b)).size >= module.COVER


def test_estimates_of_a_list_equal_counts_within_the_shorter_reach():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 300), replace=False))[:module.K] for _ in range(30)]
    got = estimates(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            ends = [s[-1] for s in (a, b) if len(s) == module.K]
            x, y = ({v for v in s.tolist() if not ends or v <= min(ends)} for s in (a, b))
            assert got[i, j] == pytest.approx(len(x & y) / max(1, len(x | y)))


def test_lists_over_batches(spark, monkeypatch):
    """Lists of one to five members, cut by batches of three rows, give every pair of theirs once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        own = np.arange(20, dtype=np.uint64).tobytes()
        rows = [(k, 100 * (k % 7) + i, 20 if i else 26, i, own) for k in range(40) for i in range(k % 5 + 1)]
        got = meet(spark.createDataFrame(rows, "key long, node long, n long, part long, sketch binary").repartition(4), 0.5, 80).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(x, y) for k in range(40) for x in range(100 * (k % 7) + 1, 100 * (k % 7) + k % 5 + 1) for y in range(100 * (k % 7) + 1, x)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
