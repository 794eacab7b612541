"""Line, substring and suffix dedup against brute force."""
import hashlib
import re

import numpy as np
import pytest

from rillmap.llm import blocks, suffix_dedup
from rillmap.llm.line_dedup import dedup_lines
from rillmap.llm.substring_dedup import LIMITS, MARGIN, SPAN, compress, dedup_substrings
from rillmap.llm.suffix_dedup import dedup_suffixes
from rillmap.llm.suffix_sort import COVER, PERIOD, equal_windows

from .conftest import corpus


def sha(data):
    return hashlib.sha256(data).hexdigest()


def windows_removed(units, size=50):
    """{row: flags} of units covered by a window that also starts in a smaller document; units is a list of (doc_id, sequence)."""
    first = {}
    for doc, seq in units:
        for j in range(len(seq) - size + 1 if doc is not None else 0):
            key = tuple(seq[j:j + size])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, seq in units:
        gone = [False] * len(seq)
        for j in range(len(seq) - size + 1 if doc is not None else 0):
            if first[tuple(seq[j:j + size])] < doc:
                gone[j:j + size] = [True] * size
        out.append(gone)
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(params=[4 << 20, 3000], ids=["one block", "many blocks"])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", request.param)
    monkeypatch.setattr(suffix_dedup, "MANY", 64 if request.param > 10_000 else 1)


def test_substrings(docs, block_bytes):
    units = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in corpus()]
    want = []
    for (d, words), gone in zip(units, windows_removed(units)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want.append((d, len(words), sum(gone), sha(kept.encode()), kept))
    got = [tuple(r) for r in dedup_substrings(docs, with_text=True).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 200


def test_suffixes(docs, block_bytes):
    units = [(d, (t or "").encode()) for d, t in corpus()]
    want = []
    for (d, data), gone in zip(units, windows_removed(units)):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(data), sum(gone), spans, sha(kept), kept))
    got = [tuple(r[:5]) + (bytes(r[5]),) for r in dedup_suffixes(docs, with_text=True).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 2000


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_lines(docs, size):
    rows = sorted({(d, t) for d, t in corpus() if d is not None and t is not None})
    first = {}
    for d, t in rows:
        lines = t.split("\n")
        for j in range(len(lines) - size + 1):
            first.setdefault(tuple(lines[j:j + size]), (d, j))
    want = []
    for d, t in corpus():
        lines = [] if t is None else t.split("\n")
        gone = [False] * len(lines)
        for j in range(len(lines) - size + 1 if d is not None else 0):
            if first[tuple(lines[j:j + size])] < (d, j):
                gone[j:j + size] = [True] * size
        kept = None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        want.append((d, len(lines), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept, t))
    found = dedup_lines(docs, size)
    assert found.columns.count("kept_text") == 1 and found.columns.count("n_removed") == 1
    got = [tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text", "text").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [2, 3])
def test_long_lines(spark, size):
    """One line of min_words words is a run of its own, whatever stands around it; one word less is not."""
    long, short = " ".join(f"w{i}" for i in range(50)), "\t ".join(f"v{i}" for i in range(49))
    rows = [(5, long), (3, long), (3, long), (4, f"own {long}"), (6, f"a\n{long}\nb"), (7, f"c\n{long}\n{long}\nd"), (8, short), (9, short), (10, f"e\n{short}\nf"), (11, "x" * 400), (12, "x" * 400),
            (13, f"{short}\ta\ne"), (14, f"g\n{short}\ta\nh"), (15, f"p\nq\nr\n{long}"), (16, f"p\nq\nr\n{long}\ns"), (None, long), (17, None), (18, "")]
    first = {}
    for d, t in sorted({r for r in rows if None not in r}):
        lines = t.split("\n")
        for j in range(len(lines)):
            for n in {1, size}:
                first.setdefault(tuple(lines[j:j + n]), (d, j))
    want = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = [False] * len(lines)
        for j in range(len(lines) if d is not None else 0):
            for n in (1, size):
                if j + n <= len(lines) and (n == size or len(lines[j].split()) >= 50) and first[tuple(lines[j:j + n])] < (d, j):
                    gone[j:j + n] = [True] * n
        kept = None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        want.append((d, len(lines), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in dedup_lines(docs, size, 50).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {d: n for d, _, n, _, _ in got if d in (5, 6, 7, 9, 12, 14)} == {5: 1, 6: 1, 7: 2, 9: 0, 12: 0, 14: 1}


def test_empty_tables(no_docs):
    assert dedup_substrings(no_docs).count() == dedup_suffixes(no_docs).count() == dedup_lines(no_docs).count() == 0


def test_only_rows_without_id(docs):
    lost = docs.where("doc_id IS NULL")
    assert [r["n_removed"] for r in dedup_substrings(lost).collect()] == [0, 0] == [r["n_removed"] for r in dedup_suffixes(lost).collect()]


def test_symbols_agree_inside_the_margins():
    rng = np.random.default_rng(5)
    for trial in range(300):
        size = int(rng.integers(1, 4)) if trial % 2 else 30
        middle = rng.integers(1, 1 + size, 50).astype(np.uint64)
        seen = []
        for _ in range(2):
            left, right = (rng.integers(1, 1 + size, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
            words = np.concatenate([left, middle, right])
            symbol, start = compress(words, np.zeros(len(words), np.int64))
            stop = np.append(start[1:], len(words))
            inside = (start >= len(left) + MARGIN) & (stop <= len(left) + 50 - MARGIN)
            assert (stop - start).max() <= LIMITS[-1] and inside.sum() >= SPAN
            seen.append((symbol[inside].tolist(), (start[inside] - len(left)).tolist()))
        assert seen[0] == seen[1]


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_equal_windows_small_blocks(monkeypatch):
    from rillmap.llm import suffix_sort
    monkeypatch.setattr(suffix_sort, "BLOCK", 64)
    rng = np.random.default_rng(3)
    for trial in range(40):
        text = rng.integers(97, 97 + 1 + trial % 4, rng.integers(50, 900)).astype(np.uint8)
        text = np.concatenate([text, text[:120], text])
        at = np.flatnonzero(rng.random(len(text) - 49) < 0.7)
        want = {}
        for p in at.tolist():
            want.setdefault(text[p:p + 50].tobytes(), []).append(p)
        got = {text[at[g[0]]:at[g[0]] + 50].tobytes(): sorted(at[g].tolist()) for own, first in equal_windows(text, at, 50) for g in np.split(own, first[1:]) if len(g) > 1}
        assert got == {k: v for k, v in want.items() if len(v) > 1}


def test_substrings_of_words_with_equal_polynomials(spark):
    """Two Thue-Morse words agree in every polynomial modulo 2^64; only real repeats may go."""
    common = " ".join(f"w{i}" for i in range(49))
    rows = []
    for n in (1024, 2048):
        x, y = ("".join("ab"[bin(i).count("1") % 2 ^ f] for i in range(n)) for f in (0, 1))
        rows += [(n, f"{common} {x}"), (n + 1, f"{common} {y}"), (n + 2, f"{common} {y} z")]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1024: 0, 1025: 0, 1026: 50, 2048: 0, 2049: 0, 2050: 50}


def test_stretches_that_stand_alone_are_not_sorted(spark, monkeypatch):
    """Only stretches whose gram has another one reach the suffix buckets, however many blocks hold the gram; whole copies are known without a sort. Runs are found twice, not in every pass."""
    import numpy as np
    import pyarrow as pa
    entries = {"keys": [(7 << 32) + 1, (7 << 32) + 1, (7 << 32) + 2, (9 << 32) + 5], "more": [1, 1, 1, 1], "docs": [4, 3, 5, 6]}
    table = pa.table({k: [np.array(v, {"keys": "<u8", "more": "<u4", "docs": "<i8"}[k]).tobytes()] for k, v in entries.items()})
    assert list(suffix_dedup._later(10)(table)[0]) == [3, 2, 2, 0] and list(suffix_dedup._later(1)(table)[0]) == [7, 6, 6, 0]
    edges = blocks.bucket_edges(np.array([5 << 32, (5 << 32) + 7, (1 << 63) + 3, (1 << 64) - 1], np.uint64), 3)
    assert [(b, a, z) for b, a, z in edges] == [(0, 0, 2), (1, 2, 3), (2, 3, 4)]
    assert not any(t % (1 << 32) for b in (3, 7, 1500) for t in [-(-(i << 32) // b) << 32 for i in range(1, b)])
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    own, begin, windows = np.frombuffer(text[:200] + text[500:640] + text[100:160], np.uint8), np.array([0, 200, 340]), np.array([151, 91, 11])
    left, places, at = suffix_dedup._candidates(own, begin, windows)
    assert places.tolist() == [0, -1, 200] and len(left) == 260 and at.tolist() == [*range(100, 111), *range(200, 211)]
    block = blocks.Block(0, np.array([9, 4]), np.array([0, 2000]), np.array([2000, 4000]), np.frombuffer(text, np.uint8), {})
    runs = suffix_dedup._runs(block, True)
    again = suffix_dedup._read(np.frombuffer(suffix_dedup._written(block, runs), np.uint8))
    assert all((getattr(again, f) == (block.doc_ids[runs.doc] if f == "doc" else getattr(runs, f))).all() for f in suffix_dedup._KINDS)
    plans, run = [], blocks.Blocks.run
    monkeypatch.setattr(blocks.Blocks, "run", lambda self, *a: plans.append(run(self, *a)) or plans[-1])
    docs = spark.createDataFrame([(i, text.decode()[i * 100:i * 100 + 700]) for i in range(20)], "doc_id long, text string")
    assert [r["n_removed"] for r in sorted(dedup_suffixes(docs).collect())] == [0] + [600] * 19
    assert len(plans) == 4
