"""M-tree search against a full scan."""
import math

import numpy as np
import pytest

from rillmap.llm import metric_tree
from rillmap.llm.metric_tree import build, exact_top_k, search

from pyspark.sql import functions as F


def scan(rows, k):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 100 == 0:
            own = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(own)}
    return out


@pytest.mark.parametrize("rows_per_tree", [16_384, 50])
def test_search(spark, monkeypatch, rows_per_tree):
    monkeypatch.setattr(metric_tree, "TREE_ROWS", rows_per_tree)
    monkeypatch.setattr(metric_tree, "PAGE", 8)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(0, 800, 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]                      # a tie that fills many pages
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [math.nan] * 6), (2300, [math.inf] * 6), (2400, [1.0, 2.0]), (2401, [3.0, 4.0]), (2500, []), (None, [0.0] * 6),
             (2600, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    got = [tuple(r) for r in exact_top_k(table.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10).collect()]
    assert set(got) == scan(rows, 10) and len(got) == len(set(got))
    assert exact_top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows(spark):
    rows = [(100, [1.0, 0.0])] * 2 + [(1, [2.0, 0.0])] * 2 + [(2, [1.0, 5.0])]
    got = sorted(tuple(r) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 2).collect())
    assert got == [(100, 1, 1, 2 * 1024 * 1024), (100, 2, 1, 2 * 1024 * 1024)]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 4000
    vectors = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 50)
    ids = rng.permutation(3000)
    top, pages = build(ids, vectors)
    for q in range(0, 3000, 150):
        own, scores = search(top, pages, int(ids[q]), vectors[q], 10)
        product = vectors @ vectors[q]
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -product[keep]))[:10]
        assert own.tolist() == ids[keep][order].tolist() and scores.tolist() == product[keep][order].tolist()
