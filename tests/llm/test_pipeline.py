"""The corpus pipeline against a brute-force version, and the registry."""
import re

import __spark_entry__ as entry
import corpus_pipeline as pipeline

from .conftest import SCHEMA, corpus
from .test_near_duplicates import brute
from .test_text_models import brute_hits


def test_registry():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and {"op1_line_dedup", "op9_exact_top_k"} <= set(entry.oracle_sql())


def kept_by_hand(rows, items):
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    first = {}
    for d, t in sorted({r for r in rows if r[0] is not None}):
        lines = t.split("\n")
        for j in range(len(lines) - 1):
            first.setdefault((lines[j], lines[j + 1]), (d, j))
    after = []
    for d, t in rows:
        lines = t.split("\n")
        gone = set()
        for j in range(len(lines) - 1 if d is not None else 0):
            if first[lines[j], lines[j + 1]] < (d, j):
                gone |= {j, j + 1}
        if len(gone) < len(lines):
            after.append((d, "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    classes = brute(after)
    once = {}
    for d, t in after:
        if d is not None and classes[d][0] == d:
            once[d] = t
    stays = list(once.items()) + [(d, t) for d, t in after if d is None]
    return [(d, t) for (d, t), hit in zip(stays, brute_hits(stays, items)) if not hit[4]]


def test_pipeline(spark, docs, tmp_path):
    folder = str(tmp_path)
    texts = dict(corpus())
    items = [(1, " ".join(texts[20].split()[:60])), (2, "word")]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        new = stage(spark, now, folder)
        assert new.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        new.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    want = kept_by_hand(corpus(), items)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=key) == sorted(want, key=key) and len(want) > 8
    packed = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in want}


def test_empty(spark, no_docs, tmp_path):
    folder = str(tmp_path)
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert pipeline.run(spark, folder).count() == 0


def test_repeated_ids_and_own_columns_stay(spark, tmp_path):
    """Two unrelated texts of one doc_id both stay, and columns named like those of an operator keep values and types."""
    folder = str(tmp_path)
    texts = {k: " ".join(f"{k}{i}" for i in range(30)) for k in ("ab", "cd", "ef", "gh")}
    rows = [(1, texts["ab"]), (1, texts["cd"]), (2, texts["cd"]), (3, texts["ef"]), (3, texts["ef"]), (2, texts["gh"]), (4, texts["ab"] + "\nmore")]
    named = {"lang_pred": "x", "score": 42.0, "kept_text": "own", "n_lines": "seven", "n_runs": -1, "n_words": -7, "items": "none", "word_spans": 3, "class_key": 5, "text_hash": "h", "whole_row": 9}
    docs = spark.createDataFrame([(d, t, "xx", *named.values()) for d, t in rows], ["doc_id", "text", "lang", *named])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        assert now.dtypes == docs.dtypes
        assert all({k: r[k] for k in named} == named for r in now.collect())
    assert sorted((r["doc_id"], r["text"][:2]) for r in now.collect()) == [(1, "ab"), (1, "cd"), (2, "gh"), (3, "ef")]


def test_long_lines_leave(spark, tmp_path):
    """An exact copy of a one-line document leaves in the stage line_dedup, and so does a long line between lines of its own."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long), (1, long), (3, f"a\n{long}\nb"), (4, "short line"), (5, "short line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == {1: long, 3: "a\nb", 4: "short line", 5: "short line"}
