"""Token files and packing: exact round trips and bounds."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmap.llm.packing import Capacity, best_fit, best_fit_packing
from rillmap.llm.token_files import DirectCodes, token_at, token_files
from rillmap.llm.tokens import encode_documents, encoder

from .conftest import corpus


def plain(vocabulary, text):
    from tokenizers import Tokenizer
    held = plain.__dict__.setdefault("held", Tokenizer.from_file(vocabulary))
    return [*held.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,!' \n\t\x1c\x85é日1 <|endoftext>"), max_size=30), max_size=6))
def test_encoder_equals_library(texts):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert [x.tolist() for x in encode_documents(path, texts)] == [plain(path, t) for t in texts]


def test_encoder_forgets(vocabulary):
    for _, text in corpus():
        assert next(encode_documents(vocabulary, [text], most_words=3)).tolist() == plain(vocabulary, text)
    assert len(encoder(vocabulary, 3).known) < 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300))
def test_direct_codes(ids):
    codes = DirectCodes.from_row(DirectCodes.encode(np.array(ids, np.uint32)).to_row())
    assert codes.all().tolist() == ids
    at = np.arange(len(ids))[::-2]
    assert codes[at].tolist() == [ids[i] for i in at]


def expected(vocabulary):
    rows, start = [], 0
    for d, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(vocabulary, t)
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_files(docs, no_docs, vocabulary, monkeypatch):
    want = expected(vocabulary)
    assert sorted(map(tuple, token_files(docs, vocabulary).collect()), key=lambda r: r[1]) == want
    from rillmap.llm import token_files as module
    monkeypatch.setattr(module, "SEGMENT_IDS", 500)
    assert sorted(map(tuple, token_files(docs, vocabulary).collect()), key=lambda r: r[1]) == want
    assert token_files(no_docs, vocabulary).count() == 0


def test_random_access(spark, docs, vocabulary, tmp_path):
    from rillmap.llm.token_files import write_token_files
    path = str(tmp_path / "files")
    write_token_files(docs.where("doc_id = 5"), path, vocabulary)
    ids = plain(vocabulary, dict(corpus())[5])
    part = spark.read.parquet(path).first()["part"]
    asked = spark.createDataFrame([(part, 0, p) for p in (0, 7, len(ids) - 1)], "part int, seq long, place long")
    assert {r["place"]: r["token_id"] for r in token_at(spark, path, asked).collect()} == {p: ids[p] for p in (0, 7, len(ids) - 1)}


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity.tokens and len(own) <= capacity.documents and sum(r["length"] ** 2 for r in own) <= capacity.attention
    return len(by)


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(rule="dot"), Capacity(256, 3, 40_000)])
def test_packing(docs, vocabulary, capacity):
    rows = best_fit_packing(docs, vocabulary, capacity, with_ids=True).collect()
    n = check_sequences(rows, capacity)
    total = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert r["length"] == capacity.piece or r["piece"] == 0
        total[r["doc_id"]] = total.get(r["doc_id"], []) + ids.tolist()
    texts = dict(corpus())
    for d in (12, 13, 1, 2, 6):
        assert total[d] == plain(vocabulary, texts[d])
    if capacity.documents == 1024:
        assert n <= sum(r["length"] for r in rows) / capacity.tokens + 2


def test_packing_empty(no_docs, vocabulary):
    assert best_fit_packing(no_docs, vocabulary).count() == 0


def test_best_fit_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1025, 4000)
    bins, offset = best_fit(sizes, Capacity())
    assert np.bincount(bins, sizes).max() <= 1024 and bins.max() + 1 <= np.ceil(sizes.sum() / 1024) * 1.02
    assert ((offset >= 0) & (offset + sizes <= 1024)).all()
