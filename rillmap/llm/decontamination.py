"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents. Words that no benchmark window holds end a stretch, and a stretch shorter than the shortest window can hold no
occurrence, so the index is built over the other stretches only, separated by a symbol that never matches. All windows of the benchmark are searched
backwards at once through wavelet ranks, occurrences are located by sampled suffix positions, and their word spans are merged per document.

Words are taken from the text with A-Z lowered: runs of 0-9, a-z and non-ASCII characters. A window is ``WINDOW`` consecutive words of an item; an item of
fewer words, but not none, is one window. The benchmark is read in blocks of about ``BLOCK_BYTES`` of text; each block is one more pass over the
documents that adds its spans and items to those found before, so only a block is ever sent to the tasks. Nothing is shuffled.

Null texts have no words. Items without id or words take no part; rows that repeat an item count once. Null and repeated ``doc_id`` rows are documents.
"""
from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.fm_index import FMIndex
from rillmap.llm.tokens import pieces

WINDOW = 13
BLOCK_BYTES = 8 << 20
FOUND = "n_words long, word_spans array<struct<start: long, stop: long>>, items array<string>"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Phrases:
    """The windows of one block of items: symbols of words (from 1), windows by length, and the items of each window."""

    symbol: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
        symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            own = [symbol.setdefault(w, len(symbol) + 1) for w in words(text)]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                owners[tuple(own[i:i + size])].add(item)
        by_size: dict[int, list] = defaultdict(list)
        for w in owners:
            by_size[len(w)].append(w)
        return cls(symbol, {n: np.array(ws, np.int64) for n, ws in by_size.items()}, {n: [sorted(owners[w]) for w in ws] for n, ws in by_size.items()})


def _stretches(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and for all stretches in a row, each followed by a separator: symbol, text and word position."""
    least = min(phrases.windows, default=math.inf)
    sizes, kept = np.zeros(len(texts), np.int64), []
    for first, group in pieces(texts):
        found = list(map(words, group))
        n = np.fromiter(map(len, found), np.int64, len(found))
        sizes[first:first + len(group)] = n
        code = np.fromiter((c for ws in found for c in map(phrases.symbol.get, ws, repeat(0))), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(group)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        inside = code > 0
        opens = np.flatnonzero(inside & ~(np.concatenate([np.zeros(min(1, len(code)), bool), inside[:-1]]) & (place > 0)))
        closes = np.flatnonzero(inside & ~np.concatenate([inside[1:] & (place[1:] > 0), np.zeros(min(1, len(code)), bool)])) + 1
        long = closes - opens >= least
        a, size = opens[long], (closes - opens)[long]
        take = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        stops = np.cumsum(size)
        kept.append([np.insert(x, stops, fill) for x, fill in ((code[take], 0), (owner[take] + first, -1), (place[take], -1))])
    return sizes, *(np.concatenate(x) if kept else np.zeros(0, np.int64) for x in (zip(*kept) if kept else [(), (), ()]))


def occurrences(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """Words per text, and per window length the text, word position and window number of every occurrence."""
    sizes, code, owner, place = _stretches(texts, phrases)
    found = []
    if len(code):
        index = FMIndex(code, len(phrases.symbol) + 1)
        for n, patterns in phrases.windows.items():
            low, high = index.count(patterns)
            count = np.maximum(0, high - low)
            rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = index.locate(rows)
            found.append((owner[at], place[at], np.repeat(np.arange(len(patterns)), count), n))
    return sizes, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, phrases: Phrases, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    seen = "word_spans" in docs.columns
    types = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{n}` {types[n]}" for n in keep), FOUND])
    schema = arrow_schema(ddl)
    names = docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            sizes, found = occurrences(batch.column(names.index("text")).to_pylist(), phrases)
            spans, items = defaultdict(list), defaultdict(set)
            if seen:
                for held, column in ((spans, "word_spans"), (items, "items")):
                    for i, x in enumerate(batch.column(names.index(column)).to_pylist()):
                        if x:
                            held[i] = [(s["start"], s["stop"]) for s in x] if column == "word_spans" else set(x)
            for owner, place, window, n in found:
                for i, p in zip(owner.tolist(), place.tolist()):
                    spans[i].append((p, p + n))
                for i, w in {*zip(owner.tolist(), window.tolist())}:
                    items[i].update(phrases.items[n][w])
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)).cast(schema.field(c).type) for c in keep), pa.array(sizes),
                 pa.array([[{"start": a, "stop": b} for a, b in _merged(spans[i])] if i in spans else [] for i in rows], schema.field("word_spans").type),
                 pa.array([sorted(items[i]) if i in items else [] for i in rows], schema.field("items").type)], schema=schema)

    return docs.mapInArrow(find, ddl)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, word_spans (merged hit words, stop exclusive) and items (sorted item ids as text)."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    docs = docs.drop("n_words", "word_spans", "items")
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        columns = keep if block == blocks - 1 else docs.columns
        docs = _pass(docs, Phrases.of([tuple(r) for r in rows], window), [c for c in columns if c not in ("n_words", "word_spans", "items")])
    return docs


def n_hit() -> Column:
    return F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> Column:
    """At least a twentieth of the document's words are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def text_spans(text: str, word_spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans of the text, for removal."""
    place = [(m.start(), m.end()) for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m.group().lower(), text))]
    return [(place[a][0], place[b - 1][1]) for a, b in word_spans]
