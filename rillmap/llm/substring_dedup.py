"""Substring dedup on words by recompression.

Each document is a sequence of words, and every round replaces maximal runs of one symbol and then pairs of neighbouring symbols by new symbols. A symbol's name
is a fingerprint of what it stands for, so all tasks name alike without asking each other; which pairs join depends on the names of the two symbols
alone (the left one must hash to 0 and the right one to 1). Names longer than the round's limit in ``LIMITS`` words are not made. Equal passages therefore get
equal symbols except near their ends, where a round can spoil at most twice its limit less one word: within a window of 50 words, symbols at least
``MARGIN`` words from both ends are the same in every copy, and there are at least ``SPAN`` of them.

Two exchanges follow. First the symbols: of every ``SPAN`` neighbours the one of the smallest fingerprint is sent, and a bucket answers which occur in another
document. A window can be a copy only if all symbols chosen inside its margins do, so most of the text ends here. Then the windows that are left are
verified: a 96-bit fingerprint of the names of all 50 words with the smallest document of the block, answered by whether a smaller document sent it. Words of
windows that also start in a smaller document are removed; windows are judged on the input.

A null text has no words. Rows without ``doc_id`` are returned with nothing removed. Rows that share a ``doc_id`` never remove each other's words.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.blocks import ENTRIES, KEYS, Block, Blocks, census, distinct_entries, distinct_keys, earlier, send_entries, send_keys, sliding_min
from rillmap.llm.hashing import Rolling, mix, ragged, word_edges, word_names

WINDOW = 50
LIMITS = (2, 4)                                             # words that one symbol may stand for after each round
MARGIN = sum(2 * n - 1 for n in LIMITS)
SPAN = (WINDOW - 2 * MARGIN - 2 * (LIMITS[-1] - 1)) // LIMITS[-1]
_RUN, _RUN2 = Rolling(23), Rolling(24)
_PLACE = np.uint64((1 << 20) - 1)


def compress(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all rounds and the word at which each starts; ``doc`` tells the document of each word."""
    symbol, start, owner = words, np.arange(len(words)), doc
    for number, limit in enumerate(LIMITS):
        size = np.diff(np.append(start, len(words)))
        opens = np.ones(len(symbol), bool)                  # runs of one symbol
        opens[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(symbol)))
        named = (count > 1) & (count * size[first] <= limit)
        run = np.cumsum(opens) - 1
        symbol = np.where(opens & named[run], mix(symbol * np.uint64(0xD1342543DE82EF95) + count[run].astype(np.uint64)), symbol)
        keep = opens | ~named[run]
        symbol, start, owner = symbol[keep], start[keep], owner[keep]
        size = np.diff(np.append(start, len(words)))
        side = mix(symbol + np.uint64(number + 1)) & np.uint64(1) > 0
        joins = np.zeros(len(symbol), bool)                 # pairs of a left and a right symbol
        joins[:-1] = ~side[:-1] & side[1:] & (owner[1:] == owner[:-1]) & (size[1:] + size[:-1] <= limit)
        after = np.concatenate([symbol[1:], symbol[:1]])
        symbol = np.where(joins, mix(symbol * np.uint64(0x9E3779B97F4A7C15) + mix(after)), symbol)
        keep = ~np.concatenate([[False], joins[:-1]])
        symbol, start, owner = symbol[keep], start[keep], owner[keep]
    return symbol, start


class Part:
    """One range of documents of a block: words, chosen symbols and windows."""

    def __init__(self, block: Block, first: int, last: int):
        base = block.starts[first]
        data = block.data[base:block.stops[last - 1]]
        self.starts, self.stops = word_edges(data, block.starts[first:last] - base)
        self.count = np.diff(np.searchsorted(self.starts, block.stops[first:last] - base), prepend=0)
        self.data, self.first, self.docs = data, first, block.doc_ids[first:last]
        self.doc = np.repeat(np.arange(last - first), self.count)
        self.words, self.second = word_names(data, self.starts, self.stops)

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of the chosen symbols and their documents; for every stretch of ``SPAN`` symbols its chosen one and, in words, its start and end."""
        if not len(self.words):
            none = np.zeros(0, np.int64)
            return self.words, none, none, np.zeros((2, 0), np.int64)
        symbol, start = compress(self.words, self.doc)
        owner = self.doc[start]
        least = sliding_min(symbol & ~_PLACE | np.arange(len(symbol), dtype=np.uint64) & _PLACE, SPAN) if len(symbol) >= SPAN else symbol[:0]
        inside = np.flatnonzero(owner[:len(least)] == owner[SPAN - 1:SPAN - 1 + len(least)])
        at = inside + ((least[inside].astype(np.int64) - inside) & int(_PLACE))
        place, which = np.unique(at, return_inverse=True)
        stop = np.append(start[1:], len(self.words))
        return symbol[place], self.docs[owner[place]], which, np.stack([start[inside], stop[inside + SPAN - 1]])

    def windows(self, shared: np.ndarray, which: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """First words of the windows of which every chosen symbol inside the margins is shared."""
        have = np.maximum(0, self.count - WINDOW + 1)
        at = ragged(np.cumsum(self.count) - self.count, have)
        bad = np.concatenate([[0], np.cumsum(~shared[which])])
        low, high = np.searchsorted(reach[0], at + MARGIN), np.searchsorted(reach[1], at + WINDOW - MARGIN, "right")
        return at[(high > low) & (bad[np.maximum(high, low)] == bad[low])]

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _RUN.windows(self.words, WINDOW)[at], _RUN2.windows(self.second, WINDOW)[at].astype(np.uint32)


def _symbols(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    parts = [Part(block, a, b).chosen()[:2] for a, b in block.parts()]
    sizes = np.array([len(k) for k, _ in parts], np.int64)
    keys, several, which = distinct_keys(np.concatenate([k for k, _ in parts]), np.concatenate([d for _, d in parts]))
    return keys, several, sizes, np.split(which, np.cumsum(sizes)[:-1])


def _windows(block: Block) -> Iterator[tuple[Part, np.ndarray]]:
    """Every part with its candidate windows."""
    _, several, _, which = _symbols(block)
    shared = several | (block.flags("symbols") & 1 > 0)
    for (a, b), own in zip(block.parts(), which):
        part = Part(block, a, b)
        _, _, stretch, reach = part.chosen()
        yield part, part.windows(shared[own], stretch, reach)


def _entries(block: Block):
    """The block's distinct candidate windows, and per part the windows, their documents and their entries."""
    found = []
    for part, at in _windows(block):
        found.append((part, at, part.docs[part.doc[at]], *part.fingerprints(at)))
    entries, which = distinct_entries(*(np.concatenate([f[k] for f in found]) for k in (3, 4, 2)))
    return entries, [(f[0], f[1], f[2], w) for f, w in zip(found, np.split(which, np.cumsum([len(f[1]) for f in found])[:-1]))]


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``docs`` (doc_id, text) and, ``with_text``, the kept words joined by one blank."""
    spark = docs.sparkSession
    blocks = Blocks(docs)
    n = blocks.buckets
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    key_schema, entry_schema, out_schema = (arrow_schema(s) for s in (KEYS, ENTRIES, out))

    def send_symbols(block: Block) -> Iterator[pa.RecordBatch]:
        yield send_keys(block.number, _symbols(block)[0], n, key_schema)

    def send_windows(block: Block) -> Iterator[pa.RecordBatch]:
        yield send_entries(block.number, _entries(block)[0], n, entry_schema)

    def remove(block: Block) -> Iterator[pa.RecordBatch]:
        (_, _, least), found = _entries(block)
        later = block.flags("windows") > 0
        for part, at, docs, which in found:
            gone = at[later[which] | (docs > least[which])]
            depth = np.zeros(len(part.words) + 1, np.int64)
            np.add.at(depth, gone, 1)
            np.add.at(depth, gone + WINDOW, -1)
            cover = np.cumsum(depth)[:-1] > 0
            stop = np.cumsum(part.count)
            rows = []
            for doc, a, b in zip(part.docs.tolist(), (stop - part.count).tolist(), stop.tolist()):
                kept = np.flatnonzero(~cover[a:b]) + a
                text = b" ".join([part.data[s:e].tobytes() for s, e in zip(part.starts[kept].tolist(), part.stops[kept].tolist())])
                rows.append((doc, b - a, b - a - len(kept), hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "replace")] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)

    symbols = blocks.settle(blocks.run(send_symbols, KEYS), census(1 << 30))
    windows = blocks.settle(blocks.run(send_windows, ENTRIES, {"symbols": symbols}), earlier)
    done = blocks.run(remove, out, {"symbols": symbols, "windows": windows})
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    joined = F.array_join(F.coalesce(words, F.expr("CAST(array() AS array<string>)")), " ")
    count = F.coalesce(F.size(words), F.lit(0))
    lost = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_words"),
                                                       F.lit(0).cast("long").alias("n_removed"), F.sha2(joined, 256).alias("kept_sha256"),
                                                       *([joined.alias("kept_text")] if with_text else []))
    return done.unionByName(lost)
