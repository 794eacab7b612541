"""Suffix-array dedup on bytes: removal of every byte covered by a 50-byte string that also starts in a smaller document.

All 50-byte windows of a document are cut into runs, each run being the windows that choose the same 24-byte gram (the one of the smallest fingerprint among the
27 they hold). Equal windows choose equal grams, wherever they stand. So (1) only runs whose gram occurs in another document go on, and are written down; (2) a run
whose whole stretch of bytes also occurs in a smaller document is a copy at once, every window of it; (3) each other stretch, once per text and only if its gram has
another one, goes to the suffix bucket of its gram, where the windows that may be equal are sorted blockwise with a difference cover (``suffix_sort``) and a
window is a copy if its group of equal windows holds a smaller document; (4) the bytes that copied windows cover are removed. A gram of more than ``MANY``
different stretches would gather text without bound: its windows are dealt one by one, by their own 50 bytes, and sorted in the same way.

Texts are UTF-8 bytes, a null text is empty and matches never cross documents. Rows without ``doc_id`` are returned with nothing removed. Rows that share a
``doc_id`` never remove each other's bytes. Kept bytes need not be valid UTF-8, so they are returned as binary.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.blocks import ENTRIES, KEYS, Block, Blocks, bucket_edges, by_entry, census, distinct_entries, distinct_keys, joined, send_entries, send_keys, sliding_min, split
from rillmap.llm.hashing import Rolling, mix, ragged
from rillmap.llm.suffix_sort import equal_windows

WINDOW, GRAM = 50, 24
CHOICES = WINDOW - GRAM + 1
PRINTS = 1 << 19                # bytes whose windows are fingerprinted at a time
MANY = 1 << 17                  # different stretches of a gram, of up to 76 bytes each; a gram below this fills a bucket with some 10 MB at most
FINER = 4                       # suffix buckets per bucket of fingerprints: a stretch is longer than a fingerprint
_GRAM, _ONE, _TWO = Rolling(31), Rolling(32), Rolling(33)
_PLACE, _HALF = np.uint64((1 << 20) - 1), np.uint64((1 << 64) - (1 << 32))
STRETCHES = "bucket int, block long, sizes binary, docs binary, data binary"
RUNS = "block long, beside binary"


@dataclass
class Runs:
    """Runs of windows of a block: the gram (a fingerprint that spreads over all buckets), the document, the first window and how many; with fingerprints of the whole
    stretch if asked for, the gram's first half among them."""

    gram: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    high: np.ndarray
    low: np.ndarray


def _runs(block: Block, whole: bool) -> Runs:
    found = []
    for a, b in block.parts():
        base = block.starts[a]
        data = block.data[base:block.stops[b - 1]]
        begin, size = block.starts[a:b] - base, block.stops[a:b] - block.starts[a:b]
        have = np.maximum(0, size - WINDOW + 1)
        at = ragged(begin, have)
        if not len(at):
            continue
        grams = _GRAM.windows(_GRAM.byte[data], GRAM)
        least = sliding_min(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64) & _PLACE, CHOICES)
        chosen = at + ((least[at].astype(np.int64) - at) & int(_PLACE))
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(at)))
        start, gram = at[first], chosen[first]
        doc = np.repeat(np.arange(a, b), have)[first]
        high = low = start[:0]
        own = mix(grams[gram])
        if whole:
            stop, form = start + count + WINDOW - 1, (gram - start).astype(np.uint64)
            high = mix(_ONE.slices(_ONE.byte[data], start, stop) + form * np.uint64(64) + count.astype(np.uint64))
            low = mix(_TWO.slices(_TWO.byte[data], start, stop) + form).astype(np.uint32)
            high = own & _HALF | high >> np.uint64(32)
        found.append((own, doc, start + base, count, high, low))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none, none.astype(np.uint64), none.astype(np.uint32))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def _grams(block: Block, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return distinct_keys(runs.gram, block.doc_ids[runs.doc])


def _shared(block: Block) -> Runs:
    """The runs whose gram occurs in another document."""
    runs = _runs(block, True)
    _, several, which = _grams(block, runs)
    keep = (several | (block.flags("grams") > 0))[which]
    return Runs(*(getattr(runs, f)[keep] for f in Runs.__dataclass_fields__))


_KINDS = {"gram": "<u4", "doc": "<u4", "start": "<u4", "windows": "u1", "high": "<u8", "low": "<u4"}


def _written(block: Block, runs: Runs) -> bytes:
    """Runs as bytes: their number, the block's document ids, and each column; of a gram only the second half, since a stretch's fingerprint begins with the first one."""
    columns = (runs.gram & ~_HALF, runs.doc, runs.start, runs.windows, runs.high, runs.low)
    return b"".join([len(runs.gram).to_bytes(8, "little"), block.doc_ids.astype("<i8").tobytes(), *(x.astype(kind).tobytes() for x, kind in zip(columns, _KINDS.values()))])


def _read(data: np.ndarray) -> Runs:
    """Written runs, with the id of the document in place of its number."""
    data = data.tobytes()
    n, at, found = int.from_bytes(data[:8], "little"), len(data), {}
    for name, kind in reversed(_KINDS.items()):
        at -= n * np.dtype(kind).itemsize
        found[name] = np.frombuffer(data, kind, n, at)
    docs = np.frombuffer(data, "<i8", (at - 8) // 8, 8)
    return Runs(found["high"] & _HALF | found["gram"], docs[found["doc"]], found["start"].astype(np.int64), found["windows"].astype(np.int64), found["high"], found["low"])


def _later(many: int):
    """For fingerprints of stretches: bit 0 if a smaller document holds the same one, bit 1 if the gram (their first half) has another one, bit 2 if it has more than ``many``."""
    def answer(rows: pa.Table) -> list[bytes]:
        high, sizes = joined(rows, "keys", "<u8")
        low, _ = joined(rows, "more", "<u4")
        docs, _ = joined(rows, "docs", "<i8")
        order, first = by_entry(high, low)
        group = np.cumsum(first) - 1
        h = high[order][first] & _HALF
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        stretches = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1][group]
        flags = np.empty(len(high), np.uint8)
        flags[order] = (docs[order] > np.minimum.reduceat(docs[order], np.flatnonzero(first))[group]) | (stretches > 1).astype(np.uint8) << 1 | (stretches > many).astype(np.uint8) << 2
        return split(flags, sizes)
    return answer


@dataclass
class Stretches:
    """What a block sends to the suffix buckets, in the order sent: a run's entry, its first window sent, and how many."""

    key: np.ndarray
    entry: np.ndarray
    start: np.ndarray
    shift: np.ndarray
    windows: np.ndarray


def _stretches(block: Block) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, Stretches]:
    """Shared runs, their entries with the smallest document of each, whether each is a copy as a whole, and the stretches of the others, once per entry."""
    runs = _read(block.beside)
    docs, (_, _, least), which = runs.doc, *distinct_entries(runs.high, runs.low, runs.doc)
    flags = block.flags("stretches")
    later = flags & 1 > 0
    entry, one = np.unique(which, return_index=True)
    open_ = (flags & 3 == 2)[entry]
    # the first row of an entry may be a later document of the block: its bytes are the same, its smallest document is in ``least``
    entry, one = entry[open_], one[open_]
    hot = (flags & 4 > 0)[entry]
    n = np.where(hot, runs.windows[one], 1)
    row = np.repeat(np.arange(len(one)), n)
    shift = ragged(np.zeros(len(one), np.int64), n)
    start = runs.start[one][row] + shift
    key = runs.gram[one][row].copy()
    singles = np.flatnonzero(hot[row])
    for part in np.array_split(singles, max(1, len(singles) >> 16)) if len(singles) else ():
        own = start[part]
        key[part] = _ONE.windows(_ONE.byte[block.data[ragged(own, np.full(len(own), WINDOW))]], WINDOW)[::WINDOW]
    order = np.argsort(key, kind="stable")
    windows = np.where(hot[row], 1, runs.windows[one][row])
    sent = Stretches(key[order], entry[row][order], start[order], shift[order], windows[order])
    return runs, which, least, later[which] | (docs > least[which]), sent


def _candidates(text: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text without stretches that hold no window of a fingerprint that stands twice, where each stretch begins in it, and the windows that may be equal."""
    at = ragged(begin, windows)
    prints = np.concatenate([_ONE.windows(_ONE.byte[text[a:a + PRINTS + WINDOW - 1]], WINDOW) for a in range(0, max(1, len(text) - WINDOW + 1), PRINTS)])[at]
    order = np.argsort(prints)
    again = np.zeros(len(at) + 1, bool)
    again[1:-1] = prints[order][1:] == prints[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order] = again[1:] | again[:-1]
    stretch = np.repeat(np.arange(len(windows)), windows)
    keep = np.zeros(len(windows), bool)
    keep[stretch[twice]] = True
    size = np.where(keep, windows + WINDOW - 1, 0)
    moved = np.cumsum(size) - size
    text = text[ragged(begin[keep], size[keep])]
    return text, np.where(keep, moved, -1), (at - begin[stretch] + moved[stretch])[twice]


def _sort(rows: pa.Table) -> list[bytes]:
    """One bit for each window of each stretch: it also stands in a smaller document."""
    windows, each = joined(rows, "sizes", "u1")
    windows = windows.astype(np.int64)
    docs, _ = joined(rows, "docs", "<i8")
    text, _ = joined(rows, "data", "u1")
    size = windows + WINDOW - 1
    begin = np.cumsum(size) - size
    mask = np.zeros(len(windows), np.uint64)
    text, begin, at = _candidates(text, begin, windows)
    live = np.flatnonzero(begin >= 0)
    for own, first in equal_windows(text, at, WINDOW):
        stretch = live[np.searchsorted(begin[live], at[own], "right") - 1]
        doc = docs[stretch]
        least = np.minimum.reduceat(doc, first)[np.cumsum(np.isin(np.arange(len(own)), first)) - 1]
        copy, stretch = own[doc > least], stretch[doc > least]
        np.bitwise_or.at(mask, stretch, np.uint64(1) << (at[copy] - begin[stretch]).astype(np.uint64))
    return [x.astype("<u8").tobytes() for x in np.split(mask, np.cumsum(each)[:-1])]


def dedup_suffixes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``docs`` (doc_id, text) and, ``with_text``, the kept bytes."""
    blocks = Blocks(docs)
    n = blocks.buckets
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    key_schema, run_schema, entry_schema, stretch_schema, out_schema = (arrow_schema(s) for s in (KEYS, RUNS, ENTRIES, STRETCHES, out))

    def send_grams(block: Block) -> Iterator[pa.RecordBatch]:
        yield send_keys(block.number, _grams(block, _runs(block, False))[0], n, key_schema)

    def write_runs(block: Block) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([block.number]), pa.array([_written(block, _shared(block))])], schema=run_schema)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                runs = _read(np.frombuffer(r["beside"], np.uint8))
                yield send_entries(r["block"], distinct_entries(runs.high, runs.low, runs.doc)[0], n, entry_schema)

    def send_stretches(block: Block) -> Iterator[pa.RecordBatch]:
        _, _, least, _, sent = _stretches(block)
        for bucket, a, z in bucket_edges(sent.key, FINER * n):
            data = block.data[ragged(sent.start[a:z], sent.windows[a:z] + WINDOW - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block.number]), pa.array([sent.windows[a:z].astype("u1").tobytes()]),
                                              pa.array([least[sent.entry[a:z]].astype("<i8").tobytes()]), pa.array([data.tobytes()])], schema=stretch_schema)

    def remove(block: Block) -> Iterator[pa.RecordBatch]:
        runs, which, _, whole, sent = _stretches(block)
        answers = block.flags("windows").view("<u8")
        masks = np.zeros(int(which.max()) + 1 if len(which) else 0, np.uint64)
        np.bitwise_or.at(masks, sent.entry, answers << sent.shift.astype(np.uint64))
        depth = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(depth, runs.start[whole], 1)
        np.add.at(depth, runs.start[whole] + runs.windows[whole] + WINDOW - 1, -1)
        rest, mask = runs.start[~whole], masks[which[~whole]]
        for k in range(CHOICES):
            gone = rest[mask >> np.uint64(k) & np.uint64(1) > 0] + k
            np.add.at(depth, gone, 1)
            np.add.at(depth, gone + WINDOW, -1)
        cover = np.cumsum(depth)[:-1] > 0
        rows = []
        for doc, a, b in zip(block.doc_ids.tolist(), block.starts.tolist(), block.stops.tolist()):
            own = cover[a:b]
            kept = block.data[a:b][~own].tobytes()
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            rows.append((doc, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_schema.types)], schema=out_schema)

    grams = blocks.settle(blocks.run(send_grams, KEYS), census(1 << 30))
    runs = blocks.keep(blocks.run(write_runs, RUNS, {"grams": grams}))
    stretches = blocks.settle(runs.mapInArrow(send_runs, ENTRIES), _later(MANY))
    windows = blocks.settle(blocks.run(send_stretches, STRETCHES, {"stretches": stretches}, runs), _sort)
    done = blocks.run(remove, out, {"stretches": stretches, "windows": windows}, runs)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    lost = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                                       F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if with_text else []))
    return done.unionByName(lost)
