"""Documents in blocks for operators that look for equal strings across the whole corpus.

A block holds whole documents of one input task, about ``BLOCK_BYTES`` of UTF-8 (a longer document is a block of its own). The blocks are written once as a
table bucketed by block, so every later pass reads them with no shuffle of text. A pass sends each distinct fingerprint of a block once, to the bucket of
its leading bits, and a bucket answers every block with one flag per fingerprint in the order sent. A string that a third of all documents hold is
thus at most one entry per block, however hot it is, and only fingerprints and flags travel.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.session import scratch_path

BLOCK_BYTES = 4 << 20
PART_BYTES = 1 << 19             # documents of a block are worked on in parts of about this size
ROWS = "block long, doc_ids binary, sizes binary, data binary"


@dataclass
class Block:
    """Document ids, and the UTF-8 bytes of all documents with where each begins and ends."""

    number: int
    doc_ids: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    data: np.ndarray
    replies: dict[str, list[bytes]]
    beside: np.ndarray | None = None

    def parts(self) -> Iterator[tuple[int, int]]:
        """Consecutive ranges of documents."""
        at = 0
        for i in range(len(self.doc_ids)):
            if i > at and self.stops[i] - self.starts[at] > PART_BYTES:
                yield at, i
                at = i
        if at < len(self.doc_ids):
            yield at, len(self.doc_ids)

    def flags(self, kind: str) -> np.ndarray:
        """All flags of one kind, in the order in which the fingerprints were sent."""
        return np.frombuffer(b"".join(self.replies.get(kind, [])), np.uint8)


def bucket_edges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of every bucket that sorted 64-bit keys reach; a bucket is a range of keys, and keys of one first half share it."""
    top = [-(-(b << 32) // buckets) << 32 for b in range(1, buckets)]
    cut = [0, *np.searchsorted(keys, np.array(top, np.uint64)).tolist(), len(keys)]
    return [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]


class Blocks:
    """The written blocks of ``docs`` (doc_id, text): rows without ``doc_id`` are left out, a null text is empty."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(1, math.ceil(total / BLOCK_BYTES))
        schema = arrow_schema(ROWS)

        def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts, size, seq = [], [], 0, 0

            def row() -> pa.RecordBatch:
                sizes = np.fromiter(map(len, texts), "<i8", len(texts))
                return pa.RecordBatch.from_pylist([{"block": seq, "doc_ids": np.array(ids, "<i8").tobytes(), "sizes": sizes.tobytes(), "data": b"".join(texts)}], schema)

            for batch in batches:
                data = batch.column(1).cast(pa.binary()).to_pylist()
                for doc, text in zip(batch.column(0).to_pylist(), data):
                    text = text or b""
                    if ids and size + len(text) > BLOCK_BYTES:
                        yield row()
                        ids, texts, size, seq = [], [], 0, seq + 1
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
            if ids:
                yield row()

        rows = docs.mapInArrow(group, ROWS).withColumn("block", F.col("block") + F.shiftleft(F.spark_partition_id().cast("long"), 24))
        self.name = f"blocks_{uuid.uuid4().hex}"
        rows.write.option("path", scratch_path(self.spark, "blocks")).option("compression", "zstd").bucketBy(max(1, self.buckets // 2), "block").saveAsTable(self.name)

    def keep(self, rows: DataFrame) -> DataFrame:
        """(block, beside), one row a block, written like the blocks, so that they meet without a shuffle."""
        name = f"beside_{uuid.uuid4().hex}"
        rows.write.option("path", scratch_path(self.spark, "beside")).option("compression", "zstd").bucketBy(max(1, self.buckets // 2), "block").saveAsTable(name)
        return self.spark.table(name)

    def run(self, work: Callable[[Block], Iterator[pa.RecordBatch]], schema: str, replies: dict[str, DataFrame] | None = None, beside: DataFrame | None = None) -> DataFrame:
        """Apply ``work`` to every block, with the replies that were written for it and what was kept beside it."""
        table = self.spark.table(self.name)
        if beside is not None:
            table = table.join(beside.hint("merge"), "block")
        if replies:
            each = [df.select("block", F.lit(kind).alias("kind"), "bucket", "flags") for kind, df in replies.items()]
            every = each[0]
            for df in each[1:]:
                every = every.unionByName(df)
            table = table.join(every.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "flags")).alias("replies")), "block", "left")

        def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = batch.slice(i, 1)
                    got = {n: x.column(n)[0] for n in x.schema.names}
                    held: dict[str, list[bytes]] = {}
                    for r in sorted((got["replies"].as_py() or []) if "replies" in got else [], key=lambda r: r["bucket"]):
                        held.setdefault(r["kind"], []).append(r["flags"])
                    stops = np.cumsum(np.frombuffer(got["sizes"].as_py(), "<i8"))
                    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
                    data = np.frombuffer(got["data"].as_buffer() if len(got["data"].as_buffer() or b"") else b"", np.uint8)
                    own = np.frombuffer(got["beside"].as_buffer(), np.uint8) if "beside" in got else None
                    yield from work(Block(got["block"].as_py(), np.frombuffer(got["doc_ids"].as_py(), "<i8"), starts, stops, data, held, own))

        return table.mapInArrow(each_block, schema)

    def settle(self, sent: DataFrame, answer: Callable[[pa.Table], list[bytes]]) -> DataFrame:
        """Group what was sent by bucket, let ``answer`` give the flags of each row, and write (block, bucket, flags)."""
        out = "block long, bucket int, flags binary"
        schema = arrow_schema(out)

        def one(rows: pa.Table) -> pa.Table:
            return pa.table([rows["block"], rows["bucket"], pa.array(answer(rows), pa.binary())], schema=schema)

        path = scratch_path(self.spark, "replies")
        sent.groupBy("bucket").applyInArrow(one, out).write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)


def joined(rows: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one array, and the entries of each row."""
    parts = [np.frombuffer(b, kind) for b in rows[name].to_pylist()]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def split(flags: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def census(many: int) -> Callable[[pa.Table], list[bytes]]:
    """For 32-bit rests of fingerprints, one entry per block: bit 0 if another block sent it too, bit 1 if more than ``many`` blocks did."""
    def answer(rows: pa.Table) -> list[bytes]:
        keys, sizes = joined(rows, "keys", "<u4")
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        return split(((count > 1).astype(np.uint8) | (count > many).astype(np.uint8) << 1)[which], sizes)
    return answer


def earlier(rows: pa.Table) -> list[bytes]:
    """For 96-bit fingerprints with the smallest document of the block: 1 if a smaller document sent the same one."""
    high, sizes = joined(rows, "keys", "<u8")
    low, _ = joined(rows, "more", "<u4")
    docs, _ = joined(rows, "docs", "<i8")
    order, first = by_entry(high, low)
    flags = np.empty(len(high), np.uint8)
    flags[order] = docs[order] > np.minimum.reduceat(docs[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    return split(flags, sizes)


KEYS = "bucket int, block long, keys binary"
ENTRIES = "bucket int, block long, keys binary, more binary, docs binary"


def send_keys(block: int, keys: np.ndarray, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """The low halves of sorted distinct keys, dealt by their leading bits."""
    low, edges = keys.astype("<u4"), bucket_edges(keys, buckets)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in edges], pa.int32()), pa.array([block] * len(edges), pa.int64()),
                                       pa.array([low[a:z].tobytes() for _, a, z in edges], pa.binary())], schema=schema)


def send_entries(block: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """Sorted distinct (key, more, doc) entries, dealt by the leading bits of the key."""
    high, low, docs = entries
    edges = bucket_edges(high, buckets)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in edges], pa.int32()), pa.array([block] * len(edges), pa.int64()),
                                       *(pa.array([x[a:z].astype(t).tobytes() for _, a, z in edges], pa.binary()) for x, t in ((high, "<u8"), (low, "<u4"), (docs, "<i8")))],
                                      schema=schema)


def by_entry(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of (high, low), and where each different one begins. Equal ``high`` with unequal ``low`` is rare, so one sort does."""
    order = np.argsort(high)
    h, lo = high[order], low[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    if (~first[1:] & (lo[1:] != lo[:-1])).any():
        order = np.lexsort((low, high))
        h, lo = high[order], low[order]
        first[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    return order, first


def distinct_entries(high: np.ndarray, low: np.ndarray, docs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Sorted distinct (high, low) with the smallest document of each, and the entry of every row given."""
    order, first = by_entry(high, low)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    least = np.minimum.reduceat(docs[order], np.flatnonzero(first)) if len(order) else docs
    return (high[order][first], low[order][first], least), which


def distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether at least two documents hold each, and the distinct key of every row given."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    which = np.empty(len(k), np.int64)
    group = np.cumsum(first) - 1
    which[order] = group
    several = np.zeros(int(first.sum()), bool)
    several[group[1:][(d[1:] != d[:-1]) & ~first[1:]]] = True           # two documents stand next to each other somewhere, whatever the order of a key's rows
    return k[first], several, which


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of ``size`` consecutive entries from each place that has so many."""
    held, reach = x, 1
    while reach * 2 <= size:
        held, reach = np.minimum(held[:-reach], held[reach:]), reach * 2
    rest = size - reach
    return np.minimum(held[:len(held) - rest], held[rest:]) if rest else held
