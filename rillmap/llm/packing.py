"""Best-fit packing of token pieces into sequences by vector bin packing.

A document's ids (its end id included) are cut only when they exceed the piece size; the first piece may then be shorter and all others are full. Every
piece asks for three resources of a sequence: tokens, one document slot, and attention cost (the square of its length). Pieces are dealt by a hash of
their row number into groups of about ``GROUP_PIECES``, so a group is bounded whatever the keys are, and each group is packed in one task: largest
demand first, into the open sequence that fits under every capacity and leaves the smallest weighted residual norm (``rule="norm"``) or has the
largest weighted dot product of demand and residual (``rule="dot"``). Splitting into groups costs at most about one open sequence a group.

Null and empty texts are pieces of the end id alone; null and repeated ``doc_id`` rows are documents of their own; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.tokens import END_ID, crc32, encode_documents
from rillmap.session import scratch_path

GROUP_PIECES = 8192
KNOWN_WORDS = 1_200_000         # looked-up words a task keeps; packing runs beside other stages' memory
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults let only the tokens bind: every piece has a token, and squares sum to less than the square of a sum."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def piece(self) -> int:
        """The longest piece that fits into an empty sequence."""
        return max(1, min(self.tokens, math.isqrt(self.attention)))


def cut_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds the ids as little-endian unsigned 32-bit integers."""
    ddl = PIECES + (", ids binary" if with_ids else "")
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, encode_documents(vocabulary, batch.column(1).to_pylist(), end_id, KNOWN_WORDS)):
                ends = range(len(ids) % size or size, len(ids) + 1, size) if len(ids) > size else [len(ids)]
                start = 0
                for k, end in enumerate(ends):
                    own = ids[start:end]
                    rows.append((name, k, start, end - start, crc32(own), *([own.astype("<u4").tobytes()] if with_ids else [])))
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, ddl)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece."""
    want = np.stack([lengths, np.ones_like(lengths), lengths * lengths]).astype(np.float64)
    most = np.array([[capacity.tokens], [capacity.documents], [capacity.attention]], np.float64)
    weight = np.array(capacity.weights)[:, None] / most
    order = np.lexsort((np.arange(len(lengths)), -(want * weight).sum(0)))
    left = np.repeat(most, 64, axis=1)                  # residual capacities of the open sequences, in the first ``n_open`` columns
    name = np.zeros(64, np.int64)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_open = n_bins = 0
    least = np.minimum.accumulate(lengths[order][::-1])[::-1]    # the shortest piece still to come
    for rank, i in enumerate(order.tolist()):
        d = want[:, i]
        free = left[:, :n_open]
        fits = np.flatnonzero((free >= d[:, None]).all(0))
        if len(fits):
            rest = free[:, fits]
            if capacity.rule == "dot":
                at = fits[np.argmax((weight * rest * (weight[:, 0] * d)[:, None]).sum(0))]
            else:
                at = fits[np.argmin(((weight * (rest - d[:, None])) ** 2).sum(0))]
        else:
            if n_open == left.shape[1]:
                left, name = np.concatenate([left, np.repeat(most, n_open, axis=1)], axis=1), np.concatenate([name, np.zeros(n_open, np.int64)])
            at, n_open = n_open, n_open + 1
            left[:, at], name[at] = most[:, 0], n_bins
            n_bins += 1
        bin_of[i], offset[i] = name[at], capacity.tokens - left[0, at]
        left[:, at] -= d
        coming = least[rank + 1] if rank + 1 < len(order) else math.inf
        if left[0, at] < coming or left[1, at] < 1 or left[2, at] < coming * coming:       # full for every piece to come: close it
            n_open -= 1
            left[:, at], name[at] = left[:, n_open], name[n_open]
    return bin_of, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces that is written, so that every read numbers its rows alike."""
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    shift = math.ceil(GROUP_PIECES * 4).bit_length()

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable")
        bins, offset = best_fit(rows["length"].to_numpy(np.int64), capacity)
        rows["sequence_id"], rows["offset"] = (rows["_group"].to_numpy(np.int64) << shift) + bins, offset
        return rows.drop(columns="_group")

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(deal, schema)


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Cut all ``docs`` (doc_id, text) into pieces, write these under the shared folder, and pack them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    cut_pieces(docs, vocabulary, capacity.piece, with_ids=with_ids).write.parquet(path)
    return pack(spark.read.parquet(path), capacity)
