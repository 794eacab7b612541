"""Token-id files as directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids that have one, and so
on; a bitmap per level says which chunks continue, and a rank directory over the bitmap (ones before every 64 positions) gives the place of the
next chunk. Any token is read in one step per level and nothing around it is decoded.

A file set is a Parquet table under the shared folder whose rows are segments: whole documents in ascending ``doc_id`` order, about
``SEGMENT_IDS`` ids each (a longer document is a segment of its own), as binary columns. Spark's committer makes the write safe against lost tasks.
Null ``doc_id`` rows come first, rows that share a ``doc_id`` follow each other by text, and a null or empty text is a document of the end id alone.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.tokens import END_ID, crc32, encode_documents
from rillmap.session import scratch_path

CHUNK_BITS = 8
SEGMENT_IDS = 1 << 20
FILE_SCHEMA = ("seq long, n_docs long, n_tokens long, doc_ids binary, has_id binary, doc_sizes binary, "
               "levels array<struct<chunks: binary, more: binary, ranks: binary>>")


class DirectCodes:
    """One encoded array of unsigned 32-bit ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        levels, rest = [], np.asarray(ids, np.uint32)
        while len(rest) or not levels:
            higher = rest >> np.uint32(CHUNK_BITS)
            more = higher > 0
            packed = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed)
            ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
            levels.append((rest.astype(np.uint8), packed, ranks))
            rest = higher[more]
        return cls(levels)

    def __getitem__(self, places: np.ndarray | int) -> np.ndarray:
        """The ids at any places, in the order asked for."""
        at = np.atleast_1d(np.asarray(places, np.int64))
        out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, packed, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = packed[word]
            more = (held >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            at, open_ = (ranks[word].astype(np.int64) + below)[more], open_[more]
        return out

    def all(self) -> np.ndarray:
        """Every id, from the highest level down."""
        rest = np.empty(0, np.uint32)
        for chunks, packed, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            ids[np.unpackbits(packed.view(np.uint8), count=len(chunks), bitorder="little").view(bool)] |= rest << np.uint32(CHUNK_BITS)
            rest = ids
        return rest

    def to_row(self) -> list[dict]:
        return [{"chunks": c.tobytes(), "more": m.tobytes(), "ranks": r.tobytes()} for c, m, r in self.levels]

    @classmethod
    def from_row(cls, levels: list[dict]) -> DirectCodes:
        return cls([(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], "<u8"), np.frombuffer(x["ranks"], "<u4")) for x in levels])


def _segment(seq: int, ids: list[np.ndarray], doc_ids: list[int | None]) -> dict:
    return {"seq": seq, "n_docs": len(ids), "n_tokens": sum(map(len, ids)),
            "doc_ids": np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), "has_id": np.asarray([x is not None for x in doc_ids]).tobytes(),
            "doc_sizes": np.asarray([len(x) for x in ids], "<i8").tobytes(), "levels": DirectCodes.encode(np.concatenate(ids)).to_row()}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID) -> None:
    """Encode ``docs`` (doc_id, text; other columns are not read) and write segments in ascending ``doc_id`` order under ``path``."""
    schema = arrow_schema(FILE_SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, owners, size = 0, [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, encode_documents(vocabulary, batch.column(1).to_pylist(), end_id)):
                if held and size + len(ids) > SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([_segment(seq, held, owners)], schema)
                    seq, held, owners, size = seq + 1, [], [], 0
                held.append(ids)
                owners.append(name)
                size += len(ids)
        if held:
            yield pa.RecordBatch.from_pylist([_segment(seq, held, owners)], schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, FILE_SCHEMA).withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a written set: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)              # one row per range partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    out = "part int, seq long, doc_id long, place long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                codes, size = DirectCodes.from_row(x["levels"]), np.frombuffer(x["doc_sizes"], "<i8")
                place, ids = np.cumsum(size) - size, codes.all()
                crcs = [crc32(ids[a:a + n]) for a, n in zip(place.tolist(), size.tolist())]
                own = pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=~np.frombuffer(x["has_id"], bool))
                n = len(size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x["part"], np.int32)), pa.array(np.full(n, x["seq"])), own, pa.array(place),
                                                  pa.array(size), pa.array(crcs, pa.int64())], schema=schema)

    docs = files.select("part", "seq", "doc_ids", "has_id", "doc_sizes", "levels").mapInArrow(decode, out)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Random access: ``places`` (part, seq, place) joined to its segment's codes; returns the id at each place without decoding others."""
    out = "part int, seq long, place long, token_id long"
    schema = arrow_schema(out)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                got = DirectCodes.from_row(x["levels"])[np.asarray(x["places"])]
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x["part"], np.int32)), pa.array(np.full(n, x["seq"])), pa.array(x["places"], pa.int64()),
                                                  pa.array(got.astype(np.int64))], schema=schema)

    blocks = places.groupBy("part", "seq", F.floor(F.col("place") / 4096).alias("_b")).agg(F.collect_set("place").alias("places"))
    return blocks.join(spark.read.parquet(path).select("part", "seq", "levels"), ["part", "seq"]).select("part", "seq", "places", "levels").mapInArrow(look, out)


def token_files(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what is read back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, vocabulary)
    return read_token_files(spark, path)
