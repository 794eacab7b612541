"""N-gram Jaccard join by an LSH forest of MinHash signatures with exact verification.

Documents are sets of five-word shingles (words are runs between ASCII blanks; a shorter text that has words is one shingle). Documents of equal sets are one
class from the start. Every class has a path of MinHash values in each of ``TREES`` prefix tries; two classes meet where their paths share a prefix.
Prefixes shorten from ``MOST_DEPTH`` until the tries together find a pair at the threshold with the target recall, and this one depth holds for all
tries and documents. The members of a trie node are linked to its smallest member only, so a node of any size costs one row a member; the
components of these links are candidate clusters. A cluster is verified in blocks of at most about ``BLOCK`` members against each other: shared shingles are
counted by products of incidence matrices, links are counted and never emitted, and each block gives a spanning forest of its true links. The components
of the forests are the near-duplicate classes.

A document without words is its own class with no links. Rows without ``doc_id`` are returned with a null class and take no part. Rows that repeat a
``doc_id`` and set count as copies of each other; rows that share only the ``doc_id`` are classes of their own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.components import components
from rillmap.llm.hashing import Rolling, mix, ragged, word_hashes
from rillmap.session import cut

SHINGLE = 5
THRESHOLD = 0.8
TREES, MOST_DEPTH, RECALL = 16, 8, 0.998
BLOCK = 256
COLUMNS = 4096
_SHINGLES = Rolling(12)


def matching_depth(threshold: float, trees: int = TREES, most: int = MOST_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which ``trees`` tries find a pair of this similarity with the target recall."""
    depth = most
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingles per text, shingle fingerprints with repeats) for consecutive groups of texts."""
    for first, count, words in word_hashes(texts):
        if not len(words):
            yield first, np.zeros_like(count), words
            continue
        start = np.cumsum(count) - count
        have = np.maximum(0, count - size + 1)
        full = _SHINGLES.windows(words, size)[ragged(start, have)] if have.any() else words[:0]
        short = (count > 0) & (count < size)
        if short.any():
            own = _SHINGLES.slices(words, start[short], start[short] + count[short])
            full = np.insert(full, (np.cumsum(have) - have)[short], own)
        yield first, have + short, full


def signatures(docs: DataFrame, threshold: float, size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, h1, h2, n, labels) and ``keep``: the fingerprint and size of each shingle set, and its prefix in every trie."""
    types = dict(docs.dtypes)
    ddl = ", ".join(["doc_id long, h1 long, h2 long, n long, labels array<long>", *(f"`{c}` {types[c]}" for c in keep)])
    schema = arrow_schema(ddl)
    depth = matching_depth(threshold)
    rng = np.random.default_rng(13)
    seeds = rng.integers(0, 1 << 63, TREES * depth, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, TREES * depth, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, TREES * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for first, count, shingles in shingle_sets(texts, size):
                n = len(count)
                labels, sums = np.zeros((n, TREES), np.uint64), np.zeros((3, n), np.uint64)
                have = np.flatnonzero(count)
                if len(have):
                    owner = np.repeat(np.arange(n, dtype=np.uint64), count)
                    order = np.lexsort((shingles, owner))
                    unique = np.ones(len(order), bool)
                    unique[1:] = (shingles[order][1:] != shingles[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                    own, whose = shingles[order][unique], owner[order][unique].astype(np.int64)
                    at = np.searchsorted(whose, have)
                    sums[0, have] = np.add.reduceat(mix(own + np.uint64(1)), at)
                    sums[1, have] = np.add.reduceat(mix(own ^ np.uint64(0x9E3779B97F4A7C15)), at)
                    sums[2, have] = np.diff(np.append(at, len(own)))
                    for k in range(TREES * depth):
                        x = (own ^ seeds[k]) * odd[k]
                        x ^= x >> np.uint64(32)
                        low = np.minimum.reduceat(x * odd[k], at)
                        labels[have, k // depth] = mix(labels[have, k // depth] * np.uint64(3) + low)
                out.append((sums, labels))
            sums = np.concatenate([s for s, _ in out], axis=1) if out else np.zeros((3, 0), np.uint64)
            labels = np.concatenate([x for _, x in out]) if out else np.zeros((0, TREES), np.uint64)
            flat = pa.array(labels.ravel().view(np.int64))
            offsets = pa.array(np.arange(len(labels) + 1, dtype=np.int32) * TREES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(offsets, flat).cast(schema.field("labels").type),
                                              *(batch.column(2 + i) for i in range(len(keep)))], schema=schema)

    return docs.select("doc_id", "text", *keep).mapInArrow(sign, ddl)


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): each class of a trie node with the node's smallest class."""
    nodes = classes.select("node", F.posexplode("labels").alias("tree", "label"))
    least = nodes.groupBy("tree", "label").agg(F.min("node").alias("b"), F.max("node").alias("most")).where(F.col("b") < F.col("most"))
    return nodes.join(least, ["tree", "label"]).where(F.col("node") > F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every two sets, by products of incidence matrices over the shingles that at least two hold."""
    m = len(sets)
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    keep = held[column] > 1
    owner, column = owner[keep], np.cumsum(held > 1)[column[keep]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((m, int(column[hi - 1]) - a + 1), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    return total


def verify(reps: np.ndarray, blocks: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], pair: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of each member through this pair of blocks, and the smallest member it is linked to, directly or not."""
    shared, size = _overlaps(sets), np.array([len(s) for s in sets])
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if pair[0] != pair[1]:
        linked &= blocks[:, None] != blocks[None, :]
    name = reps.copy()
    while True:
        new = np.minimum(name, np.where(linked, name[None, :], np.iinfo(np.int64).max).min(1))
        if (new == name).all():
            return linked @ copies, name
        name = new


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, class_id, n_links) of all ``docs`` (doc_id, text): the smallest doc_id of its class and how many documents it is linked to.

    With ``keep`` these columns of ``docs`` follow, and ``class_key``, which also tells classes of one smallest doc_id apart (null without words).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    known = docs.where(F.col("doc_id").isNotNull())
    signed = cut(signatures(known, threshold, size, keep))
    classes = cut(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
                  .withColumn("node", F.monotonically_increasing_id()))
    clusters = components(candidate_links(classes))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("m"))
    members = (clusters.join(sizes, "component").withColumn("parts", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
               .join(classes.select("node", "rep", "copies", "h1", "h2"), "node"))
    ddl = "component long, i long, j long, node long, block long, copies long, shingles binary"
    schema, found = arrow_schema(ddl), "node long, links long, name long"
    out_schema = arrow_schema(found)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.drop_columns(["text"]).to_pylist()
            blobs = [b""] * len(rows)
            for first, count, shingles in shingle_sets(batch.column("text").to_pylist(), size):
                stop = np.cumsum(count)
                for i, (a, b) in enumerate(zip((stop - count).tolist(), stop.tolist())):
                    own = np.unique(shingles[a:b])
                    x = rows[first + i]
                    if int(mix(own + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) == x["h1"]:
                        blobs[first + i] = own.tobytes()
            for x, blob in zip(rows, blobs):
                if blob:
                    others = [(min(x["block"], p), max(x["block"], p)) for p in range(x["parts"])]
                    n = len(others)
                    yield pa.RecordBatch.from_pylist([{"component": x["component"], "i": i, "j": j, "node": x["node"], "block": x["block"], "copies": x["copies"],
                                                       "shingles": blob} for i, j in others], schema) if n else None

    def check(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        reps = rows["node"].to_numpy()
        once = np.concatenate([[True], reps[1:] != reps[:-1]])
        sets = [np.frombuffer(b, np.uint64) for b, o in zip(rows["shingles"].to_pylist(), once) if o]
        links, name = verify(reps[once], rows["block"].to_numpy()[once], rows["copies"].to_numpy()[once], sets, (key[1].as_py(), key[2].as_py()), threshold)
        return pa.table([pa.array(reps[once]), pa.array(links.astype(np.int64)), pa.array(name)], schema=out_schema)

    texts = members.join(known.select(F.col("doc_id").alias("rep"), "text"), "rep").select("component", "node", "block", "parts", "copies", "h1", "text")
    checked = cut(texts.mapInArrow(fetch, ddl).groupBy("component", "i", "j").applyInArrow(check, found))
    names = components(checked.where(F.col("node") != F.col("name")).select(F.col("node").alias("a"), F.col("name").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "rep", "copies", "node").join(links, "node", "left").join(names, "node", "left").withColumn("class_key", F.coalesce("component", "node"))
    least = named.groupBy("class_key").agg(F.min("rep").alias("class_id"))
    found_classes = named.join(least, "class_key").select("h1", "h2", "class_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    more = [*keep, "class_key"] if keep else []
    result = signed.select("doc_id", "h1", "h2", "n", *keep).join(found_classes, ["h1", "h2"], "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links"), *more)
    none = F.lit(None).cast("long")
    lost = docs.where(F.col("doc_id").isNull()).select("doc_id", none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), *keep, *([none.alias("class_key")] if keep else []))
    return result.unionByName(lost)
