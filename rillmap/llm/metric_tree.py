"""Exact top-k inner-product search by best-first traversal of M-trees.

Inner product is made a metric first: with M the largest norm in a tree, every vector x gets the extra component sqrt(M^2 - |x|^2) and a query q gets 0, so
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x`` and the nearest object is the one of the largest product. Each task bulk-loads trees of at most ``TREE_ROWS``
vectors from its rows, whatever these are. A tree is a row of pages of at most ``PAGE`` entries: inner pages hold routing objects with covering radius
and distance to their parent, leaf pages hold vectors with distance to their parent. The search keeps a queue of pages by their lower bound. An entry whose
stored parent distance already rules it out by the triangle inequality is skipped without computing its distance. Bounds are compared with a slack
above rounding error and ties are never pruned, so results are exact.

Queries travel in blocks of ``QUERY_BLOCK``. A tree belongs to one lane, each block is sent once to every lane, and the two meet in an equi-join on the lane;
only the best k of each (query, tree) leave a task, and Spark keeps the best k before the last shuffle as well.

Vectors that are null or hold null or non-finite components take no part; vectors of different lengths never meet; rows with the query's own id are not
its candidates; repeated rows are candidates each; a query row that repeats exactly is asked once. Scores are exact while ``|q| |x| < 2^53``.
"""
from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.session import scratch_path

TREE_ROWS = 16_384
PAGE = 128
QUERY_BLOCK = 1024
SLACK = 1e-6
TREES = "dim int, top double, pages array<struct<leaf: boolean, vectors: binary, ids: binary, radius: binary, parent: binary>>"
HITS = "query_id long, _q long, vec_id long, score long"


class Page:
    """``ids`` are child pages or vector ids; ``parent`` is the distance to the routing object above (0 in the root)."""

    __slots__ = ("leaf", "vectors", "ids", "radius", "parent")

    def __init__(self, leaf, vectors, ids, radius, parent):
        self.leaf, self.vectors, self.ids, self.radius, self.parent = leaf, vectors, ids, radius, parent


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(1))


def build(ids: np.ndarray, vectors: np.ndarray) -> tuple[float, list[Page]]:
    """Bulk-load a tree: the largest norm and the pages, the root first."""
    square = (vectors ** 2).sum(1)
    top = math.sqrt(square.max()) if len(square) else 0.0
    points = np.column_stack([vectors, np.sqrt(np.maximum(0.0, top * top - square))])
    rng = np.random.default_rng(len(ids))
    pages: list[Page] = []

    def load(rows: np.ndarray, router: np.ndarray | None) -> int:
        at = len(pages)
        pages.append(None)
        zero = np.zeros(len(rows))
        if len(rows) <= PAGE:
            pages[at] = Page(True, points[rows], ids[rows], zero, _distance(points[rows], router) if router is not None else zero)
            return at
        fan = min(PAGE, -(-len(rows) // PAGE) * 2)
        seeds = points[rng.choice(rows, fan, replace=False)]
        near = ((seeds ** 2).sum(1) - 2 * points[rows] @ seeds.T).argmin(1)
        parts = [rows[near == s] for s in np.unique(near)]
        routers = seeds[np.unique(near)]
        if len(parts) == 1:                     # equal vectors: any split does
            parts = np.array_split(rows, fan)
            routers = np.repeat(routers, fan, axis=0)
        radius = np.array([_distance(points[p], r).max() for p, r in zip(parts, routers)])
        parent = _distance(routers, router) if router is not None else np.zeros(len(parts))
        pages[at] = Page(False, routers, np.array([load(p, r) for p, r in zip(parts, routers)], np.int64), radius, parent)
        return at

    load(np.arange(len(ids)), None)
    return top, pages


def search(top: float, pages: list[Page], own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the best ``k`` objects, the query's own id left out; ties to smaller ids."""
    point, square = np.append(query, 0.0), float(query @ query)
    slack = SLACK * (math.sqrt(square) + top + 1.0)
    ids, scores, reach = np.empty(0, np.int64), np.empty(0), math.inf
    queue: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
    while queue:
        bound, at, above = heapq.heappop(queue)
        if bound > reach:
            break
        page = pages[at]
        entries = np.arange(len(page.ids))
        if above is not None and reach < math.inf:
            entries = np.flatnonzero(np.abs(above - page.parent) - page.radius <= reach)
        if page.leaf:
            got = page.vectors[entries, :-1] @ query
            new = page.ids[entries]
            keep = new != own
            if len(ids) == k:
                keep &= got >= scores[-1]
            if keep.any():
                ids, scores = np.concatenate([ids, new[keep]]), np.concatenate([scores, got[keep]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                if len(ids) == k:
                    reach = math.sqrt(max(0.0, square + top * top - 2 * scores[-1])) + slack
        elif len(entries):
            distance = _distance(page.vectors[entries], point)
            lower = np.maximum(0.0, distance - page.radius[entries])
            for e, low, d in zip(entries.tolist(), lower.tolist(), distance.tolist()):
                if low <= reach:
                    heapq.heappush(queue, (low, int(page.ids[e]), d))
    return ids, scores


def integer_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(1024 x) of every usable vector."""
    usable = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 1024.0).cast("double"))
    return rows.where(usable & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def write_trees(vectors: DataFrame, path: str) -> None:
    """Bulk-load trees from (vec_id, v) rows where they lie and write them under ``path``."""
    schema = arrow_schema(TREES)

    def tree(ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        top, pages = build(np.concatenate(ids), np.concatenate(parts))
        rows = [{"leaf": p.leaf, "vectors": p.vectors.tobytes(), "ids": p.ids.tobytes(), "radius": p.radius.tobytes(), "parent": p.parent.tobytes()} for p in pages]
        return pa.RecordBatch.from_pylist([{"dim": parts[0].shape[1], "top": top, "pages": rows}], schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(size).tolist():
                own = pa.array(np.flatnonzero(size == dim))
                ids, parts = held.setdefault(dim, ([], []))
                new_ids, new = batch.column(0).take(own).to_numpy(), _matrix(batch.column(1).take(own), dim)
                for a in range(0, len(new_ids), TREE_ROWS):
                    if ids and sum(map(len, ids)) + len(new_ids[a:a + TREE_ROWS]) > TREE_ROWS:
                        yield tree(ids, parts)
                        ids.clear(), parts.clear()
                    ids.append(new_ids[a:a + TREE_ROWS])
                    parts.append(new[a:a + TREE_ROWS])
        for ids, parts in held.values():
            yield tree(ids, parts)

    vectors.select("vec_id", "v").mapInArrow(load, TREES).write.parquet(path)


def top_k(queries: DataFrame, path: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best ``k`` vectors of the trees under ``path`` for each query (vec_id, v)."""
    spark = queries.sparkSession
    trees = spark.read.parquet(path)
    lanes = max(1, trees.select("dim").count())
    schema = arrow_schema(HITS)
    trees = trees.withColumn("lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)))
    asked = queries.select("vec_id", "v").distinct()
    size = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    blocks = (asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(size)).alias("_block"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
              .withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                top, dim = one.column(0)[0].as_py(), one.column(1)[0].as_py()
                pages = [Page(p["leaf"], np.frombuffer(p["vectors"]).reshape(-1, dim + 1), np.frombuffer(p["ids"], np.int64), np.frombuffer(p["radius"]),
                              np.frombuffer(p["parent"])) for p in one.column(2)[0].as_py()]
                asked = one.column(3).flatten()
                names, vectors = asked.field("vec_id").to_numpy(), _matrix(asked.field("v"), dim)
                for name, vector in zip(names.tolist(), vectors):
                    ids, scores = search(top, pages, name, vector, k)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, zlib.crc32(vector.tobytes()))), pa.array(ids),
                                                      pa.array(np.clip(scores, -2.0 ** 62, 2.0 ** 62).astype(np.int64))], schema=schema)

    hits = trees.join(blocks, ["lane", "dim"]).select("top", "dim", "pages", "asked").mapInArrow(look, HITS)
    best = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 10, path: str | None = None) -> DataFrame:
    """Search the rows for which ``is_query`` (over vec_id) holds against all rows."""
    vectors = integer_vectors(rows)
    path = path or scratch_path(rows.sparkSession, "trees")
    write_trees(vectors, path)
    return top_k(vectors.where(is_query), path, k)
