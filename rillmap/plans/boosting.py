"""Boosted trees of many training sets at once, level by level, on counted cells.

The trees are those of Spark ML's ``GBTRegressor`` and ``GBTClassifier`` (squared error and log loss, variance splits of binned inputs, the first tree on the target
itself). Its fits take some four jobs a tree and read each training set apart. Here the rows are read once and counted by block (the part of the table that a
row lies in, such as its fold), target and the stretches between the borders of any fit's bins; a fit's own cells follow from the counts, by its blocks and its bins. All
fits then grow together: one job a level gives the sums of every bin of every open node of every fit, and the driver, which sees no row, picks the splits. A row of a cell stands for
all its copies: a draw of rows is a binomial draw of them, so cells may be merged freely.

Cells live in tasks as numpy arrays, spread over partitions; nothing but sums by bin reaches the driver.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.session import shared_dir, stored

MERGED = 1 << 20                 # rows that a task gathers before it merges equal ones
CHUNK = 1 << 19                  # cells that are worked on at a time
MOST_FEATURES = 512
MOST_CODES = 4096                # combinations of codes that are predicted beforehand
KEEP_ROUNDS = 16                 # rounds after which the lineage of the cells is cut
MANY_PARTS = 64                  # partitions whose sums go to the driver as they are
_WORD = 1 << 62


# ---- cells

@dataclass(frozen=True)
class Places:
    """How inputs become places: a number by the edges that are not beyond it, a category by its label. Place 0 is a missing value, the last one NaN or any other label."""
    edges: dict[str, np.ndarray]
    labels: dict[str, dict[str, int]]

    def names(self) -> list[str]:
        return [*self.edges, *self.labels]

    def sizes(self) -> list[int]:
        return [*(len(e) + 3 for e in self.edges.values()), *(len(x) + 2 for x in self.labels.values())]

    def columns(self) -> list[Column]:
        return [*(F.col(c).cast("double") for c in self.edges), *(F.col(c).cast("string") for c in self.labels)]

    def of(self, arrays: Sequence[pa.Array]) -> list[np.ndarray]:
        out = []
        for a, edges in zip(arrays, self.edges.values()):
            v = a.to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, v, "right") + 1
            if np.isnan(v).any():
                at[np.isnan(v)] = len(edges) + 2
            if a.null_count:
                at[a.is_null().to_numpy(zero_copy_only=False)] = 0
            out.append(at)
        for a, labels in zip(arrays[len(self.edges):], self.labels.values()):
            codes = a.dictionary_encode()
            table = np.array([*[labels.get(s, len(labels) + 1) for s in codes.dictionary.to_pylist()], 0], np.int64)
            out.append(table[codes.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)])
        return out


@dataclass(frozen=True)
class Fit:
    """A model to fit: the blocks it is trained on, the code of every place of each feature's input, and its settings. ``targets`` are given by block where the
    target is not a column."""
    blocks: np.ndarray
    features: tuple[tuple[int, np.ndarray], ...]
    kind: str
    targets: np.ndarray | None = None
    seed: int = 0
    settings: dict = field(default_factory=dict)

    def of(self, name: str):
        usual = {"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8 if self.kind == "boosted" else 1.0, "minInstancesPerNode": 1, "minInfoGain": 0.0}
        return {**usual, **self.settings}[name]

    def sizes(self) -> list[int]:
        return [int(table.max()) + 1 for _, table in self.features]

    def codes(self, places: Sequence[np.ndarray]) -> np.ndarray:
        out = np.empty((len(places[0]) if places else 0, len(self.features)), np.uint8 if max(self.sizes(), default=0) <= 256 else np.uint16)
        for j, (column, table) in enumerate(self.features):
            out[:, j] = table[places[column]]
        return out


SETTINGS = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "minInfoGain", "maxBins"}


def _words(sizes: Sequence[int]) -> list[list[int]]:
    """Which places share a 64-bit word."""
    out, room = [[]], 1
    for i, s in enumerate(sizes):
        if out[-1] and room * s >= _WORD:
            out, room = [*out, []], 1
        out[-1].append(i)
        room *= s
    return out


def _pack(places: Sequence[np.ndarray], sizes: Sequence[int]) -> list[np.ndarray]:
    n = len(places[0])
    return [reduce(lambda w, i: w * sizes[i] + places[i], own, np.zeros(n, np.int64)) for own in _words(sizes)]


def _unpack(words: Sequence[np.ndarray], sizes: Sequence[int]) -> list[np.ndarray]:
    out: list = [None] * len(sizes)
    for w, own in zip(words, _words(sizes)):
        for i in reversed(own):
            w, out[i] = np.divmod(w, sizes[i])
    return out


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows with equal keys as one row with the sums."""
    bits = [k.view(np.uint64) for k in keys]
    with np.errstate(over="ignore"):
        mixed = reduce(lambda h, b: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (b * np.uint64(0x9E3779B97F4A7C15)), bits, np.zeros(len(bits[0]), np.uint64))
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    if any((b[first][which] != b).any() for b in bits):             # two keys of one mixture
        order = np.lexsort(bits)
        new = np.ones(len(order), bool)
        new[1:] = np.any([b[order][1:] != b[order][:-1] for b in bits], axis=0)
        first, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
    return [k[first] for k in keys], [np.bincount(which, weights=s, minlength=len(first)) for s in sums]


def _merging(parts: Iterator[tuple[list[np.ndarray], list[np.ndarray]]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (keys, sums), merged as far as a task can hold them."""
    held, rows = [], 0

    def one() -> tuple[list[np.ndarray], list[np.ndarray]]:
        return _merged(*([np.concatenate(x) for x in zip(*side)] for side in zip(*held)))

    def batch(keys: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *sums)], names=list(names))

    for part in parts:
        held.append(part)
        rows += len(part[1][0])
        if rows >= MERGED:
            keys, sums = one()
            held, rows = [(keys, sums)], len(sums[0])
            if rows > MERGED // 2:
                yield batch(keys, sums)
                held, rows = [], 0
    if rows:
        yield batch(*one())


def _summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored(rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("v").alias("v")))


def count_cells(df: DataFrame, block: str, blocks: int, target: Column, places: Places, weight: Column | None = None) -> DataFrame:
    """The number (and weight) of rows by block, target and places, in one scan. ``block`` is a number below ``blocks``; rows without one are left out."""
    sizes = [blocks, *places.sizes()]
    keys = [*(f"w{i}" for i in range(len(_words(sizes)))), "y"]
    rows = df.where(F.col(block).isNotNull()).select(F.col(block).cast("int").alias("_b"), target.cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_v"),
                                                     *[c.alias(f"_x{i}") for i, c in enumerate(places.columns())])

    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                at = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *places.of(b.columns[3:])]
                y, v = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                yield [*_pack(at, sizes), y], [np.ones(len(y)), v]

    schema = ", ".join([*(f"{k} {'double' if k == 'y' else 'bigint'}" for k in keys), "n double, v double"])
    return _summed(rows.mapInArrow(lambda batches: _merging(each(batches), [*keys, "n", "v"]), schema), keys)


def _cells(counted: DataFrame, blocks: int, places: Places, fits: Sequence[Fit]) -> DataFrame:
    """The cells of every fit: (f, w.., y, n, v) by its own blocks and codes."""
    sizes = [blocks, *places.sizes()]
    width = max(len(_words(f.sizes())) for f in fits)
    words, keys = len(_words(sizes)), ["f", *(f"w{i}" for i in range(width)), "y"]

    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            block, *at = _unpack(x[:words], sizes)
            for i, f in enumerate(fits):
                own = np.flatnonzero(f.blocks[block])
                if len(own):
                    codes = [table[at[column][own]].astype(np.int64) for column, table in f.features]
                    packed = _pack(codes, f.sizes()) if codes else []
                    none = np.zeros(len(own), np.int64)
                    y = x[words][own] if f.targets is None else f.targets[block[own]]
                    yield [none + i, *packed, *[none] * (width - len(packed)), y], [x[words + 1][own], x[words + 2][own]]

    schema = ", ".join([*(f"{k} {'double' if k == 'y' else 'bigint'}" for k in keys), "n double, v double"])
    return _summed(counted.mapInArrow(lambda batches: _merging(each(batches), [*keys, "n", "v"]), schema), keys)


# ---- trees

@dataclass
class Tree:
    """Nodes in the order in which they were made. A row goes to ``left``, or to the node after it if its code is beyond ``cut``; a leaf leads to itself."""
    feature: list[int]
    cut: list[int]
    left: list[int]
    value: list[float]
    depth: int = 0

    def arrays(self) -> tuple:
        return np.array(self.feature, np.int64), np.array(self.cut, np.int64), np.array(self.left, np.int64), np.array(self.value), self.depth


LEAF = 1 << 20


def _walk(tree: tuple, codes: np.ndarray) -> np.ndarray:
    """The node of each row."""
    feature, cut, left, _, depth = tree
    node = np.zeros(len(codes), np.int64)
    flat, base = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    for _ in range(depth):
        node = left[node] + (flat[base + feature[node]] > cut[node])
    return node


@dataclass(frozen=True)
class Forest:
    """A fitted model: the sum of its trees' values, from places of inputs."""
    fit: Fit
    trees: tuple
    held: dict = field(default_factory=dict, compare=False)

    def predict(self, places: Sequence[np.ndarray], n: int) -> np.ndarray:
        """Predictions, for a classifier the probability of 1. Where few codes go together, each of their combinations is predicted once."""
        codes, sizes = self.fit.codes(places), self.fit.sizes()
        if not sizes or prod(sizes) > MOST_CODES:
            return self._sum(codes, n)
        if "table" not in self.held:
            every = np.stack(np.unravel_index(np.arange(prod(sizes)), sizes), axis=1).astype(codes.dtype)
            self.held["table"] = self._sum(every, len(every))
        return self.held["table"][np.ravel_multi_index(tuple(codes.T), sizes)]

    def _sum(self, codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for i, t in enumerate(self.trees):
            out += (self.fit.of("stepSize") if i else 1.0) * (t[3][_walk(t, codes)] if codes.shape[1] else t[3][0])
        return out if self.fit.kind == "boosted" else 1.0 / (1.0 + np.exp(-2.0 * out))


def _chunks(fits: Sequence[Fit], width: int):
    """A partition's cells as pickled chunks: {fit: codes, target, copies, weight of a copy, and, from the first round on, margin, answer and drawn weight}."""
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seq = [], 0, 0

        def chunk() -> pa.RecordBatch:
            x = [np.concatenate(c) for c in zip(*held)]
            out = {"id": (TaskContext.get().partitionId(), seq)}
            for i in np.unique(x[0]).tolist():
                own, f = x[0] == i, fits[i]
                sizes = f.sizes()
                codes = np.zeros((int(own.sum()), len(sizes)), np.uint8 if max(sizes, default=0) <= 256 else np.uint16)
                for j, c in enumerate(_unpack([w[own] for w in x[1:1 + width]], sizes) if sizes else ()):
                    codes[:, j] = c
                y, n, v = (c[own] for c in x[1 + width:])
                if f.kind == "classifier":
                    if not np.isin(y, (0.0, 1.0)).all():
                        raise ValueError("a classifier's target is 0 or 1")
                    y = 2.0 * y - 1.0
                out[i] = {"codes": codes, "y": y, "n": n, "u": None if (n == v).all() else v / n}
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out, 5)], pa.binary())], names=["chunk"])

        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                rows += b.num_rows
                if rows >= CHUNK:
                    yield chunk()
                    held, rows, seq = [], 0, seq + 1
        if rows:
            yield chunk()

    return of_partition


def _round(chunk: dict, fits: Sequence[Fit], t: int, trees: dict[int, tuple]) -> dict:
    """The chunk at the start of round ``t``: margins with the last trees, what is left of the target, and the drawn copies."""
    out = {"id": chunk["id"]}
    for i, c in chunk.items():
        if i == "id" or t >= fits[i].of("maxIter"):
            continue
        f, y = fits[i], c["y"]
        if t:
            margin = c.get("margin", 0.0) + (f.of("stepSize") if t > 1 else 1.0) * trees[i][3][_walk(trees[i], c["codes"])]
            rest = 2.0 * (y - margin) if f.kind == "boosted" else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
        else:
            margin, rest = np.zeros(len(y)), y
        share, drawn = f.of("subsamplingRate"), c["n"]
        if share < 1.0:
            drawn = np.random.default_rng([f.seed, t, i, *chunk["id"]]).binomial(c["n"].astype(np.int64), share).astype(float)
        out[i] = {**c, "margin": margin, "rest": rest, "drawn": drawn}
    return out


def _sums(chunks: Iterator[dict], fits: Sequence[Fit], trees: dict[int, tuple[tuple, np.ndarray, int]]) -> Iterator[dict[int, np.ndarray]]:
    """For every open node, feature and code: the drawn copies, their weight and the weighted sum of what is left."""
    total: dict[int, np.ndarray] = {}
    for chunk in chunks:
        for i, (tree, slot, slots) in trees.items():
            if i not in chunk:
                continue
            c, f = chunk[i], fits[i]
            at, live = slot[_walk(tree, c["codes"])], None
            codes, drawn, rest, unit = c["codes"], c["drawn"], c["rest"], c["u"]
            if (at < 0).any():
                live = np.flatnonzero(at >= 0)
                at, codes, drawn, rest = at[live], codes[live], drawn[live], rest[live]
                unit = None if unit is None else unit[live]
            weight = drawn if unit is None else drawn * unit
            left, size = weight * rest, max(f.sizes(), default=1)
            own = np.zeros((3, slots, max(1, codes.shape[1]), size))
            base = at * size
            for j in range(max(1, codes.shape[1])):
                index = base + codes[:, j] if codes.shape[1] else base
                own[1, :, j] = np.bincount(index, weight, slots * size).reshape(slots, size)
                own[2, :, j] = np.bincount(index, left, slots * size).reshape(slots, size)
                own[0, :, j] = own[1, :, j] if unit is None else np.bincount(index, drawn, slots * size).reshape(slots, size)
            total[i] = total[i] + own if i in total else own
    yield total


def _both(a: dict, b: dict) -> dict:
    return {i: a[i] + b[i] if i in a and i in b else a.get(i, b.get(i)) for i in {*a, *b}}


def _grow(tree: Tree, open_: list[int], sums: np.ndarray, fit: Fit) -> list[int]:
    """Split the open nodes where that helps; the new nodes."""
    copies, weight, rest = sums
    whole = [x[:, :1].sum(axis=2, keepdims=True) for x in (copies, weight, rest)]
    with np.errstate(divide="ignore", invalid="ignore"):
        lc, lw, lr = (np.cumsum(x, axis=2)[:, :, :-1] for x in (copies, weight, rest))
        rc, rw, rr = (w - x for w, x in zip(whole, (lc, lw, lr)))
        now = whole[2] ** 2 / whole[1]
        gain = (lr ** 2 / lw + rr ** 2 / rw - now) / whole[1]
        least = fit.of("minInstancesPerNode") - 0.5
        valid = (lc > least) & (rc > least) & (lw > 0) & (rw > 0) & (gain > 1e-13 * np.abs(now / whole[1])) & (gain >= fit.of("minInfoGain"))
    made = []
    for s, node in enumerate(open_):
        w, r = float(whole[1][s, 0, 0]), float(whole[2][s, 0, 0])
        tree.value[node] = r / w if w > 0 else 0.0
        if not valid[s].any():
            continue
        j, b = divmod(int(np.argmax(np.where(valid[s], gain[s], -np.inf))), valid.shape[2])
        tree.feature[node], tree.cut[node], tree.left[node] = j, b, len(tree.value)
        for value in (lr[s, j, b] / lw[s, j, b], rr[s, j, b] / rw[s, j, b]):
            at = len(tree.value)
            made.append(at)
            tree.feature.append(0), tree.cut.append(LEAF), tree.left.append(at), tree.value.append(float(value))
    return made


def fit_forests(counted: DataFrame, blocks: int, places: Places, fits: Sequence[Fit]) -> list[Forest]:
    """All ``fits`` from the cells of ``count_cells``; one job a level for all of them."""
    if not fits:
        return []
    spark = counted.sparkSession
    context, width = spark.sparkContext, max(len(_words(f.sizes())) for f in fits)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    packed = _cells(counted, blocks, places, fits).mapInArrow(_chunks(fits, width), "chunk binary")
    state = packed.rdd.map(lambda r: pickle.loads(r[0]))
    parts, last, trees = state.getNumPartitions(), None, [[] for _ in fits]
    for t in range(max(f.of("maxIter") for f in fits)):
        state = state.map(partial(_round, fits=fits, t=t, trees={i: own[-1] for i, own in enumerate(trees) if own})).persist(StorageLevel.MEMORY_AND_DISK)
        if t and t % KEEP_ROUNDS == 0:
            state.checkpoint()
        growing = {i: (Tree([0], [LEAF], [0], [0.0]), [0]) for i, f in enumerate(fits) if t < f.of("maxIter")}
        for level in range(max(fits[i].of("maxDepth") for i in growing) or 1):
            asked = {}
            for i, (tree, open_) in growing.items():
                if open_:
                    slot = np.full(len(tree.value), -1, np.int64)
                    slot[open_] = np.arange(len(open_))
                    asked[i] = (tree.arrays(), slot, len(open_))
            if not asked:
                break
            found = state.mapPartitions(partial(_sums, fits=fits, trees=asked))
            sums = found.treeReduce(_both, 2) if parts > MANY_PARTS else reduce(_both, found.collect(), {})
            for i in asked:
                tree, open_ = growing[i]
                if i not in sums:
                    raise ValueError("no rows to fit a model on")
                made = _grow(tree, open_, sums[i], fits[i]) if fits[i].of("maxDepth") > level else []
                if made:
                    tree.depth = level + 1
                growing[i] = tree, made if level + 1 < fits[i].of("maxDepth") else []
        for i, (tree, _) in growing.items():
            trees[i].append(tree.arrays())
        if last is not None:
            last.unpersist()
        last = state
    if last is not None:
        last.unpersist()
    return [Forest(f, tuple(own)) for f, own in zip(fits, trees)]


def prediction(places: Places, models: dict[int, Forest], key: Column) -> Column:
    """The prediction of the model that a row's ``key`` (a number) names; null where it names none."""
    @F.arrow_udf("double")
    def predict(k: pa.Array, *inputs: pa.Array) -> pa.Array:
        return pa.array(predictions(places, models, k, inputs), from_pandas=True)

    return predict(key.cast("int"), *places.columns())


def predictions(places: Places, models: dict[int, Forest], key: pa.Array, inputs: Sequence[pa.Array]) -> np.ndarray:
    """``prediction`` of an Arrow batch; NaN where no model is named."""
    which = key.fill_null(-1).to_numpy(zero_copy_only=False)
    at, out = places.of(inputs), np.full(len(which), np.nan)
    for k in np.unique(which).tolist():
        if k in models:
            own = np.flatnonzero(which == k)
            out[own] = models[k].predict([a[own] for a in at], len(own))
    return out
