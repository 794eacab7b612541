"""Linear models of all folds, penalties and input sets from one grouped scan.

The scan gives, per fold, the row count, the means and the co-moments of all inputs and the target: (p + 1)(p + 2) / 2 numbers a fold, whatever the number of
rows. Spark merges them pairwise (map-side first), so nothing cancels. Everything after that is arithmetic on p x p matrices: the training rows of a fold are
the merged moments of the other folds, a ridge path is one solve a penalty, an elastic-net path is coordinate descent with warm starts, and the
squared error of any linear model on any fold follows from the fold's moments without predicting a row. Penalties are chosen by inner folds, which are the
outer folds that are left, so a choice never sees the held-out fold.

Inputs are standardised on the training rows and coefficients returned in the inputs' units; an input that is constant there gets 0. Rows where the
target or an input is null, NaN or infinite take no part; a fold without rows has no moments. A null fold is a fold of its own.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from rillmap.session import small

MOST_INPUTS, MOST_FOLDS = 64, 10_000
PLAIN_INPUTS = 4                 # inputs whose sums fit into Spark's generated code
ORIGIN_ROWS = 1_000              # rows whose means are the origin of weighted sums
RIDGE = tuple(float(x) for x in np.logspace(-3, 3, 25))
L1_RATIOS = (0.1, 0.5, 0.9, 1.0)
STEPS, SPAN = 50, 1e-3           # penalties of an elastic-net path, and the last one as a part of the first
SWEEPS, TOLERANCE = 5000, 1e-10
EQUAL = 1e-9                     # errors that agree to this part are equally good; the largest penalty of them is chosen


@dataclass(frozen=True)
class Moments:
    """Rows, means and co-moments (sums of products of deviations) of the inputs and, last, the target."""
    n: float
    mean: np.ndarray
    co: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.co + other.co + np.outer(d, d) * (self.n * other.n / n))

    def of(self, places: Sequence[int]) -> "Moments":
        """The moments of some inputs and the target."""
        at = [*places, len(self.mean) - 1]
        return Moments(self.n, self.mean[at], self.co[np.ix_(at, at)])

    def less(self, places: Sequence[int], model: "Linear") -> "Moments":
        """The moments of the inputs and, last, what a model of the inputs at ``places`` leaves of the target."""
        turn = np.eye(len(self.mean))
        turn[-1, list(places)] -= model.weights
        mean = turn @ self.mean
        mean[-1] -= model.intercept
        return Moments(self.n, mean, turn @ self.co @ turn.T)


@dataclass(frozen=True)
class Linear:
    intercept: float
    weights: np.ndarray

    def sse(self, m: Moments) -> float:
        """Sum of squared errors on the rows behind ``m``."""
        w = np.append(-self.weights, 1.0)
        return float(w @ m.co @ w + m.n * (w @ m.mean - self.intercept) ** 2)

    def bias(self, m: Moments) -> float:
        """Sum of prediction minus truth."""
        return float(m.n * (self.intercept - np.append(-self.weights, 1.0) @ m.mean))


def moments(df: DataFrame, columns: Sequence[str], target: str, fold: str) -> dict:
    """The moments of each fold by one grouped scan."""
    if len(columns) > MOST_INPUTS:
        raise ValueError(f"more than {MOST_INPUTS} inputs")
    names = [f"z{i}" for i in range(len(columns) + 1)]
    z = df.select(F.col(fold).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip([*columns, target], names)])
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])
    z = z.where(whole)
    if len(columns) > PLAIN_INPUTS:
        return collected(_packed_moments(z, names), len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    co = F.array(*[F.covar_pop(names[min(i, j)], names[max(i, j)]) * F.count("*") for i, j in pairs]).alias("co")
    return collected(z.groupBy("k").agg(F.count("*").cast("double").alias("n"), F.array(*[F.avg(n) for n in names]).alias("mean"), co), len(names))


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])


def _by_fold(keys: pa.Array) -> list[tuple[object, np.ndarray]]:
    """Each fold of a batch with the places of its rows."""
    codes = keys.dictionary_encode(null_encoding="encode")
    at, found = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    order = np.argsort(at, kind="stable")
    return list(zip(found, np.split(order, np.cumsum(np.bincount(at, minlength=len(found)))[:-1])))


def _packed_moments(z: DataFrame, names: Sequence[str]) -> DataFrame:
    """(k, n, mean, co) of each fold as matrix products of Arrow batches. Generated code holds the sums of few inputs only; those of many would be taken one value at a time."""
    def parts(b: pa.RecordBatch) -> Iterator[tuple]:
        x = _matrix(b, names)
        for k, at in _by_fold(b.column(0)):
            if len(at):
                yield k, of_rows(x[at])

    return merged_moments(z, parts, z.schema["k"].dataType.simpleString(), len(names))


def of_rows(x: np.ndarray, weight: np.ndarray | None = None) -> Moments:
    """The moments of a batch of rows, the target last; with ``weight`` the counts and sums are weighted."""
    if weight is None:
        mean = x.mean(axis=0)
        own = x - mean
        return Moments(float(len(x)), mean, own.T @ own)
    n = float(weight.sum())
    mean = weight @ x / n if n else np.zeros(x.shape[1])
    own = x - mean
    return Moments(n, mean, own.T @ (own * weight[:, None]))


def merged_moments(z: DataFrame, parts: Callable[[pa.RecordBatch], Iterator[tuple]], kind: str, width: int) -> DataFrame:
    """(k, n, mean, co): the moments that ``parts`` gives for keys of Arrow batches, merged pairwise in each task and then by key."""
    schema = f"k {kind}, n double, mean array<double>, co array<double>"
    key = to_arrow_type(_parse_datatype_string(kind))

    def rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), key), pa.array([m.n for m in found.values()], pa.float64()),
                                           *[pa.array([np.ravel(v).tolist() for v in vs], pa.list_(pa.float64())) for vs in ([m.mean for m in found.values()], [m.co for m in found.values()])]],
                                          names=["k", "n", "mean", "co"])

    def of_task(batches):
        found = {}
        for b in batches:
            for k, part in parts(b):
                found[k] = found[k] + part if k in found else part
        if found:
            yield rows(found)

    def of_fold(table: pa.Table) -> pa.Table:
        parts = [Moments(r["n"], np.array(r["mean"]), np.array(r["co"]).reshape(width, width)) for r in table.to_pylist()]
        while len(parts) > 1:
            parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return pa.Table.from_batches([rows({table["k"][0].as_py(): parts[0]})])

    return z.mapInArrow(of_task, schema).groupBy("k").applyInArrow(of_fold, schema)


def collected(found: DataFrame, width: int) -> dict:
    """{k: moments} of a table of them, by key."""
    rows = found.limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    out = {r["k"]: Moments(r["n"], np.array(r["mean"]), np.array(r["co"]).reshape(width, width)) for r in rows}
    return dict(sorted(out.items(), key=lambda x: (x[0] is None, x[0])))


def absolute_errors(df: DataFrame, columns: Sequence[str], target: str, fold: str, fits: Sequence[dict]) -> list[dict]:
    """For each of ``fits`` ({fold: model}) the mean absolute error of every fold it has a model for; rows without a target take no part. One scan for all fits."""
    keys = [k for k in fits[0] if k is not None]
    weights = {k: np.column_stack([f[k].weights for f in fits]) for k in keys}
    starts = {k: np.array([f[k].intercept for f in fits]) for k in keys}
    names = [f"z{i}" for i in range(len(columns) + 1)]
    z = df.where(F.col(target).isNotNull() & F.col(fold).isin(*keys)).select(F.col(fold).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip([*columns, target], names)])

    def of_batch(batches):
        for b in batches:
            x, out = _matrix(b, names), []
            for k, at in _by_fold(b.column(0)):
                if len(at):
                    out.append((k, len(at), np.abs(x[at, :-1] @ weights[k] + starts[k] - x[at, -1:]).sum(axis=0)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type), pa.array([o[1] for o in out], pa.int64()),
                                              *[pa.array([float(o[2][i]) for o in out], pa.float64()) for i in range(len(fits))]], names=["k", "n", *[f"e{i}" for i in range(len(fits))]])

    parts = z.mapInArrow(of_batch, f"k {z.schema['k'].dataType.simpleString()}, n bigint, " + ", ".join(f"e{i} double" for i in range(len(fits))))
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(len(fits))]).collect()          # one row a fold
    return [{r["k"]: r[f"e{i}"] / r["n"] for r in rows} for i in range(len(fits))]


def complete_moments(df: DataFrame, columns: Sequence[str], target: str, fold: str, weight: str | None = None) -> dict | None:
    """The moments of each fold over rows with a target, or None if one of them lacks an input. With ``weight`` the counts and sums are weighted."""
    found = moments_by_weight(df, columns, target, fold, [weight])
    return found and found[weight]


def moments_by_weight(df: DataFrame, columns: Sequence[str], target: str, fold: str, weights: Sequence[str | None]) -> dict | None:
    """{weight: ``complete_moments`` with it} by one scan, which counts the gaps too (None: every row counts once). More than ``PLAIN_INPUTS`` inputs without a
    weight take a scan of their own. Weighted sums are taken around the means of some first rows, so nothing cancels; any place inside the data would do."""
    if len(columns) > MOST_INPUTS:
        raise ValueError(f"more than {MOST_INPUTS} inputs")
    values = [F.col(c).cast("double") for c in [*columns, target]]
    finite = [F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for v in values]
    rows, gap = df.where(F.col(target).isNotNull()), ~reduce(lambda a, b: a & b, finite[:-1], F.lit(True))
    if list(weights) == [None] and len(columns) > PLAIN_INPUTS:
        return None if rows.agg(F.count_if(gap)).first()[0] else {None: moments(rows, columns, target, fold)}
    names, origin = [f"z{i}" for i in range(len(values))], np.zeros(len(values))
    if any(weights):
        some = np.array(rows.select(*values).head(ORIGIN_ROWS), dtype=float).reshape(-1, len(values))
        some = some[np.isfinite(some).all(axis=1)]
        origin = some.mean(axis=0) if len(some) else origin
    z = rows.where(gap | finite[-1]).select(F.col(fold).alias("k"), gap.alias("gap"), *[(v - F.lit(float(o)) if o else v).alias(n) for v, o, n in zip(values, origin, names)],
                                            *[F.col(w).cast("double").alias(f"w{i}") for i, w in enumerate(weights) if w])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.count_if("gap").alias("gaps")]
    for i, w in enumerate(weights):
        if w:
            sums += [F.sum(f"w{i}").alias(f"n{i}"), *[F.sum(F.col(f"w{i}") * F.col(n)).alias(f"m{i}_{a}") for a, n in enumerate(names)],
                     *[F.sum(F.col(f"w{i}") * F.col(names[a]) * F.col(names[b])).alias(f"c{i}_{a}_{b}") for a, b in pairs]]
        else:
            sums += [F.count("*").cast("double").alias(f"n{i}"), *[F.avg(n).alias(f"m{i}_{a}") for a, n in enumerate(names)],
                     *[(F.covar_pop(names[a], names[b]) * F.count("*")).alias(f"c{i}_{a}_{b}") for a, b in pairs]]
    found = z.groupBy("k").agg(*sums).limit(MOST_FOLDS + 1).collect()
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    if any(r["gaps"] for r in found):
        return None
    out: dict = {w: {} for w in weights}
    for r in sorted(found, key=lambda r: (r["k"] is None, r["k"])):
        for i, w in enumerate(weights):
            n = r[f"n{i}"]
            if not n:
                continue
            off, co = np.array([r[f"m{i}_{a}"] for a in range(len(names))]), np.zeros((len(names), len(names)))
            for a, b in pairs:
                co[a, b] = co[b, a] = r[f"c{i}_{a}_{b}"] - (off[a] * off[b] / n if w else 0.0)
            out[w][r["k"]] = Moments(float(n), origin + (off / n if w else off), co)
    return out


def penalised(m: Moments, regParam: float = 0.0, elasticNetParam: float = 0.0) -> Linear:
    """The fit of Spark ML's ``LinearRegression`` with these settings, from moments: it penalises weights of standardised inputs for a standardised target."""
    spread = float(np.sqrt(max(m.co[-1, -1], 0.0) / m.n)) if m.n else 0.0
    if spread == 0.0:
        return Linear(float(m.mean[-1]), np.zeros(len(m.mean) - 1))
    l1, l2 = regParam * elasticNetParam, regParam * (1.0 - elasticNetParam) / spread
    return net_path(m, l1 / (l1 + l2), [l1 + l2])[0] if l1 else ridge_path(m, [m.n * l2])[0]


def without_each(parts: dict) -> dict:
    """For every fold the merged moments of all others, in a number of merges that grows with the folds, not their square."""
    keys = list(parts)
    p = len(parts[keys[0]].mean) if keys else 1
    none = Moments(0.0, np.zeros(p), np.zeros((p, p)))
    before, after = [none], [none]
    for k in keys:
        before.append(before[-1] + parts[k])
    for k in reversed(keys):
        after.append(parts[k] + after[-1])
    return {k: before[i] + after[len(keys) - 1 - i] for i, k in enumerate(keys)}


def _standard(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of the inputs, their covariances with the target at unit variance, and the spreads (0 where constant)."""
    spread = np.sqrt(np.maximum(np.diag(m.co)[:-1], 0) / m.n) if m.n else np.zeros(len(m.mean) - 1)
    spread = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(m.mean[:-1])), spread, 0.0)
    by = np.where(spread > 0, spread, 1.0)
    live = spread > 0
    corr = m.co[:-1, :-1] / m.n / np.outer(by, by) * np.outer(live, live) if m.n else np.zeros((len(by), len(by)))
    return corr, (m.co[:-1, -1] / m.n / by * live if m.n else np.zeros(len(by))), spread


def _unscaled(m: Moments, w: np.ndarray, spread: np.ndarray) -> Linear:
    w = np.divide(w, spread, out=np.zeros_like(w), where=spread > 0)
    return Linear(float(m.mean[-1] - w @ m.mean[:-1]), w)


def ridge_path(m: Moments, penalties: Sequence[float] = RIDGE) -> list[Linear]:
    """Least squares with ``penalty`` times the squared length of the standardised weights, for every penalty (0: plain least squares)."""
    corr, r, spread = _standard(m)
    values, axes = np.linalg.eigh(corr)
    turned = axes.T @ r
    gain = lambda a: values + a / max(m.n, 1.0)
    return [_unscaled(m, axes @ np.divide(turned, gain(a), out=np.zeros_like(turned), where=gain(a) > 1e-12), spread) for a in penalties]


def net_penalties(m: Moments, l1_ratio: float, steps: int = STEPS) -> list[float]:
    """Falling penalties from the smallest one at which all weights are 0."""
    top = float(np.abs(_standard(m)[1]).max(initial=0.0)) / l1_ratio
    return [top * SPAN ** (i / max(1, steps - 1)) for i in range(steps)]


def net_path(m: Moments, l1_ratio: float, penalties: Sequence[float]) -> list[Linear]:
    """Minimises mean squared error / 2 + penalty * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w'w) by coordinate descent, each step from the last one's weights."""
    corr, r, spread = _standard(m)
    w, out = np.zeros(len(r)), []
    live = np.flatnonzero(spread > 0)
    for a in penalties:
        for _ in range(SWEEPS):
            moved = 0.0
            for j in live:
                free = r[j] - corr[j] @ w + w[j]
                new = np.sign(free) * max(abs(free) - a * l1_ratio, 0.0) / (1.0 + a * (1.0 - l1_ratio))
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved <= TOLERANCE * max(1.0, float(np.abs(r).max(initial=0.0))):
                break
        out.append(_unscaled(m, w.copy(), spread))
    return out


@dataclass(frozen=True)
class Choice:
    """One setting of a path with its inner error; ``model`` is the fit on all training rows."""
    l1_ratio: float
    penalty: float
    mse: float
    chosen: bool
    model: Linear


def _paths(kind: str, m: Moments) -> list[tuple[float, list[float]]]:
    if kind == "linear":
        return [(0.0, [0.0])]
    if kind == "ridge":
        return [(0.0, list(RIDGE))]
    return [(share, net_penalties(m, share)) for share in L1_RATIOS]


def _fits(kind: str, m: Moments, share: float, penalties: Sequence[float]) -> list[Linear]:
    return net_path(m, share, penalties) if kind == "elasticnet" else ridge_path(m, penalties)


def choose(parts: dict, kind: str) -> list[Choice]:
    """All settings of ``kind`` (linear, ridge, elasticnet) on the folds ``parts``, each with its error on inner folds. Penalties of a path are those of all
    training rows. Of equally good settings the one of the largest penalty is chosen, then of the largest l1_ratio."""
    whole = reduce(lambda a, b: a + b, parts.values())
    rest = without_each(parts)
    tried = []
    for share, penalties in _paths(kind, whole):
        sums = np.zeros(len(penalties))
        for k, held in parts.items():
            if rest[k].n:
                sums += [f.sse(held) for f in _fits(kind, rest[k], share, penalties)]
        tried += [(share, float(a), float(s / whole.n), f) for a, s, f in zip(penalties, sums, _fits(kind, whole, share, penalties))]
    least = min(t[2] for t in tried)
    best = max((t for t in tried if t[2] <= least * (1 + EQUAL)), key=lambda t: (t[1], t[0]))
    return [Choice(share, a, mse, (share, a) == best[:2], f) for share, a, mse, f in tried]


def penalty_paths(parts: dict, kinds: Sequence[str] = ("ridge", "elasticnet")) -> dict:
    """{(kind, held-out fold): settings} of folds that leave at least two others."""
    return {(kind, k): choose({j: m for j, m in parts.items() if j != k}, kind) for kind in kinds for k in parts if len(parts) > 2}


def path_table(spark, paths: dict) -> DataFrame:
    """(model, fold, l1_ratio, penalty, mse, nonzero, chosen) of ``penalty_paths``."""
    rows = [(kind, None if k is None else str(k), c.l1_ratio, c.penalty, c.mse, int(np.count_nonzero(c.model.weights)), bool(c.chosen)) for (kind, k), path in paths.items() for c in path]
    return spark.createDataFrame(rows, "model string, fold string, l1_ratio double, penalty double, mse double, nonzero int, chosen boolean")


def chosen_models(paths: dict) -> dict:
    """{(kind, fold): the fit of the chosen setting}."""
    return {key: next(c.model for c in path if c.chosen) for key, path in paths.items()}


def score(parts: dict, models: dict, kinds: Sequence[str]) -> list[tuple]:
    """(model, n, rmse, r2, bias) over all held-out rows, from the moments of the held-out folds."""
    out = []
    whole = reduce(lambda a, b: a + b, parts.values())
    for kind in kinds:
        own = {k: models[kind, k] for k in parts if (kind, k) in models}
        n = sum(parts[k].n for k in own)
        sse, off = sum(f.sse(parts[k]) for k, f in own.items()), sum(f.bias(parts[k]) for k, f in own.items())
        total = float(whole.co[-1, -1])
        out.append((kind, int(n), float(np.sqrt(sse / n)) if n else None, float(1 - sse / total) if total > 0 else None, float(off / n) if n else None))
    return out


def predict_folds(df: DataFrame, columns: Sequence[str], fold: str, models: dict, name: str) -> DataFrame:
    """Add the prediction of the model that has not seen a row's fold: {fold: model}. Null where an input is null or the fold has no model."""
    rows = [(k, f.intercept, [float(x) for x in f.weights]) for k, f in models.items()]
    kind = dict(df.dtypes)[fold]
    own = small(df.sparkSession, rows, f"_k {kind}, _a double, _w array<double>")            # one row a fold
    line = reduce(lambda a, b: a + b, [F.col("_w")[i] * F.col(c).cast("double") for i, c in enumerate(columns)], F.col("_a"))
    return df.join(own, df[fold].eqNullSafe(F.col("_k")), "left").select(*[df[c] for c in df.columns], line.alias(name))


def predict_held_out(df: DataFrame, fold: str, models: dict[str, tuple[Sequence[str], dict]]) -> DataFrame:
    """Rows of the folds that have models, with one prediction a name: {name: (columns, {fold: model})}. NaN where an input is null."""
    keys = list(next(iter(models.values()))[1])
    rows = [(k, *[v for columns, fits in models.values() for v in (fits[k].intercept, [float(x) for x in fits[k].weights])]) for k in keys]
    own = small(df.sparkSession, rows, f"_k {dict(df.dtypes)[fold]}" + "".join(f", _a{i} double, _w{i} array<double>" for i in range(len(models))))   # one row a fold
    whole = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    lines = [reduce(lambda a, b: a + b, [F.col(f"_w{i}")[j] * whole(c) for j, c in enumerate(columns)], F.col(f"_a{i}")).alias(name)
             for i, (name, (columns, _)) in enumerate(models.items())]
    return df.join(own, F.col(fold) == F.col("_k")).select(*[df[c] for c in df.columns], *lines)


def ablate(parts: dict, columns: Sequence[str], sets: dict[str, Sequence[str]], path: Callable[[Moments], Linear] | None = None) -> dict[str, float]:
    """Held-out R2 of plain least squares (or ``path``) on each input set; no further scan."""
    path = path or (lambda m: ridge_path(m, [0.0])[0])
    rest = without_each(parts)
    total = float(reduce(lambda a, b: a + b, parts.values()).co[-1, -1])
    at = {c: i for i, c in enumerate(columns)}
    return {name: 1 - sum(path(rest[k].of([at[c] for c in own])).sse(parts[k].of([at[c] for c in own])) for k in parts) / total for name, own in sets.items()}


def select_forward(parts: dict, columns: Sequence[str], gain: float = 0.001) -> list[tuple[int, str, float, bool]]:
    """Add the input with the best held-out R2 until the gain is below ``gain``: (step, added, r2, kept); ties go to the name that sorts first."""
    taken: list[str] = []
    best, log = float("-inf"), []
    while len(taken) < len(columns):
        found = ablate(parts, columns, {c: [*taken, c] for c in columns if c not in taken})
        top = max(sorted(found), key=found.get)
        keep = found[top] >= best + gain
        log.append((len(taken) + 1, top, found[top], bool(keep)))
        if not keep:
            break
        taken.append(top)
        best = found[top]
    return log
