"""Models on Spark ML: preprocessing, out-of-fold prediction, stacking, weighting, selection and comparison.

Loops run over folds, groups or feature sets (a handful each); every fit and every prediction is a distributed job over the
rows. Linear models of numeric inputs come from moments of all folds (``plans.linear``); tree models are fitted on binned rows that are counted first, so a fit
does not grow with the rows beyond ``FIT_ROWS`` and the different ones. Fits that do not need each other run as concurrent Spark jobs, at most ``PARALLEL`` at a time, and their results are put together in the order of folds.
Predictions are frozen once, so later metrics do not fit again.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from itertools import count, product
from math import gcd
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmap.functions.weights import density_ratio, noisy_answer
from rillmap.operators import metrics as M
from rillmap.operators import splits as SP
from rillmap.operators.clean import clip
from rillmap.operators.ranking import null_safe_join, running_sums, seeded_key, with_rank
from rillmap.plans import boosting as BO
from rillmap.plans import linear as L
from rillmap.session import cut, small, stored

MOST_CATEGORIES = 100_000
BINS = 32                       # of a numeric input of a tree, one of them for missing values
FIT_ROWS = 1_000_000            # equal binned rows of a tree's training table are merged until one stands for a millionth of all
PARALLEL = 4                    # fits that run at the same time
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
Hook = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@contextmanager
def kept(df: DataFrame, parts: int = 0, by: str = ""):
    """A table that several fits read, spread evenly (or over ``parts`` by a column) and released when they are done."""
    df = (df.repartition(parts, by) if by else df.hint("rebalance")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def concurrently(calls: Sequence[Callable[[], object]], parallel: int | None = None) -> list:
    """The results of ``calls`` in their order, run by a bounded pool of threads that inherit the session's job properties. The first error is raised."""
    if len(calls) < 2:
        return [c() for c in calls]
    with ThreadPool(min(parallel or PARALLEL, len(calls))) as pool:
        return list(pool.imap(lambda run: run(), [inheritable_thread_target(c) for c in calls], 1))


# ---- preprocessing and single models

@dataclass
class Inputs:
    """Model inputs; ``extra`` columns go in as they are."""
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    extra: Sequence[str] = field(default_factory=tuple)

    def plus(self, *columns: str) -> "Inputs":
        return Inputs(self.numeric, self.categorical, (*self.extra, *columns))


def _borders(values: Sequence[float] | None, bins: int, common: Sequence[float] = ()) -> list[float]:
    """Splits at up to ``bins`` - 2 of the values that quantiles found: all of them if they are few, else each at the next one of ``common`` (if any)."""
    different = sorted({float(v) for v in values or () if abs(v) < float("inf")}) or [0.0]
    upper = different[1:] or different
    if len(upper) > bins - 2:
        most = [float(v) for v in values if abs(v) < float("inf")]
        upper = sorted({most[len(most) * i // (bins - 1)] for i in range(1, bins - 1)})
        known = sorted({float(v) for v in common if abs(v) < float("inf")})
        upper = sorted({known[min(int(np.searchsorted(known, v)), len(known) - 1)] for v in upper}) if known else upper
    return [float("-inf"), *upper, float("inf")]


@dataclass
class Facts:
    """What the stages of a model take from its training rows: medians of numeric inputs with gaps, common categories (most frequent first) and borders of bins."""
    medians: dict[str, float]
    labels: dict[str, list[str]]
    borders: dict[str, list[float]] = field(default_factory=dict)

    def filled(self, c: str) -> str:
        """A numeric input with its gaps filled, or a category, in SQL."""
        if c in self.labels:
            return f"coalesce(CAST({c} AS STRING), {_quoted((self.labels[c] or ['none'])[0])})"
        return f"coalesce(CAST({c} AS DOUBLE), CAST({self.medians[c]!r} AS DOUBLE))" if c in self.medians else f"CAST({c} AS DOUBLE)"


def _quoted(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _categories(train: DataFrame, categorical: Sequence[str], rare: int, counts: dict[str, Column]) -> dict[str, dict[str, list[str]]]:
    """For each of ``counts`` the categories of every column with at least ``rare`` of these rows, most frequent first, in one pass."""
    if not categorical:
        return {k: {} for k in counts}
    long = train.select("*", F.inline(F.array(*[F.struct(F.lit(c).alias("_in"), F.col(c).cast("string").alias("_is")) for c in categorical])))
    seen = long.where("_is IS NOT NULL").groupBy("_in", "_is").agg(*[n.alias(k) for k, n in counts.items()])
    common = seen.where(F.greatest(F.lit(0), F.lit(0), *[F.col(k) for k in counts]) >= rare).limit(MOST_CATEGORIES + 1).collect()
    if len(common) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    own = lambda k, c: [r["_is"] for r in sorted((r for r in common if r["_in"] == c and r[k] >= rare), key=lambda r: (-r[k], r["_is"]))]
    return {k: {c: own(k, c) for c in categorical} for k in counts}


def facts(train: DataFrame, inputs: Inputs, rare: int = 10, bins: int = 0) -> Facts:
    """The facts of one table. Only categories with at least ``rare`` rows come to the driver; more than ``MOST_CATEGORIES`` of them raise an error."""
    numeric, categorical = list(inputs.numeric), list(inputs.categorical)
    binned = [*numeric, *inputs.extra] if bins else []
    parts = F.array(*[F.lit(i / 1000) for i in range(1001)])
    found = [F.percentile_approx(F.col(c).cast("double"), parts, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(binned)]
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*numeric, *categorical]], *found).first().asDict() if numeric or categorical or found else {}
    medians = {c: M.exact_quantiles(train.where(F.col(c).isNotNull()), c, [0.5])[0] or 0.0 for c in numeric if gaps[c]}
    return Facts(medians, _categories(train, categorical, rare, {"n": F.count("*")})["n"], {c: _borders(gaps[f"q{i}"], bins) for i, c in enumerate(binned)})


def preprocess(train: DataFrame, inputs: Inputs, scale: bool = False, rare: int = 10, bins: int = 0) -> list[Transformer | Estimator]:
    """Stages: exact median imputation with missing flags, most frequent category, one-hot with rare and unknown ones pooled. With ``bins`` numeric and extra
    inputs are numbers of quantile bins of the training rows."""
    return stages_of(facts(train, inputs, rare, bins), inputs, scale)


def stages_of(found: Facts, inputs: Inputs, scale: bool = False) -> list[Transformer | Estimator]:
    """The stages of ``preprocess`` from known facts."""
    numeric, categorical, extra = list(inputs.numeric), list(inputs.categorical), list(inputs.extra)
    flagged = [c for c in numeric if c in found.medians]
    casts = [f"{found.filled(c)} AS n_{c}" for c in numeric] + [f"CAST({c} IS NULL AS DOUBLE) AS m_{c}" for c in flagged] + [f"{found.filled(c)} AS s_{c}" for c in categorical]
    stages: list = [SQLTransformer(statement=f"SELECT *{''.join(', ' + c for c in casts)} FROM __THIS__")]
    columns = [f"n_{c}" for c in numeric]
    binned = [c for c in [*numeric, *extra] if c in found.borders]
    if binned:
        stages.append(Bucketizer(inputCols=[*columns, *extra], outputCols=[f"b_{c}" for c in binned], splitsArray=[found.borders[c] for c in binned], handleInvalid="keep"))
        columns, extra = [f"b_{c}" for c in numeric], [f"b_{c}" for c in extra]
    stages += [StringIndexerModel.from_labels(found.labels[c] or ["none"], inputCol=f"s_{c}", outputCol=f"i_{c}", handleInvalid="keep") for c in categorical]
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"i_{c}" for c in categorical], outputCols=[f"o_{c}" for c in categorical], dropLast=False, handleInvalid="keep"))
    if scale and columns:
        stages += [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
        columns = ["_scaled"]
    columns = [*columns, *[f"m_{c}" for c in flagged], *[f"o_{c}" for c in categorical], *extra]
    return [*stages, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]


def design(found: Facts, inputs: Inputs) -> list[str]:
    """The features of ``preprocess`` as SQL expressions: filled numbers, missing flags, one column a common category and one for the others."""
    hot = []
    for c in inputs.categorical:
        labels = found.labels[c] or ["none"]
        hot += [f"CAST({found.filled(c)} = {_quoted(v)} AS DOUBLE)" for v in labels] + [f"CAST({found.filled(c)} NOT IN ({', '.join(map(_quoted, labels))}) AS DOUBLE)"]
    return [*[found.filled(c) for c in inputs.numeric], *[f"CAST({c} IS NULL AS DOUBLE)" for c in inputs.numeric if c in found.medians], *hot, *[f"CAST({c} AS DOUBLE)" for c in inputs.extra]]


def maker(kind: str, seed: int = 0, **params) -> Callable[[], Estimator]:
    """Factory of an untrained model by name."""
    kinds = {
        "linear": lambda: LinearRegression(regParam=0.0, **params), "ridge": lambda: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **params}),
        "elasticnet": lambda: LinearRegression(**{"regParam": 0.01, "elasticNetParam": 0.5, **params}),
        "random_forest": lambda: RandomForestRegressor(**{"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 3, "seed": seed, **params}),
        "boosted": lambda: GBTRegressor(**{"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": seed, **params}),
        "classifier": lambda: GBTClassifier(**{"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "seed": seed, **params}),
    }
    return kinds[kind]


TREES = {"random_forest", "boosted", "classifier"}
LINEAR = {"mean", "linear", "ridge", "elasticnet"}
PENALTY = {"linear": {}, "ridge": {"regParam": 0.1}, "elasticnet": {"regParam": 0.01, "elasticNetParam": 0.5}}
LADDER = ("mean", "linear", "ridge", "elasticnet", "random_forest", "boosted")


class Binned:
    """The rows of all folds, counted once by fold, target, categories and the stretch between two neighbouring borders of any training set's bins.

    Bins, medians and categories are still those of each training set (all folds but one); since every border is a border of the counted table too, the
    rows that a tree model reads follow from the counts. So the rows are read for the facts and once for the counts, whatever the number of folds and models.
    """

    def __init__(self, df: DataFrame, fold: str, folds: Sequence, inputs: Inputs, target: str, weight: str | None = None, bins: int = BINS, rare: int = 10):
        self.fold, self.inputs = fold, inputs
        numeric, categorical, binned = list(inputs.numeric), list(inputs.categorical), [*inputs.numeric, *inputs.extra]
        df = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
        parts = F.array(*[F.lit(i / 1000) for i in range(1001)])
        seen = df.groupBy(fold).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(binned)],
                                    *[F.percentile_approx(F.col(c).cast("double"), parts, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(binned)]).collect()    # one row a fold
        used = {k: [r for r in seen if r[fold] != k] for k in folds}
        self.n = {k: sum(r["_n"] for r in rows) for k, rows in used.items()}
        flagged = [(k, i, c) for k, rows in used.items() for i, c in enumerate(numeric) if any(r[f"g{i}"] for r in rows)]
        found = concurrently([lambda k=k, c=c: M.exact_quantiles(df.where((F.col(fold) != k) & F.col(c).isNotNull()), c, [0.5])[0] or 0.0 for k, _, c in flagged])
        medians = {(k, c): m for (k, _, c), m in zip(flagged, found)}
        labels = _categories(df, categorical, rare, {f"n{j}": F.count_if(F.col(fold) != k) for j, k in enumerate(folds)})
        self.facts = {k: Facts({c: medians[k, c] for c in numeric if (k, c) in medians}, labels[f"n{j}"],
                               {c: _borders(_together([(r[f"q{i}"], r["_n"] - r[f"g{i}"]) for r in used[k]]), bins) for i, c in enumerate(binned)}) for j, k in enumerate(folds)}
        self.edges = {c: sorted({b for f in self.facts.values() for b in f.borders[c]} | {float("-inf"), float("inf")}) for c in binned}
        rows = df.select(F.col(fold), F.col(target).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_v"),
                         *[F.col(c).cast("string").alias(c) for c in categorical], *[F.col(c).cast("double").alias(f"x_{c}") for c in binned])
        rows = Bucketizer(inputCols=[f"x_{c}" for c in binned], outputCols=[f"e_{c}" for c in binned], splitsArray=[self.edges[c] for c in binned], handleInvalid="keep").transform(rows) if binned else rows
        places = [F.when(F.col(f"x_{c}").isNull(), F.lit(-1)).otherwise(F.col(f"e_{c}").cast("int")).alias(f"e_{c}") for c in binned]        # -1: missing
        keys = [fold, "_y", *categorical, *[f"e_{c}" for c in binned]]
        self.counted = stored(rows.select(fold, "_y", "_v", *categorical, *places).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_v").alias("_v")))

    def rows(self, k, inputs: Inputs | None = None) -> tuple[PipelineModel, DataFrame, int]:
        """Stages up to ``features``, the rows to fit a tree model without fold ``k`` on as (features, _y, _w), and the number of training rows.

        Rows with equal bins and target are one row with their weight, as far as a row of the result stands for at most a ``FIT_ROWS``-th of the training rows
        (so that draws of rows stay fine). Up to ``FIT_ROWS`` rows every row stays one.
        """
        inputs, own, n = inputs or self.inputs, self.facts[k], self.n[k]
        stages = stages_of(own, inputs)
        head = [s for s in stages if not isinstance(s, (OneHotEncoder, VectorAssembler))]

        def bin_of(c: str) -> Column:
            inner, last = own.borders[c][1:-1], float(len(own.borders[c]) - 1)
            at = lambda v: float(sum(b <= v for b in inner))
            table = F.array(*[F.lit(at(b)) for b in self.edges[c][:-1]], F.lit(last))           # the last place is that of NaN
            return F.coalesce(F.get(table, F.col(f"e_{c}")), F.lit(at(own.medians[c]) if c in own.medians else last))

        ready = self.counted.where(F.col(self.fold) != k).select("_y", "_n", "_v", *[bin_of(c).alias(f"b_{c}") for c in [*inputs.numeric, *inputs.extra]],
                                                                 *[(F.col(f"e_{c}") < 0).cast("double").alias(f"m_{c}") for c in inputs.numeric if c in own.medians],
                                                                 *[F.expr(own.filled(c)).alias(f"s_{c}") for c in inputs.categorical])
        ready = PipelineModel([s for s in head if isinstance(s, StringIndexerModel)]).transform(ready)
        tail = Pipeline(stages=stages[len(head):]).fit(ready)
        keys = [*[c for c in stages[-1].getInputCols() if not c.startswith("o_")], *[f"i_{c}" for c in inputs.categorical]]
        same = ready.groupBy(*keys, "_y").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
        copies = F.ceil(F.col("_n") / F.lit(-(-n // FIT_ROWS) or 1)).cast("int")
        rows = same.withColumn("_c", copies).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_c")))).withColumn("_w", F.col("_v") / F.col("_c"))
        return PipelineModel([*head, *tail.stages]), tail.transform(rows).select("features", "_y", "_w"), n

    def fit(self, k, kind: str, inputs: Inputs | None = None, weight: str | None = None, seed: int = 0, **params) -> PipelineModel:
        """A tree model without fold ``k``, from raw columns to a prediction."""
        ready, rows, n = self.rows(k, inputs)
        with kept(rows) as rows:
            return PipelineModel([*ready.stages, tree(kind, n, weight, seed, **params).fit(rows)])


def _together(parts: Sequence[tuple[Sequence[float] | None, int]]) -> list[float]:
    """Quantiles 0/1000 to 1000/1000 of several sets of rows together, from those of each set and its number of rows."""
    parts = [(q, n) for q, n in parts if q and n]
    if len(parts) < 2:
        return list(parts[0][0]) if parts else []
    values = np.concatenate([np.asarray(q, float) for q, _ in parts])
    weights = np.concatenate([np.full(len(q), n / 1001) for q, n in parts])
    values[np.isnan(values)] = np.inf
    order = np.lexsort((weights, values))
    upto, total = np.cumsum(weights[order]) * (1 + 1e-12), sum(w * len(q) for (q, _), w in zip(parts, [n / 1001 for _, n in parts]))
    at = np.searchsorted(upto, np.arange(1001) / 1000 * total)
    return values[order][at[at < len(values)]].tolist()


class Blocks:
    """Training sets that are made of blocks of rows, and the boosted trees of all of them from one count (``plans.boosting``).

    ``uses`` names the blocks of each training set; a block is a number below ``blocks``, and rows without one belong to none. Medians, categories and bins are those of each set; quantiles
    are put together from 1,001 of each of its blocks and borders between them rounded to the thousandths of all rows, so that the sets share most stretches.
    Only rows that are ``known`` count. ``also`` are further sums by block, found in the same scan (``sums``).
    """

    def __init__(self, df: DataFrame, block: str, blocks: int, uses: dict, inputs: Inputs, known: Column | None = None, bins: int = BINS, rare: int = 10, also: dict[str, Column] | None = None):
        self.df, self.block, self.blocks, self.uses, self.inputs, self.bins = df.where(F.col(block).isNotNull()), block, blocks, uses, inputs, bins
        self.known = F.lit(True) if known is None else known
        numeric, categorical, self.binned = list(inputs.numeric), list(inputs.categorical), list(dict.fromkeys([*inputs.numeric, *inputs.extra]))
        parts = F.array(*[F.lit(i / 1000) for i in range(1001)])
        x = lambda c: F.when(self.known, F.col(c).cast("double"))
        seen = self.df.groupBy(block).agg(F.count_if(self.known).alias("_n"), *[F.count_if(self.known & F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(self.binned)],
                                          *[F.percentile_approx(x(c), parts, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(self.binned)],
                                          *[v.alias(f"s_{k}") for k, v in (also or {}).items()]).collect()               # one row a block
        own = {k: [r for r in seen if r[block] in at] for k, at in uses.items()}
        self.rows = {r[block]: r["_n"] for r in seen}
        self.sums = {name: {r[block]: r[f"s_{name}"] for r in seen} for name in also or {}}
        gaps = [(i, c) for i, c in enumerate(self.binned) if c in numeric and any(r[f"g{i}"] for r in seen)]
        found = dict(zip([c for _, c in gaps], concurrently([lambda c=c: block_medians(self.df.where(self.known), c, block, uses) for _, c in gaps])))
        medians = {k: {c: found[c][k] for i, c in gaps if any(r[f"g{i}"] for r in rows)} for k, rows in own.items()}
        labels = _categories(self.df.where(self.known), categorical, rare, {f"n{j}": F.count_if(F.col(block).isin(*at)) for j, at in enumerate(uses.values())})
        quantiles = lambda i, rows: _together([(r[f"q{i}"], r["_n"] - r[f"g{i}"]) for r in rows])
        common = [quantiles(i, seen) for i in range(len(self.binned))]
        self.facts = {k: Facts(medians[k], labels[f"n{j}"], {c: _borders(quantiles(i, own[k]), bins, common[i]) for i, c in enumerate(self.binned)}) for j, k in enumerate(uses)}
        edges = {c: np.array(sorted({b for f in self.facts.values() for b in f.borders[c][1:-1]})) for c in self.binned}
        every = {c: sorted({v for f in self.facts.values() for v in f.labels[c]}) for c in categorical}
        self.places = BO.Places(edges, {c: {v: i + 1 for i, v in enumerate(vs)} for c, vs in every.items()})

    def features(self, k, inputs: Inputs) -> tuple:
        """The features of ``preprocess`` as codes of places: bins, missing flags, one column a common category and one for the others."""
        own, names, out = self.facts[k], self.places.names(), []
        for c in [*inputs.numeric, *inputs.extra]:
            inner, last = np.array(own.borders[c][1:-1]), len(own.borders[c]) - 1
            gap = int(np.searchsorted(inner, own.medians[c], "right")) if c in own.medians else last
            out.append((names.index(c), np.array([gap, *np.searchsorted(inner, [float("-inf"), *self.places.edges[c]], "right"), last], np.int64)))
        out += [(names.index(c), np.array([1] + [0] * (len(self.places.edges[c]) + 2), np.int64)) for c in inputs.numeric if c in own.medians]
        for c in inputs.categorical:
            labels, every = own.labels[c] or ["none"], ["", *self.places.labels[c], ""]
            every[0] = labels[0]                           # a missing category is the most frequent one
            out += [(names.index(c), np.array([int(v == w) for w in every], np.int64)) for v in labels]
            out.append((names.index(c), np.array([int(w not in labels) for w in every], np.int64)))
        return tuple(out)

    def forests(self, wanted: dict, target: str | None = None, weight: str | None = None) -> dict:
        """{name: fitted model} of ``wanted``: {name: (training set, kind, inputs, targets by block or None, settings)}."""
        fits = []
        for k, kind, inputs, targets, settings in wanted.values():
            blocks = np.zeros(self.blocks, bool)
            blocks[list(self.uses[k])] = True
            fits.append(BO.Fit(blocks, self.features(k, inputs), kind, targets, 0, settings))
        counted = BO.count_cells(self.df.where(self.known), self.block, self.blocks, F.lit(0.0) if target is None else F.col(target), self.places, None if weight is None else F.col(weight))
        return dict(zip(wanted, BO.fit_forests(counted, self.blocks, self.places, fits)))

    def narrow(self) -> bool:
        """Whether the features are few enough for sums by bin."""
        return all(len(self.features(k, self.inputs)) <= BO.MOST_FEATURES for k in self.uses)


def grown(kind: str, params: dict) -> bool:
    """Whether ``plans.boosting`` fits such a model."""
    return kind in ("boosted", "classifier") and set(params) <= BO.SETTINGS


def block_medians(df: DataFrame, c: str, block: str, uses: dict) -> dict:
    """The exact median of a column in each training set, 0 without a value; the values are counted once, by block."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(block).cast("int").alias("_b"), F.col(c).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    member = small(df.sparkSession, [(int(b), i) for i, at in enumerate(uses.values()) for b in at], "_b int, _f int")
    each = stored(counts.join(member, "_b").groupBy("_f", "_x").agg(F.sum("_n").alias("_n")))
    middle = each.groupBy("_f").agg(((F.sum("_n") - 1) / 2).alias("_h"))
    ranks = running_sums(each, ["_x"], {"_n": "_upto"}, ["_f"]).join(middle, "_f").groupBy("_f").agg(
        F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_x"))).alias("_hi"))
    found = {r["_f"]: (r["_lo"] + r["_hi"]) / 2 for r in ranks.collect()}            # one row a training set
    return {k: found.get(i) or 0.0 for i, k in enumerate(uses)}


def place_of(column: str, values: Sequence, kind: str) -> Column:
    """The place of a value in a list, 0 where it is not there, null where it is null."""
    return F.array_position(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(column)).cast("int")


def tree_rows(train: DataFrame, inputs: Inputs, target: str, weight: str | None = None, bins: int = BINS) -> tuple[PipelineModel, DataFrame, int]:
    """``Binned.rows`` of a single training set."""
    return Binned(train.withColumn("_k", F.lit(0)), "_k", [-1], inputs, target, weight, bins).rows(-1)


def fit(train: DataFrame, kind: str, inputs: Inputs, target: str, weight: str | None = None, seed: int = 0, **params) -> PipelineModel:
    """A fitted pipeline from raw columns to a prediction."""
    train = train.where(F.col(target).isNotNull())
    if kind in TREES:
        return Binned(train.withColumn("_k", F.lit(0)), "_k", [-1], inputs, target, weight, params.get("maxBins", BINS)).fit(-1, kind, None, weight, seed, **params)
    found = from_moments(train.withColumn("_k", F.lit(0)), "_k", {"p": Variant(kind, inputs, target, weight, params=params)}, target, lambda parts: parts)
    if found:
        columns, own = found["p"]
        return line_model([f"CAST({c} AS DOUBLE)" for c in columns], own.get(0, L.Linear(0.0, [0.0] * len(columns))))
    own = facts(train, inputs)
    terms = design(own, inputs)
    if kind in LINEAR and weight is None and 0 < len(terms) <= L.MOST_INPUTS and set(params) <= {"regParam", "elasticNetParam"}:        # gaps and categories as expressions
        names = [f"_x{i}" for i in range(len(terms))]
        parts = L.complete_moments(train.select(F.lit(0).alias("_k"), F.col(target).alias("_y"), *[F.expr(e).alias(n) for n, e in zip(names, terms)]), names, "_y", "_k")
        if parts:
            return line_model(terms, L.penalised(parts[0], **{**PENALTY.get(kind, {}), **params}))
    est = maker(kind, seed, **params)().setFeaturesCol("features").setLabelCol(target).setPredictionCol("prediction")
    if weight:
        est.setWeightCol(weight)
    return Pipeline(stages=[*stages_of(own, inputs), est]).fit(train)


def line_model(terms: Sequence[str], line: L.Linear) -> PipelineModel:
    """A linear model of SQL expressions as a pipeline; NaN where an input is null."""
    number = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    whole = " + ".join([number(line.intercept), *[f"{number(w)} * coalesce({e}, CAST('NaN' AS DOUBLE))" for w, e in zip(line.weights, terms)]])
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {whole} AS prediction FROM __THIS__")])


def tree(kind: str, n: int, weight: str | None, seed: int, **params) -> Estimator:
    """A tree model for the rows of ``tree_rows``. A smallest number of rows in a node is a smallest share of the ``n`` rows, since a row may stand for several."""
    est = maker(kind, seed, **params)().setFeaturesCol("features").setLabelCol("_y").setWeightCol("_w").setPredictionCol("prediction")
    least = est.getMinInstancesPerNode()
    if weight is None and least > 1 and n > 2 * least:
        est.setMinInstancesPerNode(1).setMinWeightFractionPerNode((least - 0.5) / n)
    return est


def predict(model: PipelineModel, df: DataFrame, name: str, bounded: bool = False, probability: bool = False) -> DataFrame:
    out = model.transform(df)
    p = vector_to_array("probability")[1] if probability else F.col("prediction")
    return out.select(*df.columns, (clip(p, 0.0, 1.0) if bounded else p).alias(name))


# ---- out of fold

@dataclass
class Variant:
    """One model to compare: its kind, inputs and, where they differ, target, row weight, training rows and settings."""
    kind: str
    inputs: Inputs
    target: str | None = None
    weight: str | None = None
    where: Column | None = None
    params: dict = field(default_factory=dict)


def summable(v: Variant) -> bool:
    """Whether moments can fit the model if its inputs are numbers without gaps."""
    return v.kind == "mean" or v.kind in LINEAR and not v.inputs.categorical and set(v.params) <= {"regParam", "elasticNetParam"}


def line_inputs(v: Variant) -> list[str]:
    return [] if v.kind == "mean" else [*v.inputs.numeric, *v.inputs.extra]


def numbers(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether these columns, not too many, are numbers."""
    types = dict(df.dtypes)
    return len(columns) <= L.MOST_INPUTS and all(types[c] in NUMBERS or types[c].startswith("decimal") for c in columns)


def line_of(v: Variant, m: L.Moments) -> L.Linear:
    """The fit of a variant from the moments of its own inputs."""
    return L.penalised(m, **({**PENALTY.get(v.kind, {}), **v.params} if v.kind != "mean" else {}))


def from_moments(df: DataFrame, fold: str, variants: dict[str, Variant], target: str, train: Callable[[dict], dict]) -> dict[str, tuple[list, dict]]:
    """{variant: (columns, {fold: linear model})} of the variants that moments can fit: linear ones of numeric inputs without gaps. One scan for all variants that
    share target, weight and training rows, and for all weights of the same inputs; ``train`` turns the moments of folds into those of their training rows."""
    groups: dict = {}
    for name, v in variants.items():
        if summable(v):
            groups.setdefault((v.target or target, None if v.kind == "mean" else v.weight, id(v.where), v.kind == "mean"), []).append(name)
    scans: dict = {}
    for (y, weight, where, _), names in groups.items():
        columns = tuple(dict.fromkeys(c for n in names for c in line_inputs(variants[n])))
        scans.setdefault((y, where, columns), {}).setdefault(weight, []).extend(names)

    def scan(key: tuple, weights: dict[str | None, list[str]]) -> Callable[[], dict]:
        def run() -> dict:
            y, _, columns = key
            if not numbers(df, columns):
                return {}
            where = variants[next(iter(weights.values()))[0]].where
            parts = L.moments_by_weight(df if where is None else df.where(where), columns, y, fold, list(weights))
            if parts is None:
                return {}
            at = {c: i for i, c in enumerate(columns)}
            out = {}
            for weight, names in weights.items():
                rest = train(parts[weight])
                for n in names:
                    own = line_inputs(variants[n])
                    out[n] = own, {k: line_of(variants[n], m.of([at[c] for c in own])) for k, m in rest.items()}
            return out
        return run

    found = concurrently([scan(key, weights) for key, weights in scans.items()])
    return {n: model for part in found for n, model in part.items()}


def held_out(folds: Sequence) -> Callable[[dict], dict]:
    """For each of ``folds`` the moments of all other folds; rows without a fold train nothing."""
    def others(parts: dict) -> dict:
        parts = {k: m for k, m in parts.items() if k is not None}
        less = L.without_each(parts)
        return {k: less[k] if k in less else reduce(lambda a, b: a + b, parts.values()) for k in folds} if parts else {}
    return others


def oof_many(df: DataFrame, fold: str, folds: Sequence[int], variants: dict[str, Variant], target: str, prep: Hook | None = None) -> DataFrame:
    """Each row predicted, once per variant, by a model that has not seen its fold.

    ``prep(train, test)`` may add columns computed from the training rows only. The folds' test rows are put together once, for all variants. Predictions of
    linear models from moments are plain expressions; those of other models are frozen. Boosted trees of all folds grow together on counted cells (``Blocks``).
    """
    def halves(k) -> tuple[DataFrame, DataFrame]:
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        return (train, test) if prep is None else prep(train, test)

    def one(k, train: DataFrame, v: Variant) -> Callable[[], PipelineModel]:
        rows = train if v.where is None else train.where(v.where)
        if prep is None and v.kind in TREES:
            return lambda: counted[table_of(v)].fit(k, v.kind, v.inputs, v.weight, **v.params)
        return lambda: fit(rows, v.kind, v.inputs, v.target or target, v.weight, **v.params)

    def table_of(v: Variant) -> tuple:
        return tuple(v.inputs.numeric), tuple(v.inputs.categorical), tuple(v.inputs.extra), v.target or target, v.weight, id(v.where), v.params.get("maxBins", BINS)

    def forests(names: Sequence[str]) -> Callable[[], dict[str, tuple]]:
        """{variant: (places, {place of the fold: model})} of boosted trees that share their counted rows."""
        def run() -> dict[str, tuple]:
            v = variants[names[0]]
            known = F.col(v.target or target).isNotNull()
            rows = df.withColumn("_block", place_of(fold, folds, dict(df.dtypes)[fold]))
            blocks = Blocks(rows if v.where is None else rows.where(v.where), "_block", len(folds) + 1, {i + 1: {*range(len(folds) + 1)} - {i + 1} for i in range(len(folds))},
                            v.inputs, known, v.params.get("maxBins", BINS))
            if not blocks.narrow():
                return {}
            wanted = {(n, k): (k, variants[n].kind, v.inputs, None, variants[n].params) for n in names for k in blocks.uses}
            found = blocks.forests(wanted, v.target or target, v.weight)
            return {n: (blocks.places, {k: found[n, k] for k in blocks.uses}) for n in names}
        return run

    stack = prep.lines(df, fold, folds, variants, target) if isinstance(prep, AuxStack) else None
    if stack is not None:
        return stack
    lines = {} if prep else {n: m for n, m in from_moments(df, fold, variants, target, held_out(folds)).items() if m[1]}
    shared: dict = {}
    for n, v in variants.items():
        if prep is None and folds and grown(v.kind, v.params):
            shared.setdefault(table_of(v), []).append(n)
    trees = {n: m for found in concurrently([forests(names) for names in shared.values()]) for n, m in found.items()}
    rest = {n: v for n, v in variants.items() if n not in lines and n not in trees}
    if not rest and not trees:
        return L.predict_held_out(df, fold, lines).select(*df.columns, *variants)
    whole = df.where(F.col(fold).isin(*folds))
    if rest:
        split = [halves(k) for k in folds]
        tables = {table_of(v): v for v in rest.values() if prep is None and v.kind in TREES}           # models of the same inputs share their counted rows
        counted = {key: Binned(df if v.where is None else df.where(v.where), fold, folds, v.inputs, v.target or target, v.weight, key[-1]) for key, v in tables.items()}
        models = iter(concurrently([one(k, train, v) for k, (train, _) in zip(folds, split) for v in rest.values()]))
        parts = []
        for _, test in split:
            for name, v in rest.items():
                test = predict(next(models), test, name, probability=v.kind == "classifier")
            parts.append(test)
        whole = reduce(DataFrame.unionByName, parts)
    whole = L.predict_held_out(whole, fold, lines) if lines else whole
    whole = whole.withColumns({n: BO.prediction(places, own, place_of(fold, folds, dict(df.dtypes)[fold])) for n, (places, own) in trees.items()}) if trees else whole
    return stored(whole.select(*df.columns, *variants))


def oof(df: DataFrame, fold: str, folds: Sequence[int], kind: str, inputs: Inputs, target: str, name: str = "oof", prep: Hook | None = None,
        train_where: Column | None = None, **params) -> DataFrame:
    """Out-of-fold predictions of one model."""
    return oof_many(df, fold, folds, {name: Variant(kind, inputs, where=train_where, params=params)}, target, prep)


def ensemble_oof(df: DataFrame, fold: str, folds: Sequence[int], members: Sequence[tuple[str, dict]], inputs: Inputs, target: str, name: str = "oof") -> DataFrame:
    """Equal-weight mean of several members, clipped to [0, 1]; one pass per fold."""
    counted = Binned(df, fold, folds, inputs, target) if any(kind in TREES for kind, _ in members) else None
    calls = [lambda k=k: ensemble_fit(df.where(F.col(fold) != k), members, inputs, target, lambda kind, **own: counted.fit(k, kind, **own)) for k in folds]
    parts = [ensemble_predict(models, df.where(F.col(fold) == k), name) for k, models in zip(folds, concurrently(calls))]
    return stored(reduce(DataFrame.unionByName, parts))


def ensemble_fit(train: DataFrame, members: Sequence[tuple[str, dict]], inputs: Inputs, target: str, trees: Callable[..., PipelineModel] | None = None) -> list[PipelineModel]:
    """The fitted members; ``trees`` fits tree models with the library's bins in another way."""
    return [trees(kind, **params) if trees and kind in TREES and "maxBins" not in params else fit(train, kind, inputs, target, **params) for kind, params in members]


def ensemble_predict(models: Sequence[PipelineModel], df: DataFrame, name: str) -> DataFrame:
    out, cols = df, []
    for i, m in enumerate(models):
        out = predict(m, out, f"_p{i}")
        cols.append(F.col(f"_p{i}"))
    mean = reduce(lambda a, b: a + b, cols) / len(cols)
    return out.select(*df.columns, clip(mean, 0.0, 1.0).alias(name))


def labelled(metric: DataFrame, **labels) -> DataFrame:
    return metric.select(*[F.lit(v).alias(k) for k, v in labels.items()], *metric.columns)


def score_variants(preds: DataFrame, target: str, variants: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics of several prediction columns in one pass: the table is unpivoted to (variant, prediction)."""
    long = preds.select(*by, target, F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("_p")) for v in variants])))
    return M.regression_by(long, target, "_p", ["variant", *by])


def model_ladder(df: DataFrame, fold: str, folds: Sequence[int], inputs: Inputs, target: str, kinds: Sequence[str] = LADDER,
                 settings: dict[str, dict] | None = None) -> DataFrame:
    """All models on the same folds: one row of metrics per model."""
    variants = {k: Variant(k, inputs, params=(settings or {}).get(k, {})) for k in kinds}
    return score_variants(oof_many(df, fold, folds, variants, target), target, kinds)


def group_tuning(df: DataFrame, fold: str, folds: int, inputs: Inputs, target: str, kind: str, grid: dict[str, Sequence], n: int, seed: int = 0,
                 parallelism: int = 2) -> DataFrame:
    """``n`` seeded draws from a parameter grid, each scored by mean absolute error over the given folds."""
    settings = sorted((dict(zip(grid, values)) for values in product(*grid.values())), key=lambda s: SP.group_order(seed, sorted(s.items())))[:n]
    found = facts(df, inputs)
    terms = design(found, inputs)             # scaling does not change a linear model of standardised inputs
    names = [f"_x{i}" for i in range(len(terms))]
    plain = df.select(target, fold, *[F.expr(e).alias(n) for n, e in zip(names, terms)])
    variants = {f"s{i}": Variant(kind, Inputs(names), params=own) for i, own in enumerate(settings)}
    groups = from_moments(plain, fold, variants, target, held_out(range(folds))) if all(set(own) <= {"regParam", "elasticNetParam"} for own in settings) else {}
    if groups and all(own for _, own in groups.values()):          # linear models: one scan of moments for all folds and settings, one for their errors
        scores = [sum(e.values()) / len(e) for e in L.absolute_errors(plain, names, target, fold, [groups[n][1] for n in variants])]
    else:
        est = maker(kind, seed)().setLabelCol(target)
        maps = [{est.getParam(k): v for k, v in s.items()} for s in settings]
        ready = Pipeline(stages=stages_of(found, inputs, True)).fit(df).transform(df).select("features", target, fold)
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=target, metricName="mae"), numFolds=folds, foldCol=fold,
                            parallelism=parallelism)
        scores = cv.fit(ready).avgMetrics
    rows = [(str(sorted(s.items())), float(v)) for s, v in zip(settings, scores)]
    return df.sparkSession.createDataFrame(rows, "params string, mae double").orderBy("mae", "params")


# ---- protocols

def scheme_folds(df: DataFrame, scheme: str, rid: str, seed: int, k: int = 5, minimum: int = 150) -> tuple[DataFrame, list]:
    """``df`` with a ``fold`` column and the folds to hold out. A scheme is "random", "group:<column>" (whole groups) or "leave:<column>" (one group
    of at least ``minimum`` rows at a time; the rows of smaller groups are only ever trained on)."""
    how, _, column = scheme.partition(":")
    if how == "random":
        return SP.random_kfold(df, rid, k, seed, "fold"), list(range(k))
    if how == "group":
        return SP.group_kfold(df, column, k, seed, name="fold"), list(range(k))
    if how == "leave":
        large = sorted(g for g, n in SP.group_counts(df, column) if g is not None and n >= minimum)
        return df.withColumn("fold", F.col(column)), large
    raise ValueError(scheme)


def cross_validate(df: DataFrame, schemes: Sequence[str], seeds: Sequence[int], variants: dict[str, Variant], target: str, rid: str, k: int = 5,
                   minimum: int = 150, by: str | None = None) -> DataFrame:
    """(scheme, seed, variant, [by,] n, mae, rmse, r2, ...): out-of-fold metrics of every scheme and seed, ready for ``summarise_runs``. Leaving one group
    out does not depend on a seed and runs once."""
    used = {target, rid, *([by] if by else []), *[s.partition(":")[2] for s in schemes if ":" in s]}
    for v in variants.values():
        used |= {*v.inputs.numeric, *v.inputs.categorical, *v.inputs.extra, *([v.weight] if v.weight else []), *([v.target] if v.target else [])}
    if all(v.where is None for v in variants.values()):
        df = df.select(*[c for c in df.columns if c in used])
    parts = []
    for scheme in schemes:
        for seed in seeds if not scheme.startswith("leave") else seeds[:1]:
            folded, held = scheme_folds(df, scheme, rid, seed, k, minimum)
            with kept(folded) as d:
                preds = oof_many(d, "fold", held, variants, target)
                parts.append(cut(labelled(score_variants(preds, target, list(variants), [by] if by else []), scheme=scheme, seed=seed)))
    return reduce(DataFrame.unionByName, parts)


# ---- hooks and stacks

@dataclass(frozen=True)
class AuxStack:
    """Predicted auxiliary label as an input: inner out-of-fold for training rows, a fit on all training rows for test rows. A hook for one training set; ``lines`` does the work
    of all folds at once, where the models are linear."""
    inputs: Inputs
    aux: str
    rid: str
    group: str
    n_inner: int
    seed: int
    name: str
    kind: str
    params: dict

    def __call__(self, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        inner = SP.group_kfold(train, self.group, self.n_inner, self.seed + 11, largest_first=True, name="_inner")
        known = F.col(self.aux).isNotNull()
        filled = oof(inner, "_inner", range(self.n_inner), self.kind, self.inputs, self.aux, self.name, train_where=known, **self.params).drop("_inner")
        full = fit(train.where(known), self.kind, self.inputs, self.aux, **self.params)
        return filled, predict(full, test, self.name, probability=self.kind == "classifier")

    def _inner_blocks(self, df: DataFrame, fold: str, folds: Sequence) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Rows with the block that they lie in, the place of each block's fold (0: never held out), and its inner fold for every held-out fold (-1: none)."""
        counts = df.where(F.col(fold).isNotNull()).groupBy(fold, self.group).count().limit(SP.MOST_GROUPS + 1).collect()
        if len(counts) > SP.MOST_GROUPS:
            raise ValueError(f"more than {SP.MOST_GROUPS} groups")
        inner = []
        for k in folds:
            sizes: dict = {}
            for f, g, n in counts:
                if f != k:
                    sizes[g] = sizes.get(g, 0) + n
            inner.append(SP.assign_groups(list(sizes.items()), self.n_inner, self.seed + 11, True))
        place, ids = {k: i + 1 for i, k in enumerate(folds)}, {}
        rows = [(f, g, ids.setdefault((place.get(f, 0), *[inner[i][g] if f != k else -1 for i, k in enumerate(folds)]), len(ids))) for f, g, _ in counts]
        schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (fold, self.group)] + [T.StructField("_block", T.IntegerType())])
        table = np.array(list(ids), np.int64).reshape(len(ids), len(folds) + 1)
        return null_safe_join(df, small(df.sparkSession, rows, schema), [fold, self.group]), table[:, 0], table[:, 1:]

    def lines(self, df: DataFrame, fold: str, folds: Sequence, variants: dict[str, Variant], target: str) -> DataFrame | None:
        """``df`` with the predictions of linear models on this input: the classifiers of all outer and inner folds grow from one count, and the moments of all outer folds are one
        scan, in which each row meets the inner models that have not seen it. None where moments cannot fit the models."""
        numeric = list(dict.fromkeys(c for v in variants.values() for c in v.inputs.numeric))
        extra = list(dict.fromkeys(c for v in variants.values() for c in v.inputs.extra if c != self.name))
        plain = all(v.kind in LINEAR - {"mean"} and not v.inputs.categorical and v.weight is None and v.where is None and (v.target or target) == target
                    and set(v.params) <= {"regParam", "elasticNetParam"} for v in variants.values())
        if not (folds and plain and grown(self.kind, self.params) and fold != self.group and self.name not in df.columns and numbers(df, [*numeric, *extra])):
            return None
        joined, outer, inner = self._inner_blocks(df, fold, folds)
        train = {i: set(np.flatnonzero(outer != i + 1).tolist()) for i in range(len(folds))}
        uses = {(i, j): {b for b in train[i] if inner[b, i] != j} for i in train for j in sorted({int(inner[b, i]) for b in train[i]})} | {(i, None): own for i, own in train.items()}
        has, number = F.col(target).isNotNull(), lambda c: F.col(c).cast("double")
        bad = [number(c).isNotNull() & ~F.coalesce(F.abs(number(c)) < float("inf"), F.lit(False)) for c in [*numeric, *extra]] + [F.col(c).isNull() for c in extra]
        also = {"unlike": F.count_if(has != F.col(self.aux).isNotNull()), "bad": F.count_if(has & reduce(lambda a, b: a | b, bad, F.lit(False)))}
        also |= {f"gap_{c}": F.count_if(has & F.col(c).isNull()) for c in numeric}
        blocks = Blocks(joined, "_block", len(outer), uses, self.inputs, F.col(self.aux).isNotNull(), self.params.get("maxBins", BINS), also=also)
        if sum(blocks.sums["bad"].values()) or not blocks.narrow():
            return None
        gaps = [c for c in numeric if sum(blocks.sums[f"gap_{c}"].values())]
        alike = not sum(blocks.sums["unlike"].values())            # the same rows have a target and a label, so their medians are known
        medians = {c: {i: blocks.facts[i, None].medians.get(c, 0.0) for i in train} if alike and c in self.inputs.numeric else block_medians(joined.where(has), c, "_block", train) for c in gaps}
        medians = {c: {i: m if any(blocks.sums[f"gap_{c}"].get(b) for b in train[i]) else np.nan for i, m in own.items()} for c, own in medians.items()}
        models, places = blocks.forests({k: (k, self.kind, self.inputs, None, self.params) for k in uses}, self.aux), blocks.places
        width, terms = len(places.names()), [*numeric, *[f"{c} IS NULL" for c in gaps], *extra, self.name]

        def design(i: int, inputs: Sequence, rows: np.ndarray, aux: np.ndarray) -> np.ndarray:
            """The terms of some rows of a batch for one held-out fold: filled numbers, missing flags, other inputs and the predicted label."""
            x = {c: a.to_numpy(zero_copy_only=False)[rows] for c, a in zip([*numeric, *extra], inputs)}
            none = {c: a.is_null().to_numpy(zero_copy_only=False)[rows] for c, a in zip(numeric, inputs) if c in gaps}
            return np.column_stack([*[np.where(none[c], medians[c][i], x[c]) if c in gaps else x[c] for c in numeric], *[none[c].astype(float) for c in gaps], *[x[c] for c in extra], aux])

        def parts(b):
            block, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, inputs = places.of(b.columns[2:2 + width]), b.columns[2 + width:]
            for i in train:
                rows = np.flatnonzero((outer[block] != i + 1) & np.isfinite(y))
                if len(rows):
                    aux, part = np.empty(len(rows)), inner[block[rows], i]
                    for j in np.unique(part).tolist():
                        own = np.flatnonzero(part == j)
                        aux[own] = models[i, j].predict([a[rows[own]] for a in at], len(own))
                    yield i, L.of_rows(np.column_stack([design(i, inputs, rows, aux), y[rows]]))

        scan = joined.where(has).select(F.col("_block").alias("k"), number(target).alias("_y"), *[c.alias(f"p{i}") for i, c in enumerate(places.columns())],
                                        *[number(c).alias(f"z{i}") for i, c in enumerate([*numeric, *extra])])
        moments = L.collected(L.merged_moments(scan, parts, "int", len(terms) + 1), len(terms) + 1)
        if set(moments) != set(train):
            return None

        def prediction(v: Variant) -> Column:
            own = [terms.index(t) for t in [*v.inputs.numeric, *[f"{c} IS NULL" for c in v.inputs.numeric if c in gaps], *v.inputs.extra]]
            fits = {i: line_of(v, m.of(own)) for i, m in moments.items()}
            full = {i: models[i, None] for i in train}

            @F.arrow_udf("double")
            def predicted(k: pa.Array, *columns: pa.Array) -> pa.Array:
                which, out = k.to_numpy(zero_copy_only=False), np.full(len(k), np.nan)
                at = places.of(columns[:width])
                for i in np.unique(which).tolist():
                    rows = np.flatnonzero(which == i)
                    aux = full[i - 1].predict([a[rows] for a in at], len(rows))
                    out[rows] = design(i - 1, columns[width:], rows, aux)[:, own] @ fits[i - 1].weights + fits[i - 1].intercept
                return pa.array(out)

            return predicted(place_of(fold, folds, dict(df.dtypes)[fold]), *places.columns(), *[number(c) for c in [*numeric, *extra]])

        return df.where(F.col(fold).isin(*folds)).select(*df.columns, *[prediction(v).alias(n) for n, v in variants.items()])


def aux_stack_hook(inputs: Inputs, aux: str, rid: str, group: str, n_inner: int = 3, seed: int = 0, name: str = "aux_p", kind: str = "classifier", **params) -> AuxStack:
    """Predicted auxiliary label as an input: inner out-of-fold for training rows, a fit on all training rows for test rows."""
    return AuxStack(inputs, aux, rid, group, n_inner, seed, name, kind, params)


def residual_stack(df: DataFrame, fold: str, folds: Sequence[int], base: Inputs, rest: Inputs, target: str, kind: str = "boosted", **params) -> DataFrame:
    """A base model and a second one on its out-of-fold residuals; the sum is clipped. Both of two linear models come from one scan, where moments can fit them."""
    second = _line_stack(df, fold, folds, Variant(kind, base, params=params), Variant(kind, rest, params=params), target)
    if second is None:
        first = oof(df, fold, folds, kind, base, target, "base", **params)
        second = oof(first.withColumn("_resid", F.col(target) - F.col("base")), fold, folds, kind, rest, "_resid", "resid", **params).drop("_resid")
    return second.withColumn("stacked", clip(F.col("base") + F.col("resid"), 0.0, 1.0))


def _line_stack(df: DataFrame, fold: str, folds: Sequence[int], base: Variant, rest: Variant, target: str) -> DataFrame | None:
    """``df`` with base and resid: what a linear base leaves is linear in the inputs and the target, so its moments follow from theirs."""
    columns = list(dict.fromkeys([*line_inputs(base), *line_inputs(rest)]))
    if not (summable(base) and summable(rest) and numbers(df, columns)):
        return None
    parts = L.complete_moments(df, columns, target, fold)
    own, other = ([columns.index(c) for c in line_inputs(v)] for v in (base, rest))
    first = {k: line_of(base, m.of(own)) for k, m in held_out(folds)(parts or {}).items()}
    left = {k: parts[k].less(own, line) for k, line in first.items() if k in parts}
    second = {k: line_of(rest, m.of(other)) for k, m in held_out(folds)(left).items()}
    if not second:
        return None
    return L.predict_held_out(df, fold, {"base": (line_inputs(base), first), "resid": (line_inputs(rest), second)})


def ablation_table(df: DataFrame, fold: str, folds: Sequence[int], sets: dict[str, Inputs], target: str, kind: str = "boosted", **params) -> DataFrame:
    """The same folds over named feature sets."""
    wide = oof_many(df, fold, folds, {n: Variant(kind, i, params=params) for n, i in sets.items()}, target)
    return score_variants(wide, target, list(sets))


def drop_only_add(groups: dict[str, Sequence[str]], base: Sequence[str]) -> dict[str, Inputs]:
    """Feature sets that leave out one group, use one alone, or add one to a base."""
    every = [c for g in groups.values() for c in g]
    out = {"all": Inputs(every)}
    for g, cols in groups.items():
        out[f"drop_{g}"] = Inputs([c for c in every if c not in cols])
        out[f"only_{g}"] = Inputs(list(cols))
        out[f"add_{g}"] = Inputs([*base, *[c for c in cols if c not in base]])
    return {k: v for k, v in out.items() if v.numeric}


def forward_selection(df: DataFrame, fold: str, folds: Sequence[int], groups: dict[str, Sequence[str]], target: str, gain: float = 0.001, kind: str = "linear", **params) -> DataFrame:
    """Add the feature group with the best held-out R2 until the gain is below ``gain``: (step, added, r2, kept)."""
    chosen: list[str] = []
    best, log = float("-inf"), []
    while len(chosen) < len(groups):
        sets = {g: Inputs([c for h in [*chosen, g] for c in groups[h]]) for g in groups if g not in chosen}
        scores = {r["variant"]: r["r2"] or 0.0 for r in ablation_table(df, fold, folds, sets, target, kind, **params).collect()}   # one row per set
        top = max(sorted(scores), key=scores.get)
        keep = scores[top] >= best + gain
        log.append((len(chosen) + 1, top, float(scores[top]), bool(keep)))
        if not keep:
            break
        chosen.append(top)
        best = scores[top]
    return df.sparkSession.createDataFrame(log, "step int, added string, r2 double, kept boolean")


def top_k_oof(df: DataFrame, fold: str, folds: Sequence[int], numeric: Sequence[str], target: str, k: int, kind: str = "boosted", name: str = "oof", **params) -> DataFrame:
    """Per fold: fit, keep the k most important inputs of this training fold, refit."""
    counted = Binned(df, fold, folds, Inputs(numeric), target, None, params.get("maxBins", BINS)) if kind in TREES else None

    def own(f, columns: Sequence[str]) -> PipelineModel:
        return counted.fit(f, kind, Inputs(columns), **params) if counted else fit(df.where(F.col(fold) != f), kind, Inputs(columns), target, **params)

    def both(f) -> PipelineModel:
        importance = own(f, numeric).stages[-1].featureImportances.toArray()[: len(numeric)]
        return own(f, [c for _, c in sorted(zip(-importance, numeric))[:k]])

    models = concurrently([lambda f=f: both(f) for f in folds])
    return stored(reduce(DataFrame.unionByName, [predict(m, df.where(F.col(fold) == f), name) for f, m in zip(folds, models)]))


def permutation_importance(df: DataFrame, model: PipelineModel, groups: dict[str, Sequence[str]], target: str, rid: str, repeats: int = 8, seed: int = 0) -> DataFrame:
    """Rise of the mean absolute error when a group of columns is shuffled together: (grp, mae_increase, sd).

    The rows are put into one seeded order and kept by their place in it. In each repeat the row at place i receives the values of place (a * i + b) mod n, with a
    drawn prime to n, so every repeat is a shuffle of all rows and costs one join; nothing is sorted or stored again.
    """
    base = M.regression_by(predict(model, df, "_p"), target, "_p").first()["mae"]
    moved = sorted({c for cols in groups.values() for c in cols})
    order = with_rank(df.withColumn("_key", seeded_key(seed, rid)), ["_key", rid], name="_rn").drop("_key").withColumn("_rn", F.col("_rn") - 1)
    n = order.count()
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = []
    with kept(order, spread, "_rn") as order:
        for i in range(repeats if n else 0):
            a = next(a for a in count(SP.group_order(seed + i, "a") % n + 1) if gcd(a, n) == 1) % n
            b = SP.group_order(seed + i, "b") % n
            # a * rn may be beyond a long for more than three billion rows, so it is a decimal
            place = F.pmod(F.col("_rn").cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + b, F.lit(n).cast("decimal(19,0)")).cast("bigint")
            other = order.select(place.alias("_rn"), F.struct(*moved).alias("_new"))
            out = order.withColumn("_own", F.struct(*moved)).join(other, "_rn")
            for j, cols in enumerate(groups.values()):
                out = predict(model, out.withColumns({c: F.col("_new" if c in cols else "_own")[c] for c in moved}), f"_p{j}")
            mae = out.agg(*[F.avg(F.when(M.finite(target, f"_p{j}"), F.abs(F.col(f"_p{j}") - F.col(target)))) for j in range(len(groups))]).first()
            runs += [(g, e - base) for g, e in zip(groups, mae)]
    found = df.sparkSession.createDataFrame(runs, "grp string, d double")
    return found.groupBy("grp").agg(F.avg("d").alias("mae_increase"), F.stddev_pop("d").alias("sd"))


def noise_grid(df: DataFrame, fold: str, folds: Sequence[int], inputs: Inputs, flag: str, target: str, rid: str, rates: Sequence[float], kind: str = "symmetric",
               model: str = "boosted", **params) -> DataFrame:
    """R2 per (noise in the training answers, noise in the test answers); the noise is fixed by seed."""
    noisy = df.withColumns({**{f"_tr{i}": noisy_answer(F.col(flag), rid, 10 + int(e * 100), e, kind) for i, e in enumerate(rates)},
                            **{f"_te{i}": noisy_answer(F.col(flag), rid, 1, e, kind) for i, e in enumerate(rates)}})
    used = [fold, target, *dict.fromkeys(c for c in (*inputs.numeric, *inputs.categorical, *inputs.extra) if c not in (fold, target))]
    with kept(noisy.select(*used, *[f"_{h}{i}" for h in ("tr", "te") for i in range(len(rates))])) as noisy:      # every answer is drawn once
        variants = {f"_m{i}": Variant(model, inputs.plus(f"_tr{i}"), params=params) for i in range(len(rates))}
        lines = {} if not folds else from_moments(noisy, fold, variants, target, held_out(folds))
        if len(lines) == len(variants) and all(own for _, own in lines.values()):
            swapped = {f"{i}__{j}": ([*columns[:-1], f"_te{j}"], own) for i, (columns, own) in enumerate(lines[n] for n in variants) for j in range(len(rates))}
            preds = L.predict_held_out(noisy, fold, swapped)
        else:
            def one(k, i: int) -> PipelineModel:
                return fit(noisy.where(F.col(fold) != k).withColumn("answer", F.col(f"_tr{i}")), model, inputs.plus("answer"), target, **params)

            models, parts = iter(concurrently([lambda k=k, i=i: one(k, i) for k in folds for i in range(len(rates))])), []
            for k in folds:
                test = noisy.where(F.col(fold) == k)
                for i in range(len(rates)):
                    m = next(models)
                    for j in range(len(rates)):
                        test = predict(m, test.withColumn("answer", F.col(f"_te{j}")), f"{i}__{j}").drop("answer")
                parts.append(test)
            preds = reduce(DataFrame.unionByName, parts)
        pairs = [f"{i}__{j}" for i in range(len(rates)) for j in range(len(rates))]
        preds = stored(preds.select(target, *pairs))
    rate = lambda i: F.element_at(F.array(*[F.lit(float(e)) for e in rates]), F.split("variant", "__")[i].cast("int") + 1)
    return score_variants(preds, target, pairs).select(rate(0).alias("train_noise"), rate(1).alias("test_noise"), "n", "r2")


# ---- weights, domains and groups

def domain_weights(df: DataFrame, domain: str, rid: str, inputs: Inputs, seed: int = 0, **params) -> DataFrame:
    """Weights of source rows (domain 0) toward target rows (domain 1), from a cross-fitted classifier on the inputs alone."""
    folded = SP.stratified_kfold(df, rid, domain, 3, seed, "_dfold")
    p = oof(folded, "_dfold", range(3), "classifier", inputs, domain, "_prob", **params).drop("_dfold")
    n = p.groupBy(domain).count().collect()
    size = {int(r[0]): r[1] for r in n if r[0] is not None}
    return density_ratio(p.where(F.col(domain) == 0), "_prob", F.lit(float(size.get(0, 0))), F.lit(float(max(size.get(1, 0), 1)))).drop("_prob")


def weighted_lines(df: DataFrame, group: str, held: Sequence, v: Variant, target: str, rid: str, seed: int = 0, weight_params: dict | None = None, k: int = 3) -> dict[str, tuple[list, dict]]:
    """{"weighted": (columns, {held-out group: linear model})}: each model's rows are weighted toward its group by a cross-fitted classifier on the inputs, as ``domain_weights`` gives them.

    The rows are split once, stratified by group, which is a split stratified by domain for every held-out group. The classifiers of all groups and folds grow from one count,
    with the domain as a target that the block of a row gives; one more scan takes the moments under the weights of all groups. Empty where moments cannot fit the model
    (other kinds, categories, gaps) or another classifier is asked for.
    """
    columns, settings = line_inputs(v), {**(weight_params or {})}
    if not (held and summable(v) and v.kind != "mean" and columns and not v.inputs.categorical and grown("classifier", settings) and numbers(df, columns)):
        return {}
    value = [F.col(c).cast("double") for c in [*columns, target]]
    finite = [F.coalesce(F.abs(x) < float("inf"), F.lit(False)) for x in value]
    rows = df.where(F.col(group).isNotNull()).select(*dict.fromkeys([rid, group, target, *columns]))
    place = place_of(group, held, dict(df.dtypes)[group])                             # 0: a group that is not held out
    folded = SP.stratified_kfold(rows, rid, group, k, seed, "_dfold").withColumn("_block", place * k + F.col("_dfold"))
    blocks = (len(held) + 1) * k
    fitted = Blocks(folded, "_block", blocks, {j: {b for b in range(blocks) if b % k != j} for j in range(k)}, v.inputs, None, settings.get("maxBins", BINS),
                    also={"gaps": F.count_if(F.col(target).isNotNull() & ~reduce(lambda a, b: a & b, finite[:-1]))})
    if sum(fitted.sums["gaps"].values()) or not fitted.narrow():
        return {}
    domain = {g: (np.arange(blocks) // k == i + 1).astype(float) for i, g in enumerate(held)}
    wanted = {(i, j): (j, "classifier", v.inputs, domain[g], settings) for i, g in enumerate(held) for j in range(k)}
    models, places = fitted.forests(wanted), fitted.places
    size = {b: sum(r for a, r in fitted.rows.items() if a // k == b) for b in range(len(held) + 1)}
    total, n = sum(size.values()), len(value)
    use, groups = [list(columns).index(c) for c in places.edges], len(held)

    def parts(b):
        x = L._matrix(b, [f"z{i}" for i in range(n)])
        block, at = b.column(0).to_numpy(zero_copy_only=False), places.of([b.column(1 + i) for i in use])
        own, fold = block // k, block % k
        whole, folds = np.isfinite(x).all(axis=1), [np.flatnonzero(fold == j) for j in range(k)]
        for i in range(groups):
            p = np.empty(len(x))
            for j, f in enumerate(folds):
                p[f] = models[i, j].predict([a[f] for a in at], len(f))
            q = np.clip(p, 1e-3, 1 - 1e-3)
            weight = np.clip(q / (1 - q) * (total - size[i + 1]) / max(size[i + 1], 1), 0.05, 20.0)
            train = np.flatnonzero(whole & (own != i + 1))
            if len(train):
                yield i, L.of_rows(x[train], weight[train])

    plain = folded.where(F.col(target).isNotNull()).select(F.col("_block").alias("k"), *[x.alias(f"z{i}") for i, x in enumerate(value)])
    moments = L.collected(L.merged_moments(plain, parts, "int", n), n)
    return {"weighted": (columns, {g: line_of(v, moments[i]) for i, g in enumerate(held) if i in moments})}


def leave_group_out_variants(df: DataFrame, group: str, held: Sequence, near: dict, inputs: Inputs, target: str, rid: str, kind: str = "linear", seed: int = 0,
                             weight_params: dict | None = None, variants: Sequence[str] = ("pooled", "regional", "weighted"), **params) -> DataFrame:
    """Per held-out group: all other groups pooled, the nearest groups only (``regional``), and rows weighted toward the group; only ``variants`` are fitted.
    Where the first two are, ``ensemble`` is their mean. ``weight_params`` are the settings of the classifier that gives the weights. Where moments can fit the
    model, the weights of all held-out groups come from one split of the rows and one count (``weighted_lines``).
    """
    def one(g, variant: str) -> PipelineModel:
        train = df.where(~F.col(group).eqNullSafe(F.lit(g)))
        if variant == "regional":
            train = df.where(F.col(group).isin(*near[g]))
        if variant != "weighted":
            return fit(train, kind, inputs, target, **params)
        used = dict.fromkeys([rid, target, *inputs.numeric, *inputs.categorical, *inputs.extra])
        marked = df.select((F.col(group) == g).cast("int").alias("_dom"), *used)
        return fit(domain_weights(marked, "_dom", rid, inputs, seed, **(weight_params or {})), kind, inputs, target, "weight", **params)

    def chosen(v: str) -> Callable[[dict], dict]:
        """Moments of the training rows of each held-out group; rows without a group train the pooled model."""
        def of(parts: dict) -> dict:
            less = L.without_each(parts)
            near_by = lambda g: [parts[o] for o in near[g] if o in parts]
            return {g: less[g] if v == "pooled" else reduce(lambda a, b: a + b, near_by(g)) for g in held if g in parts and (v == "pooled" or near_by(g))}
        return of

    lines = {}
    for v in variants:
        if v == "weighted":
            found = weighted_lines(df, group, held, Variant(kind, inputs, params=params), target, rid, seed, weight_params or {})
        else:
            found = from_moments(df, group, {v: Variant(kind, inputs, params=params)}, target, chosen(v))
        lines |= {n: m for n, m in found.items() if len(m[1]) == len(held)}
    rest = [v for v in variants if v not in lines]
    models = iter(concurrently([lambda g=g, v=v: one(g, v) for g in held for v in rest]))
    whole = df.where(F.col(group).isin(*held))
    if rest:
        parts = []
        for g in held:
            test = df.where(F.col(group) == g)
            for v in rest:
                test = predict(next(models), test, v)
            parts.append(test)
        whole = reduce(DataFrame.unionByName, parts)
    whole = L.predict_held_out(whole, group, lines) if lines else whole
    both = [((F.col("pooled") + F.col("regional")) / 2).alias("ensemble")] if {"pooled", "regional"} <= set(variants) else []
    whole = whole.select(*df.columns, *variants, *both)
    return stored(whole) if rest else whole


def win_table(preds: DataFrame, group: str, target: str, base: str, others: Sequence[str], minimum: int = 300) -> DataFrame:
    """In how many groups each variant beats the base."""
    s = score_variants(preds, target, [base, *others], [group]).where(F.col("n") >= minimum)
    ref = s.where(F.col("variant") == base).select(group, F.col("r2").alias("_b"))
    return s.where(F.col("variant") != base).join(ref, group).groupBy("variant").agg(
        F.count("*").alias("groups"), F.avg("r2").alias("mean_r2"), F.count_if(F.col("r2") > F.col("_b")).alias("wins"))


def per_group_models(df: DataFrame, group: str, fold: str, folds: Sequence[int], inputs: Inputs, target: str, minimum: int = 800, kind: str = "linear", **params) -> DataFrame:
    """Pooled model, pooled with the group as a category, own model for large groups (else the pooled one), and their mean."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.col(fold) != k).alias(f"t{k}") for k in folds]).where(
        F.col("n") >= minimum).limit(SP.MOST_GROUPS + 1).collect()
    if len(counts) > SP.MOST_GROUPS:
        raise ValueError(f"more than {SP.MOST_GROUPS} groups")
    with_group = Inputs(inputs.numeric, [*inputs.categorical, group], inputs.extra)
    large = {k: [r[0] for r in counts if r[f"t{k}"] > 0] for k in folds}               # a group that lies in one fold has nothing to train on
    train = lambda k: df.where(F.col(fold) != k)
    calls = []
    for k in folds:
        calls += [lambda k=k: fit(train(k), kind, inputs, target, **params), lambda k=k: fit(train(k), kind, with_group, target, **params)]
        calls += [lambda k=k, g=g: fit(train(k).where(F.col(group).eqNullSafe(F.lit(g))), kind, inputs, target, **params) for g in large[k]]
    models = iter(concurrently(calls))
    parts = []
    for k in folds:
        test = df.where(F.col(fold) == k)
        test = predict(next(models), test, "pooled")
        test = predict(next(models), test, "pooled_group")
        own, rest = [], test
        for g in large[k]:
            own.append(predict(next(models), test.where(F.col(group).eqNullSafe(F.lit(g))), "own"))
            rest = rest.where(~F.col(group).eqNullSafe(F.lit(g)))
        whole = reduce(DataFrame.unionByName, [*own, rest.withColumn("own", F.col("pooled_group"))])
        parts.append(whole.withColumn("ensemble", (F.col("pooled_group") + F.col("own")) / 2))
    return stored(reduce(DataFrame.unionByName, parts))


# ---- stored models and scoring

def save_model(model: PipelineModel, residuals: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    residuals.write.mode("overwrite").parquet(f"{path}/residuals")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/residuals")


def load_or_train(spark, path: str, train: Callable[[], tuple[PipelineModel, DataFrame]], retrain: bool = False) -> tuple[PipelineModel, DataFrame]:
    from rillmap.sources.writers import exists
    if retrain or not exists(spark, f"{path}/residuals"):
        save_model(*train(), path)
    return load_model(spark, path)


def score_with_interval(model: PipelineModel, residuals: DataFrame, df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Prediction and conformal interval of new rows, clipped to [0, 1]; ``residuals`` has one column ``res``."""
    from rillmap.operators.ranking import quantile_higher
    half = quantile_higher(residuals, "res", SP.conformal_rank(residuals.count(), alpha)).first()[0]
    return SP.with_interval(predict(model, df, "point", bounded=True), "point", F.lit(half))


def prediction_table(oof_rows: DataFrame, locked_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Out-of-fold and held-out predictions in one table with their basis."""
    return oof_rows.select(*columns, F.lit("out of fold").alias("basis")).unionByName(locked_rows.select(*columns, F.lit("held out").alias("basis")))
