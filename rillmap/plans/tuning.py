"""Tuning of boosted trees by successive halving, with the loss after every round.

All draws are fitted with a few rounds first. The better half goes on with twice the rounds, and so on, so every step costs about the same and the whole
search a few steps instead of a full fit a draw. A setting whose loss on the validation rows has not fallen for ``patience`` rounds is not fitted again, but
stays in the comparison with its best round. The table is preprocessed once, with statistics of the training rows; fits of a step are concurrent Spark jobs.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import inf

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.operators import splits as SP
from rillmap.plans.models import Inputs, concurrently, kept, tree, tree_rows

LOG = "params string, step int, rounds int, best_round int, mse double, stopped boolean, goes_on boolean, losses array<double>"


@dataclass
class Trial:
    """One setting after one step: the loss after each round and the round that is worth stopping at."""
    params: str
    step: int
    losses: list[float]
    best_round: int
    stopped: bool

    @property
    def mse(self) -> float:
        return self.losses[self.best_round - 1]


def best_round(losses: Sequence[float], tolerance: float) -> int:
    """The last round (from 1) that lowered the smallest loss so far by more than the given share of it."""
    best, least = 1, inf
    for k, loss in enumerate(losses, 1):
        if loss < least * (1 - tolerance) or least == inf:
            best, least = k, loss
    return best


def draws(grid: dict[str, Sequence], n: int, seed: int) -> list[str]:
    """``n`` different settings of a grid in a seeded order, as JSON; all of them if there are fewer."""
    names = sorted(grid)
    every = [json.dumps(dict(zip(names, values))) for values in product(*(grid[k] for k in names))]
    return sorted(every, key=lambda s: (SP.group_order(seed, s), s))[:n]


def tune_boosting(df: DataFrame, held_out: Column, inputs: Inputs, target: str, grid: dict[str, Sequence], n: int = 20, seed: int = 0, first: int = 25,
                  last: int = 400, patience: int = 10, tolerance: float = 1e-4, **fixed) -> DataFrame:
    """The log of a search (columns of ``LOG``): one row per setting and step it was fitted in, ``goes_on`` if it was in the better half of all settings left.

    ``held_out`` marks the validation rows; a null there leaves the row out, and so does a null target. Either side without rows is an error. Ties in the loss
    go to the setting that is smaller as text. ``fixed`` settings hold for all draws. The number of rows is at most twice ``n``.
    """
    rows = df.where(F.col(target).isNotNull())
    train, valid = rows.where(~held_out), rows.where(held_out)
    ready, merged, n_train = tree_rows(train, inputs, target)
    with kept(merged) as train, kept(ready.transform(valid).select("features", F.col(target).cast("double").alias("_y"), F.lit(1.0).alias("_w"))) as valid:
        if not n_train or valid.isEmpty():
            raise ValueError("tuning needs training rows and validation rows")

        def trial(params: str, step: int, rounds: int) -> Trial:
            model = tree("boosted", n_train, None, seed, **{**fixed, **json.loads(params), "maxIter": rounds}).fit(train)
            losses = list(model.evaluateEachIteration(valid, "squared"))
            best = best_round(losses, tolerance)
            return Trial(params, step, losses, best, len(losses) - best >= patience)

        left: dict[str, Trial | None] = dict.fromkeys(draws(grid, n, seed))
        log, rounds, step = [], min(first, last), 0
        while True:
            going = [p for p, t in left.items() if t is None or not t.stopped]
            fitted = concurrently([lambda p=p: trial(p, step, rounds) for p in going])
            left |= {t.params: t for t in fitted}
            order = sorted(left.values(), key=lambda t: (t.mse, t.params))
            better = order[:(len(order) + 1) // 2]
            done = rounds >= last or all(t.stopped for t in better)
            log += [(t.params, step, rounds, t.best_round, float(t.mse), t.stopped, t in better, [float(x) for x in t.losses]) for t in fitted]
            if done:
                break
            left, rounds, step = {t.params: t for t in better}, min(2 * rounds, last), step + 1
    return df.sparkSession.createDataFrame(log, LOG)


def scored(log: DataFrame, objective: str) -> DataFrame:
    """A search as rows of an append-only results log: (objective, score, params), the score higher for a better setting, the rounds among the settings.

    A setting counts once, by its last step.
    """
    latest = log.groupBy("params").agg(F.max_by(F.struct("mse", "best_round"), "step").alias("t"))
    settings = F.concat(F.regexp_replace("params", r"\}$", ""), F.lit(', "maxIter": '), F.col("t.best_round").cast("string"), F.lit("}"))
    return latest.select(F.lit(objective).alias("objective"), (-F.col("t.mse")).alias("score"), settings.alias("params"))
