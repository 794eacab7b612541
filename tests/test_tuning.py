"""Tuning by successive halving against full fits, and stopping by the recorded losses."""
import json

import pytest
from pyspark.sql import functions as F

from rillmap.plans import models as ML
from rillmap.plans import tuning as TU
from rillmap.sources import readers as RD
from rillmap.sources import writers as WR


@pytest.fixture(scope="module")
def df(spark):
    d = spark.range(900).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") * 37 % 100 / 100.0).alias("x"), (F.col("id") * 53 % 97 / 97.0).alias("z"))
    return d.withColumn("y", F.sin(6 * F.col("x")) + F.col("z") * F.col("z") + (F.col("id") % 7) / 100).persist()


def test_rounds_that_count():
    assert TU.best_round([5.0, 4.0, 3.0, 3.5, 2.9999], 0.01) == 3 and TU.best_round([1.0], 0.1) == 1
    assert TU.best_round([0.0, 0.0], 0.1) == 1 and TU.best_round([3.0, 2.0, 1.0], 0.0) == 3


def test_draws_are_distinct_and_seeded():
    grid = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    assert len(set(TU.draws(grid, 4, 1))) == 4 and len(TU.draws(grid, 20, 1)) == 6 and TU.draws(grid, 6, 1) != TU.draws(grid, 6, 2)
    assert TU.draws(grid, 4, 1) == TU.draws(dict(reversed(grid.items())), 4, 1)


def test_halving_keeps_the_better_half_and_stores_the_best(spark, df, tmp_path):
    grid = {"maxDepth": [1, 3], "stepSize": [0.01, 0.3], "minInstancesPerNode": [1, 200]}
    log = TU.tune_boosting(df, F.col("fold") == 0, ML.Inputs(["x", "z"]), "y", grid, 8, first=3, last=12, patience=50, subsamplingRate=1.0).persist()
    steps = {k: [r for r in log.collect() if r["step"] == k] for k in range(3)}
    assert [len(steps[k]) for k in range(3)] == [8, 4, 2] and [steps[k][0]["rounds"] for k in range(3)] == [3, 6, 12]
    for k in range(2):
        on = {r["params"] for r in steps[k] if r["goes_on"]}
        assert on == {r["params"] for r in steps[k + 1]} and max(r["mse"] for r in steps[k] if r["goes_on"]) <= min(r["mse"] for r in steps[k] if not r["goes_on"])
    early = {r["params"]: r["losses"] for r in steps[0]}
    for r in steps[2]:                                      # more rounds continue the same fit, and the log has what a plain fit gives
        assert r["losses"][:3] == pytest.approx(early[r["params"]]) and len(r["losses"]) == 12
    top = min(steps[2], key=lambda r: r["mse"])
    settings = {**json.loads(top["params"]), "maxIter": top["best_round"], "subsamplingRate": 1.0}
    model = ML.fit(df.where("fold <> 0"), "boosted", ML.Inputs(["x", "z"]), "y", **settings)
    assert ML.predict(model, df.where("fold = 0"), "p").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0] == pytest.approx(top["mse"])
    for _ in range(2):
        WR.append_chunk(TU.scored(log, "boosted"), str(tmp_path / "log"))
    best = RD.best_results(spark, str(tmp_path / "log"), TU.scored(log, "boosted").schema, "objective", "score", "params").first()
    assert json.loads(best["params"]) == {**json.loads(top["params"]), "maxIter": top["best_round"]} and -best["score"] == pytest.approx(top["mse"])


def test_settings_that_no_longer_improve_are_not_fitted_again(df):
    flat = df.withColumn("b", (F.col("x") > 0.5).cast("double"))
    log = TU.tune_boosting(flat, F.col("fold") == 0, ML.Inputs(["b"]), "y", {"maxDepth": [1, 2], "stepSize": [0.1, 0.5]}, 4, first=5, last=80, patience=3, subsamplingRate=1.0).collect()
    assert len(log) == 4 and all(r["stopped"] and r["best_round"] == 1 and r["step"] == 0 for r in log)


def test_no_validation_rows_is_an_error(df):
    with pytest.raises(ValueError, match="validation"):
        TU.tune_boosting(df, F.col("fold") == 9, ML.Inputs(["x"]), "y", {"maxDepth": [1]}, 1)
