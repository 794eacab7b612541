"""Linear models from moments against fits on the rows."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from rillmap.operators import splits as SP
from rillmap.plans import linear as LI

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [1, 50, 0.1, 1] + [0, 1e6, 3, 0]
    x[:, 3] = 7.0                                                       # constant
    y = 0.5 * x[:, 0] - 0.02 * (x[:, 1] - 1e6) + rng.normal(size=400) * 0.3
    return x, y, np.arange(400) % 4


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, fold = data
    rows = [(int(f), *map(float, r), float(t)) for f, r, t in zip(fold, x, y)]
    odd = [(0, None, 1.0, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0, 1.0), (2, 1.0, float("inf"), 1.0, 1.0, 1.0), (9, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "fold int, a double, b double, c double, d double, y double").repartition(5)


@pytest.fixture(scope="module")
def parts(frame):
    return LI.moments(frame, COLUMNS, "y", "fold")


def test_moments_and_merges(data, parts):
    x, y, fold = data
    z = np.column_stack([x, y])
    assert list(parts) == [0, 1, 2, 3]
    for k, m in LI.without_each(parts).items():
        own = z[fold != k]
        assert m.n == len(own) and np.allclose(m.mean, own.mean(0), rtol=1e-12) and np.allclose(m.co, (own - own.mean(0)).T @ (own - own.mean(0)), rtol=1e-9, atol=1e-6)


def test_errors_without_predictions(data, parts):
    x, y, fold = data
    line = LI.Linear(0.3, np.array([1.0, 1e-3, -2.0, 0.5]))
    for k, m in parts.items():
        off = 0.3 + x[fold == k] @ line.weights - y[fold == k]
        assert np.isclose(line.sse(m), (off ** 2).sum(), rtol=1e-8) and np.isclose(line.bias(m), off.sum(), rtol=1e-8)


def test_ridge_is_the_solution_on_the_rows(data, parts):
    x, y, fold = data
    m = LI.without_each(parts)[1]
    own, t = x[fold != 1], y[fold != 1]
    z = (own - own.mean(0)) / np.where(own.std(0) > 0, own.std(0), 1)
    for penalty, fit in zip(LI.RIDGE, LI.ridge_path(m)):
        w = np.linalg.solve(z.T @ z + penalty * np.eye(4), z.T @ (t - t.mean()))
        assert np.allclose(own @ fit.weights + fit.intercept, z @ w + t.mean(), atol=1e-6) and fit.weights[3] == 0


@pytest.mark.parametrize("share", LI.L1_RATIOS)
def test_elastic_net_meets_its_optimality_conditions(data, parts, share):
    x, y, fold = data
    m = LI.without_each(parts)[0]
    own, t = x[fold != 0][:, :3], y[fold != 0]
    z = (own - own.mean(0)) / own.std(0)
    penalties = LI.net_penalties(m, share)
    path = LI.net_path(m, share, penalties)
    assert not path[0].weights.any() and len(path) == LI.STEPS
    for a, fit in zip(penalties, path):
        w = fit.weights[:3] * own.std(0)
        slope = z.T @ (t - t.mean() - z @ w) / len(t) - a * (1 - share) * w
        assert np.all(np.where(w != 0, np.abs(slope - a * share * np.sign(w)), np.maximum(np.abs(slope) - a * share, 0)) < 1e-7)


def test_elastic_net_agrees_with_spark(frame, parts):
    """Spark standardises target and inputs with n - 1, which changes its penalties by known factors."""
    rest = frame.where("fold IN (1, 2, 3) AND a IS NOT NULL AND NOT isnan(a) AND abs(b) < 1e300")
    m = LI.without_each(parts)[0]
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rest)
    model = LinearRegression(labelCol="y", regParam=0.05, elasticNetParam=1.0, tol=1e-12, maxIter=1000).fit(ready)
    factor = np.sqrt((m.n - 1) / m.n)
    own = LI.net_path(m, 1.0, [0.05 * factor])[0]
    assert np.allclose(model.coefficients.toArray(), own.weights[:3], rtol=1e-3, atol=1e-6)


def test_choice_and_scores_from_rows(spark, frame, data, parts):
    x, y, fold = data
    paths = LI.penalty_paths(parts)
    table = LI.path_table(spark, paths)
    assert table.where("chosen").groupBy("model", "fold").count().where("count = 1").count() == 8
    models = LI.chosen_models(paths)
    for kind, n, rmse, r2, bias in LI.score(parts, models, ["ridge", "elasticnet"]):
        own = {k: f for (name, k), f in models.items() if name == kind}
        p = np.array([own[k].intercept + r @ own[k].weights for k, r in zip(fold, x)])
        assert n == 400 and np.isclose(rmse, np.sqrt(((p - y) ** 2).mean()), rtol=1e-6) and np.isclose(bias, (p - y).mean(), atol=1e-7)
        assert np.isclose(r2, 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rtol=1e-6)
        got = sorted(r["p"] for r in LI.predict_folds(frame.where("y IS NOT NULL AND a IS NOT NULL AND NOT isnan(a) AND abs(b) < 1e300"), COLUMNS, "fold", own, "p").collect())
        assert np.allclose(got, sorted(p), rtol=1e-6)


def test_selection(parts):
    steps = LI.select_forward(parts, COLUMNS)
    assert [s[1] for s in steps[:2]] == ["b", "a"] and not steps[-1][3]
    every = LI.ablate(parts, COLUMNS, {"all": COLUMNS, "b": ["b"]})
    assert every["all"] > every["b"] > 0


def test_nothing_and_bounds(spark, frame):
    assert LI.moments(frame.where("fold = 9"), COLUMNS, "y", "fold") == {}
    assert LI.without_each({}) == {} and LI.penalty_paths({}) == {}
    with pytest.raises(ValueError):
        LI.moments(frame, ["a"] * 65, "y", "fold")
    flat = LI.moments(frame.selectExpr("0 AS fold", "1.0 AS a", "2.0 AS y").unionAll(frame.selectExpr("1", "1.0", "2.0")), ["a"], "y", "fold")
    assert LI.ridge_path(flat[0])[0].weights.tolist() == [0.0] and LI.net_penalties(flat[0], 0.5)[0] == 0.0


def test_many_inputs_have_the_moments_of_few(spark, frame, monkeypatch):
    plain = LI.moments(frame, COLUMNS, "y", "fold")
    monkeypatch.setattr(LI, "PLAIN_INPUTS", 0)
    packed = LI.moments(frame, COLUMNS, "y", "fold")
    assert list(plain) == list(packed)
    for k, m in plain.items():
        assert m.n == packed[k].n and np.allclose(m.mean, packed[k].mean) and np.allclose(m.co, packed[k].co)


def test_errors_of_many_fits_in_one_scan(frame, parts):
    keys = [k for k in parts if k is not None]
    rest = {k: m for k, m in LI.without_each({k: parts[k] for k in keys}).items()}
    fits = [{k: LI.ridge_path(rest[k], [a])[0] for k in keys} for a in (0.0, 5.0)]
    whole = frame.na.drop().where("b < 1e300")
    found = LI.absolute_errors(whole, COLUMNS, "y", "fold", fits)
    for own, errors in zip(fits, found):
        p = LI.predict_held_out(whole, "fold", {"p": (COLUMNS, own)})
        want = {r[0]: r[1] for r in p.groupBy("fold").agg(F.avg(F.abs(F.col("p") - F.col("y")))).collect()}
        assert errors.keys() == want.keys() and all(abs(errors[k] - want[k]) < 1e-9 for k in want)


def test_rows_meet_folds_and_models_without_a_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("g"), F.rand(1).alias("x"))
    d = SP.group_kfold(SP.group_size_weight(df, "g", 0.5), "g", 5, 0)
    p = LI.predict_held_out(d, "fold", {"p": (["x"], {k: LI.Linear(float(k), np.ones(1)) for k in range(5)})})
    assert p.count() == 1000
    assert "SortMergeJoin" not in p._jdf.queryExecution().toString() and "hashpartitioning" not in p._jdf.queryExecution().toString()


def test_all_weights_share_one_scan(spark, monkeypatch):
    from rillmap.plans import models as ML
    d = spark.range(400).select((F.col("id") % 4).cast("int").alias("fold"), (1e6 + F.col("id") % 17).alias("x"), (F.col("id") % 17 * 0.3 + F.col("id") % 5).alias("y"),
                                (1 + F.col("id") % 3).alias("w"), F.when(F.col("id") % 6 != 0, F.col("id") % 2 + 0.5).alias("v")).persist()
    variants = {n: ML.Variant("linear", ML.Inputs(["x"]), weight=w) for n, w in (("plain", None), ("w", "w"), ("v", "v"))}
    calls, scan = [], LI.moments_by_weight
    monkeypatch.setattr(LI, "moments_by_weight", lambda *a: calls.append(a[-1]) or scan(*a))
    found = ML.from_moments(d, "fold", variants, "y", ML.held_out(range(4)))
    assert calls == [[None, "w", "v"]]
    rows_ = [r.asDict() for r in d.collect()]
    for name, weight in (("plain", None), ("w", "w"), ("v", "v")):
        for k, line in found[name][1].items():
            own = [r for r in rows_ if r["fold"] != k and (weight is None or r[weight] is not None)]
            slope, start = np.polyfit([r["x"] - 1e6 for r in own], [r["y"] for r in own], 1, w=np.sqrt([float(r[weight]) if weight else 1.0 for r in own]))
            assert abs(line.weights[0] - slope) < 1e-8 and abs(line.intercept + 1e6 * line.weights[0] - start) < 1e-5
    assert LI.moments_by_weight(d.withColumn("x", F.when(F.col("w") < 3, F.col("x"))), ["x"], "y", "fold", [None, "w"]) is None
    counts = SP.group_counts(d, "fold")
    a, b = (sorted(map(tuple, SP.group_size_weight(d, "fold", 0.5, "s", c).collect()), key=str) for c in (None, counts))
    assert a == b
