"""Boosted trees on counted cells against Spark ML's, whatever the number of folds, targets and copies."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmap.plans import boosting as BO
from rillmap.plans import models as ML

SETTINGS = dict(maxIter=6, maxDepth=3, stepSize=0.2)


@pytest.fixture(scope="module")
def df(spark):
    d = spark.range(1500).select("id", (F.col("id") % 5).cast("int").alias("fold"), F.when(F.col("id") % 9 != 0, F.col("id") * 37 % 101 / 10).alias("a"),
                                 (F.col("id") * 53 % 17 / 4).alias("b"), F.when(F.col("id") % 13 != 0, (F.col("id") * 7 % 4).cast("string")).alias("c"))
    y = F.coalesce("a", F.lit(3.0)) * 0.1 + F.sin(F.col("b")) + F.when(F.col("c") == "2", 0.5).otherwise(0.0) + F.col("id") * 29 % 10 / 20
    return d.withColumn("y", y).withColumn("label", (F.col("y") > 1.0).cast("int")).persist()


def predictions(df, name):
    return {r["id"]: r[name] for r in df.select("id", name).collect()}


def test_a_forest_of_every_fold_is_that_of_spark_ml(df):
    """Without draws the trees are the same ones, with gaps and categories; all folds and both models read the rows together."""
    inputs = ML.Inputs(["a", "b"], ["c"])
    variants = {"p": ML.Variant("boosted", inputs, params={**SETTINGS, "subsamplingRate": 1.0}), "q": ML.Variant("classifier", inputs, "label", params=SETTINGS)}
    got = ML.oof_many(df, "fold", range(5), variants, "y")
    assert got.columns == [*df.columns, "p", "q"] and got.count() == 1500
    p, q = predictions(got, "p"), predictions(got, "q")
    for k in (0, 3):
        train, test = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        a = predictions(ML.predict(ML.fit(train, "boosted", inputs, "y", subsamplingRate=1.0, **SETTINGS), test, "r"), "r")
        b = predictions(ML.predict(ML.fit(train, "classifier", inputs, "label", **SETTINGS), test, "r", probability=True), "r")
        assert max(abs(p[i] - v) for i, v in a.items()) < 1e-6 and max(abs(q[i] - v) for i, v in b.items()) < 1e-6


def test_copies_count_and_draws_are_of_rows(df):
    """Ten copies of every row give the trees of one, and a draw takes its share of the copies of a cell."""
    v = ML.Variant("boosted", ML.Inputs(["a", "b"]), params={**SETTINGS, "subsamplingRate": 1.0})
    ten = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("i")
    one, many = predictions(ML.oof_many(df, "fold", [1], {"p": v}, "y"), "p"), predictions(ML.oof_many(ten, "fold", [1], {"p": v}, "y"), "p")
    assert one.keys() == many.keys() and max(abs(one[i] - many[i]) for i in one) < 1e-6
    cells = {"id": (0, 0), 0: {"codes": np.zeros((2, 1), np.uint8), "y": np.array([0.0, 1.0]), "n": np.array([10_000.0, 1.0]), "u": None}}
    drawn = BO._round(cells, [BO.Fit(np.ones(1, bool), ((0, np.zeros(3, int)),), "boosted", settings={"subsamplingRate": 0.8})], 0, {})[0]["drawn"]
    assert 7_700 < drawn[0] < 8_300 and drawn[1] in (0.0, 1.0)


def test_jobs_do_not_grow_with_folds_and_models(df, monkeypatch):
    """One job a level serves all folds; a fit of its own for every fold and model took some hundred."""
    seen, sums = [], BO._sums
    monkeypatch.setattr(BO, "partial", lambda f, **k: (seen.append(len(k["trees"])) if f is sums else None) or __import__("functools").partial(f, **k))
    ML.oof_many(df, "fold", range(5), {"p": ML.Variant("boosted", ML.Inputs(["a", "b"]), params=SETTINGS)}, "y").count()
    assert len(seen) <= 6 * 3 and max(seen) == 5


def test_a_label_beyond_0_and_1_and_a_fold_of_all_rows_are_refused(df):
    with pytest.raises(Exception, match="0 or 1"):
        ML.oof_many(df.withColumn("label", F.col("id") % 3), "fold", [0], {"q": ML.Variant("classifier", ML.Inputs(["b"]), "label", params=SETTINGS)}, "y")
    with pytest.raises(ValueError, match="no rows"):
        ML.oof_many(df.where("fold = 0"), "fold", [0], {"p": ML.Variant("boosted", ML.Inputs(["b"]), params=SETTINGS)}, "y")


def test_a_long_lineage_and_many_parts_change_nothing(df, monkeypatch):
    v = {"p": ML.Variant("boosted", ML.Inputs(["a", "b"], ["c"]), params={**SETTINGS, "subsamplingRate": 1.0})}
    one = predictions(ML.oof_many(df, "fold", [2], v, "y"), "p")
    monkeypatch.setattr(BO, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(BO, "MANY_PARTS", 0)
    two = predictions(ML.oof_many(df, "fold", [2], v, "y"), "p")
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-9


def test_cells_are_merged_exactly(monkeypatch):
    """Places of several words come back, and rows of equal keys are one row, in whatever steps."""
    monkeypatch.setattr(BO, "_WORD", 64)
    monkeypatch.setattr(BO, "MERGED", 50)
    rng = np.random.default_rng(0)
    sizes = [7, 5, 100, 3, 9]
    places = [rng.integers(0, s, 400) for s in sizes]
    words = BO._pack(places, sizes)
    assert len(words) == 3 and all((a == b).all() for a, b in zip(BO._unpack(words, sizes), places))
    y = rng.integers(0, 2, 400) / 2
    parts = [([np.repeat(places[0][i:i + 40], 2), np.repeat(y[i:i + 40], 2)], [np.ones(80), np.full(80, 0.5)]) for i in range(0, 400, 40)]
    got: dict = {}
    for batch in BO._merging(iter(parts), ["a", "y", "n", "v"]):
        for r in batch.to_pylist():
            n, v = got.get((r["a"], r["y"]), (0, 0))
            got[r["a"], r["y"]] = n + r["n"], v + r["v"]
    want = {(a, b): 2.0 * ((places[0] == a) & (y == b)).sum() for a, b in zip(places[0].tolist(), y.tolist())}
    assert got == {k: (n, n / 2) for k, n in want.items()}


def test_weights_toward_every_group_come_from_one_split(df, monkeypatch):
    """All held-out groups share one split and one count; the models are those of one group at a time, and a group's own target does not matter."""
    d = df.select("id", F.when(F.col("id") % 11 != 0, F.col("fold")).alias("st"), (F.col("id") * 53 % 11 / 4 + F.col("fold") % 2 / 8).alias("b"), "y", (F.col("id") % 3 / 3).alias("u"))
    calls = []
    monkeypatch.setattr(ML.SP, "stratified_kfold", lambda t, rid, label, k, seed, name: calls.append(1) or t.withColumn(name, (F.col("id") % 7 % k).cast("int")))
    inputs, run = ML.Inputs(["b", "u"]), lambda t, **k: ML.leave_group_out_variants(t, "st", range(5), {}, ML.Inputs(["b", "u"]), "y", "id", weight_params=SETTINGS, variants=("weighted",), **k)
    got = predictions(run(d), "weighted")
    assert len(calls) == 1 and len(got) == d.where("st is not null").count()
    again = predictions(run(d.withColumn("y", F.when(F.col("st") == 2, 1000.0).otherwise(F.col("y")))).where("st = 2"), "weighted")
    assert again and all(got[i] == pytest.approx(v, abs=1e-9) for i, v in again.items())
    marked = d.select("id", (F.col("st") == 2).cast("int").alias("dom"), "y", "b", "u")
    own = ML.fit(ML.domain_weights(marked.where("dom is not null"), "dom", "id", inputs, **SETTINGS), "linear", inputs, "y", "weight")
    slow = predictions(ML.predict(own, d.where("st = 2"), "weighted"), "weighted")
    assert max(abs(got[i] - v) for i, v in slow.items()) < 1e-6
    gaps = run(d.withColumn("b", F.when(F.col("id") != 7, F.col("b"))))
    assert gaps.count() == len(got) and gaps.where("weighted is null").count() == 0


def test_a_stack_of_all_folds_is_that_of_one_fold_at_a_time(df, monkeypatch):
    """Inner and outer models of all folds come from one count and one scan of moments; the hook, fold by fold, gives the same predictions, with gaps."""
    d = df.select("id", (F.col("id") % 23).cast("int").alias("huc"), F.col("fold").alias("old"), F.when(F.col("id") % 9 != 0, F.col("id") * 37 % 25 / 10).alias("a"), "b", "y",
                  F.when(F.col("id") % 50 != 0, F.col("label").cast("double")).alias("poor"))
    d = ML.SP.group_kfold(d, "huc", 4, 0).drop("old").withColumn("y", F.when(F.col("id") % 31 != 0, F.col("y"))).persist()
    hook = ML.aux_stack_hook(ML.Inputs(["a", "b"]), "poor", "id", "huc", 3, **SETTINGS)
    v, calls, once = {"p": ML.Variant("linear", ML.Inputs(["a", "b"], (), ("aux_p",)))}, [], BO.fit_forests
    monkeypatch.setattr(BO, "fit_forests", lambda *a: calls.append(len(a[-1])) or once(*a))
    got = ML.oof_many(d, "fold", range(4), v, "y", hook)
    one = predictions(got, "p")
    assert calls == [4 * (3 + 1)] and got.columns == [*d.columns, "p"] and len(one) == 1500
    two = predictions(ML.oof_many(d, "fold", [0, 2], v, "y", lambda train, test: hook(train, test)), "p")
    assert two and max(abs(one[i] - p) for i, p in two.items()) < 1e-6
