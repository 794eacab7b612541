"""Ranks by range partition against a plain window, for even, hot and tied data."""
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmap.operators import metrics as M
from rillmap.operators import paths as PA
from rillmap.operators import ranking as R
from rillmap.operators import splits as SP


@pytest.fixture(scope="module")
def df(spark):
    # a third of the rows share one group and one value
    base = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("g"),
                                    F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 101) / 100.0).alias("v"), (F.col("id") * 31 % 97 / 97.0).alias("p"))
    return base.repartition(4).persist()


def test_with_rank(df):
    for group in ([], ["g"]):
        w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy("v", "id")
        want = rows(df.select("id", F.row_number().over(w).cast("bigint")), "id")
        assert rows(R.with_rank(df, ["v", "id"], group).select("id", "rn"), "id") == want


def test_mid_ranks_and_running_sums(df):
    w = Window.partitionBy(F.lit(1)).orderBy("v")
    mid = F.rank().over(w) + (F.count("*").over(Window.partitionBy("v")) - 1) / 2
    assert rows(R.average_rank(df, "v").select("id", "mid_rank"), "id") == rows(df.select("id", mid), "id")
    run = F.sum("id").over(Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0))
    assert rows(R.running_sums(df, ["v", "id"], {"id": "s"}, ["g"]).select("id", "s"), "id") == rows(df.select("id", run), "id")


def test_quantiles(df):
    import numpy as np
    v = np.array([r[0] for r in df.select("v").collect()])
    assert M.exact_quantiles(df, "v", [0.0, 0.15, 0.5, 0.9, 1.0]) == pytest.approx(list(np.quantile(v, [0, 0.15, 0.5, 0.9, 1])))
    n = len(v)
    assert R.quantile_higher(df, "v", int(np.ceil(0.9 * (n - 1))) + 1).first()[0] == np.quantile(v, 0.9, method="higher")


def test_prefix_sample_is_nested(df):
    small = {r[0] for r in SP.stratified_prefix(df, "g", "id", 20, 1).select("id").collect()}
    large = {r[0] for r in SP.stratified_prefix(df, "g", "id", 60, 1).select("id").collect()}
    assert small < large


def test_permute_keeps_values(df):
    got = R.permute(df.select("id", "g", "v"), "v", ["id"], 3, ["g"])
    assert rows(got.groupBy("g", "v").count(), "g", "v") == rows(df.groupBy("g", "v").count(), "g", "v")
    assert got.join(df.select("id", F.col("v").alias("w")), "id").where("v <> w").count() > 100


def test_path_neighbours(df):
    ref = F.col("id") % 5 == 0
    w = Window.partitionBy("g").orderBy("v", "id")
    val = F.when(ref, F.col("p"))
    want = df.select("id", F.last(val, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(val, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    assert rows(PA.carry(df, "g", ["v", "id"], F.col("p"), ref).select("id", "prev", "next"), "id") == rows(want, "id")


def test_rank_metrics(df):
    import pandas as pd
    pdf = df.select("v", "p").toPandas()
    assert M.spearman(df, "v", "p").first()["spearman"] == pytest.approx(pdf.v.rank().corr(pdf.p.rank()))
    assert M.spearman(df.withColumn("k", F.lit(1.0)), "k", "p").first()["spearman"] is None
    lab = (pdf.v < 0.3).astype(int)
    r = pdf.p.rank()
    pos, neg = lab.sum(), (1 - lab).sum()
    auc = (r[lab == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    d = df.select((F.col("v") < 0.3).cast("int").alias("lab"), "p")
    assert M.roc_auc(d, "lab", "p").first()[0] == pytest.approx(auc)


def test_null_groups_are_groups(spark):
    d = spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 3}", float(i % 7)) for i in range(60)], "id long, g string, v double")
    assert R.permute(d, "v", ["id"], 1, ["g"]).count() == 60
    assert R.average_rank(d, "v", "mid_rank", ["g"]).where("mid_rank IS NULL").count() == 0
    folds = SP.group_kfold(d, "g", 3, 0)
    assert folds.count() == 60 and folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    weights = {r["g"]: r["weight"] for r in SP.group_size_weight(d, "g", 1.0).collect()}
    assert weights[None] == pytest.approx(1 / 15)
    held = SP.locked_holdout(d, "g", "id", 0, share=0.3, below=0.2, above=0.2, min_group=1, min_regions=1)
    assert held.count() == 60 and {r[0] for r in held.where("g IS NULL").select("locked").collect()} == {False}
    assert {r["g"] for r in M.quantiles_by(d, "v", ["g"], 0.5).collect()} == {None, "g0", "g1", "g2"}


def test_thinning_keeps_other_folds(df):
    d = df.select("id", (F.col("id") % 3).cast("int").alias("fold"))
    got = SP.thin_training(d, "id", "fold", 3, [0.5, 1.0], 1)
    n = {(r["held"], r["fraction"]): r["count"] for r in got.groupBy("held", "fraction").count().collect()}
    assert n == {(h, f): 1000 for h in range(3) for f in (0.5, 1.0)} and got.where("fold = held").count() == 0


def test_infinite_values_are_left_out(spark):
    d = spark.createDataFrame([(1.0, 1.5), (2.0, float("inf")), (3.0, 2.5), (float("nan"), 1.0), (None, 1.0), (4.0, 4.0)], "y double, p double")
    r = M.regression_by(d, "y", "p").first()
    assert r["n"] == 3 and r["mae"] == pytest.approx(1 / 3) and r["rmse"] < 1
