"""Splits, models, sources and streams: invariants that protect the reported numbers."""
import json
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillmap.operators import joins as J
from rillmap.operators import splits as SP
from rillmap.plans import features as FE
from rillmap.plans import inventory as INV
from rillmap.plans import models as ML
from rillmap.sources import readers as RD
from rillmap.sources import writers as WR
from rillmap.streaming import ingest as IN


@pytest.fixture(scope="module")
def df(spark):
    d = spark.range(600).select("id", (F.col("id") % 23).cast("string").alias("huc"), (F.col("id") % 5).alias("st"), (F.col("id") * 37 % 100 / 100.0).alias("x"),
                                F.when(F.col("id") % 7 != 0, F.col("id") * 91 % 100 / 100.0).alias("z"))
    return d.withColumn("y", F.least(F.lit(1.0), F.col("x") * 0.8 + (F.col("id") % 10) / 50)).persist()


def test_group_folds(df):
    for sized in (False, True):
        f = SP.group_kfold(df, "huc", 4, 1, sized)
        assert f.count() == 600 and f.groupBy("huc").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    a, b = (dict(rows(SP.group_kfold(df, "huc", 4, s).select("huc", "fold").distinct())) for s in (0, 1))
    assert a != b and a == dict(rows(SP.group_kfold(df, "huc", 4, 0).select("huc", "fold").distinct()))


def test_locked_set(df):
    d = SP.locked_holdout(df, "huc", "st", 7, min_group=10)
    share = d.agg(F.avg(F.col("locked").cast("double"))).first()[0]
    assert 0.13 <= share <= 0.19 and d.groupBy("huc").agg(F.count_distinct("locked").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        SP.locked_groups(df, "huc", "st", 7, min_group=10_000, tries=2)


def test_conformal_rank():
    assert SP.conformal_rank(99, 0.1) == 91 and SP.conformal_rank(5, 0.1) == 5 and SP.conformal_rank(9, 0.1) == 9


def test_bootstrap_of_a_perfect_and_a_mean_model(df):
    mean = df.agg(F.avg("y")).first()[0]
    b = SP.bootstrap_r2(df.withColumns({"good": F.col("y"), "flat": F.lit(mean)}), "huc", "y", ["good", "flat"], 50, 3)
    s = b.agg(F.min("good"), F.max("flat"), F.count("*")).first()
    assert s[0] == pytest.approx(1.0) and s[1] <= 1e-9 and s[2] == 50


def test_oof_covers_each_row_once_and_sees_no_test_label(df):
    d = SP.group_kfold(df, "huc", 3, 0)
    o = ML.oof(d, "fold", range(3), "linear", ML.Inputs(["x", "z"]), "y")
    assert o.count() == 600 and o.select("id").distinct().count() == 600
    marked = d.withColumn("y", F.when(F.col("fold") == 0, 1000.0).otherwise(F.col("y")))     # labels of the held-out fold do not matter
    a, b = (dict(rows(ML.oof(t, "fold", [0], "linear", ML.Inputs(["x", "z"]), "y").select("id", "oof"))) for t in (d, marked))
    assert a == b
    e = ML.ensemble_oof(d, "fold", [0], [("linear", {}), ("mean", {})], ML.Inputs(["x"]), "y")
    assert e.where("oof < 0 or oof > 1").count() == 0


def test_model_round_trip(spark, df, tmp_path):
    m = ML.fit(df, "linear", ML.Inputs(["x", "z"], ["st"]), "y")
    ML.save_model(m, df.select(F.col("y").alias("res")), str(tmp_path / "m"))
    again, res = ML.load_model(spark, str(tmp_path / "m"))
    assert rows(ML.predict(m, df, "p").select("id", "p"), "id") == rows(ML.predict(again, df, "p").select("id", "p"), "id")
    s = ML.score_with_interval(again, res, df)
    assert s.where("lower > point or upper < point or lower < 0 or upper > 1").count() == 0


def structure(num, lat, lon, **extra):
    row = {c: "" for c in INV.FIELDS} | {"STRUCTURE_NUMBER_008": num, "LAT_016": lat, "LONG_017": lon, "SERVICE_UND_042B": "5", "STRUCTURE_LEN_MT_049": "30.5",
                                        "YEAR_BUILT_027": "1990", "STRUCTURE_TYPE_043B": "02"}
    return row | extra


def test_inventory_files_and_join(spark, tmp_path):
    data = [structure("'A'", "42300000", "075000000"), structure("road", "42300000", "075000000", SERVICE_UND_042B="1"), structure("sec77", "42307700", "075000000"),
            structure("min75", "42750000", "075000000"), structure("B", "43000000", "075000000", YEAR_BUILT_027="0", STRUCTURE_LEN_MT_049="0")]
    lines = [",".join(INV.FIELDS)] + [",".join(r[c] for c in INV.FIELDS) for r in data]
    (tmp_path / "NY25.txt").write_text("\n".join(lines))
    s = INV.load_inventory(spark, str(tmp_path), ["NY"])
    got = rows(s.select("nbi_id", "lat", "lon", "nbi_year_built", "nbi_length_m"), "nbi_id")
    assert got == [("A", 42.5, -75.0, 1990.0, 30.5), ("B", 43.0, -75.0, None, None)]
    c = spark.createDataFrame([(f"c{i}", 42.5 + o / 111190.0, -75.0) for i, o in enumerate((5, 30, 200))], ["cid", "lat_nad83", "lon_nad83"])
    one = INV.join_inventory(c, s, "cid", keep_id=True)
    assert rows(one.select("nbi_matched", "nbi_structure_number", "nbi_length_m"), F.col("cid")) == [(1.0, "A", 30.5), (0.0, None, None), (0.0, None, None)]
    assert [r[0] for r in rows(INV.join_inventory(c, s, "cid", mutual_only=False).orderBy("cid").select("nbi_matched"))] == [1.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="missing"):
        INV.join_inventory(c, s, "nope")


def test_catchment_sums(spark):
    d = spark.createDataFrame([(1, 10.0, None, 1000.0), (2, None, None, None)], "comid long, pctdecid2019ws double, pctconif2019ws double, precip8110ws double")
    f = rows(FE.catchment_features(d, "comid").select("sc_pct_forest", "sc_precip_mm"), F.col("comid"))
    assert f == [(10.0, 1000.0), (None, None)]


def test_steps_need_their_inputs(df):
    with pytest.raises(ValueError, match="requires drainage"):
        FE.build_predictor_table(df, {}, ["streamcat"])


def test_greedy_linkage(spark):
    left = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.5), (2, None, 10.0, 0.0, 0.5), (3, None, 12.0, 0.0, 0.5), (4, "d", 500.0, 0.0, 0.9)], "lid int, id string, lx double, ly double, ls double")
    right = spark.createDataFrame([(7, "a", 1.0, 0.0, 0.5, 2.0), (8, "a", 2.0, 0.0, 0.5, 1.0), (9, None, 11.5, 0.0, 0.5, 3.0), (10, "d", 500.0, 0.0, 0.1, 4.0)],
                                  "rid int, id string, rx double, ry double, rs double, dv double")
    old = spark.createDataFrame([(4, 9.0)], "lid int, dv double")
    out = J.match_multipass(left, right, "id", "lid", "rid", ("lx", "ly"), ("rx", "ry"), "ls", "rs", "dv", old)
    got = rows(out.select("lid", "rid", "dv", "pass", "ambiguous"), "lid")
    assert got[0] == (1, 7, 1.0, 1, True) and got[2] == (3, 9, 1.0, 2, True) and got[3] == (4, None, 9.0, 3, False)
    assert got[1][1] is None        # the loser of row 9 is not offered another one


def test_streams_land_once(spark, tmp_path):
    base = str(tmp_path)
    data = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    for _ in range(2):
        data.write.mode("append").parquet(f"{base}/in")
        IN.ingest_distinct(spark, f"{base}/in", data.schema, f"{base}/out", f"{base}/ck", "id", ["v"])
    assert spark.read.parquet(f"{base}/out").count() == 50


def test_materialise_once(spark, tmp_path):
    built = []
    make = lambda: built.append(1) or spark.range(3)
    path = str(tmp_path / "t")
    assert WR.materialise_once(spark, path, make, ["id"]).count() == 3 and WR.materialise_once(spark, path, make).count() == 3 and built == [1]
    with pytest.raises(Exception, match="is NULL"):
        WR.materialise_once(spark, path + "2", lambda: spark.createDataFrame([(None,)], "k int"), ["k"])


def test_missing_source_is_refused(spark):
    a, b = spark.createDataFrame([("NY",), ("PA",)], ["st"]), spark.createDataFrame([("NY",)], ["st"])
    with pytest.raises(ValueError, match="PA"):
        RD.require_sources(a, b, "st")


def test_encoding_is_decided_per_file(spark, tmp_path):
    """A Windows-1252 file beside a UTF-8 one, which holds a genuine replacement character."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes("k,v\n1,café \ufffd\n".encode())
    (folder / "b.csv").write_bytes("k,v\n2,café €\n".encode("cp1252"))
    assert rows(RD.csv_with_fallback(spark, str(folder)), "k") == [("1", "café \ufffd"), ("2", "café €")]


def test_state_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "NY25.txt").write_text("id,len\nn1,5\n")
    (tmp_path / "PA25.txt").write_text("len,id\n7,p1\n")
    got = rows(RD.state_files(spark, str(tmp_path), ["NY", "PA"], 2025, {"id": "i", "len": "l"}).select("i", "l", "src_state"), "i")
    assert got == [("n1", "5", "NY"), ("p1", "7", "PA")]


def test_protocol_runs_every_scheme(df):
    runs = ML.cross_validate(df, ["random", "group:huc", "leave:st"], [0, 1], {"flat": ML.Variant("mean", ML.Inputs(["x"])), "line": ML.Variant("linear", ML.Inputs(["x"]))}, "y", "id", 3, 100)
    got = {(r["scheme"], r["seed"], r["variant"]): r for r in runs.collect()}
    assert len(got) == 10 and all(r["n"] == 600 for r in got.values())
    assert all(got[s, i, "line"]["mae"] < got[s, i, "flat"]["mae"] for s, i, _ in got)


def test_stacked_rows_are_returned(spark):
    from rillmap.catalog import ORACLES, QUERIES
    got = {r["variant"]: r for r in QUERIES["residual_stack_stacked"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"base", "stacked"} and got["base"]["n"] == got["stacked"]["n"] > 0 and got["stacked"]["beats_mean"]
    assert {"residual_stack_stacked", "leave_state_out_weighted"} <= set(QUERIES) & set(ORACLES)


def test_a_repeated_structure_number_gives_one_whole_row(spark):
    """Of copies the smallest whole row with a position stays, whatever the order of the rows; values of two rows are not mixed."""
    ddl = "src_state string, nbi_id string, lon double, lat double, nbi_a double, nbi_b double"
    copies = [("25", "7", None, None, 0.0, 0.0), ("25", "7", -72.0, 42.0, 2.0, None), ("25", "7", -72.0, 42.0, None, 9.0), ("25", "7", -72.0, 42.0, 1.0, 4.0)]
    points = spark.createDataFrame([("p", -72.0, 42.0)], "cid string, lon_nad83 double, lat_nad83 double")
    for order in (copies, copies[::-1]):
        got = INV.join_inventory(points, spark.createDataFrame(order, ddl), "cid", keep_id=True).select("nbi_matched", "nbi_a", "nbi_b", "nbi_structure_number")
        assert rows(got) == [(1.0, None, 9.0, "7")]


def test_an_element_of_two_files_counts_once_by_its_longest_geometry(spark, tmp_path):
    from rillmap.sources.readers import tagged_elements
    place = [{"lon": float(i), "lat": 0.0} for i in range(3)]
    for name, n, lanes in (("a", 2, "1"), ("b", 3, "2")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"elements": [{"id": 5, "tags": {"highway": "primary", "lanes": lanes}, "geometry": place[:n]}]}))
    got = tagged_elements(spark, str(tmp_path)).collect()
    assert [(r["id"], r["osm_lanes"], len(r["geometry"])) for r in got] == [(5, "2", 3)]


def test_linear_models_from_moments_are_those_of_spark_ml(df):
    """One scan gives all folds; with gaps or categories the fit itself runs."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = SP.group_kfold(df, "huc", 3, 0).withColumn("w", 1 + F.col("id") % 4).withColumn("u", F.col("id") % 11 / 10).persist()
    variants = {"plain": ML.Variant("linear", ML.Inputs(["x", "u"])), "weighted": ML.Variant("ridge", ML.Inputs(["x", "u"]), weight="w"),
                "late": ML.Variant("elasticnet", ML.Inputs(["x"]), where=F.col("id") > 200)}
    assert set(ML.from_moments(d, "fold", variants, "y", ML.held_out(range(3)))) == set(variants)
    got = {r["id"]: r for r in ML.oof_many(d, "fold", range(3), variants, "y").collect()}
    for name, columns, rows_, kw in (("plain", ["x", "u"], "true", {}), ("weighted", ["x", "u"], "true", {"regParam": 0.1, "weightCol": "w"}),
                                     ("late", ["x"], "id > 200", {"regParam": 0.01, "elasticNetParam": 0.5})):
        put = VectorAssembler(inputCols=columns, outputCol="features")
        m = LinearRegression(labelCol="y", **kw).fit(put.transform(d.where("fold <> 1").where(rows_)))
        for r in m.transform(put.transform(d.where("fold = 1"))).collect():
            assert got[r["id"]][name] == pytest.approx(r["prediction"], abs=1e-6)
    assert not ML.from_moments(d, "fold", {"gaps": ML.Variant("linear", ML.Inputs(["z"]))}, "y", ML.held_out(range(3)))


def test_rows_of_a_tree_are_merged_by_bins(spark, monkeypatch):
    """What a fit reads is bounded by the different binned rows and FIT_ROWS, not by the table; weights keep their sum."""
    d = spark.range(5000).select((F.col("id") % 4 / 4).alias("a"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 2).cast("double").alias("y"))
    assert ML.tree_rows(d, ML.Inputs(["a"], ["c"]), "y")[1].count() == 5000
    monkeypatch.setattr(ML, "FIT_ROWS", 100)
    _, rows_, n = ML.tree_rows(d, ML.Inputs(["a"], ["c"]), "y")
    s = rows_.agg(F.count("*"), F.sum("_w"), F.max("_w")).first()
    assert n == 5000 and s[0] <= 100 + 4 * 3 * 2 and s[1] == pytest.approx(5000) and s[2] <= 50
    m = ML.fit(d, "boosted", ML.Inputs(["a"], ["c"]), "y", maxIter=3, maxDepth=2)
    assert ML.predict(m, d, "p").where("p is null or p < -0.5 or p > 1.5").count() == 0


def test_permutation_importance_sorts_once(df, monkeypatch):
    """Any number of repeats reads one stored order."""
    calls = []
    monkeypatch.setattr(ML, "with_rank", lambda *a, **k: calls.append(1) or SP.with_rank(*a, **k))
    d = df.where("z is not null")
    out = dict(rows(ML.permutation_importance(d, ML.fit(d, "linear", ML.Inputs(["x", "z"]), "y"), {"x": ["x"], "z": ["z"]}, "y", "id", 3).select("grp", "mae_increase")))
    assert len(calls) == 1 and out["x"] > 0.1 and abs(out["z"]) < 0.05


def test_one_count_serves_the_trees_of_every_fold(spark, monkeypatch):
    """The rows that a tree reads without a fold are those of a count of that training set alone; the table is counted once for all folds and input sets."""
    d = spark.range(900).select(F.when(F.col("id") % 9 != 0, F.col("id") % 13 / 4).alias("a"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 5).cast("int").alias("fold"),
                                (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 2).cast("double").alias("y"))
    calls = []
    monkeypatch.setattr(ML, "stored", lambda df: calls.append(1) or df)
    counted = ML.Binned(d, "fold", range(5), ML.Inputs(["a", "b"], ["c"]), "y")
    assert len(calls) == 1
    seen = lambda r: sorted((str(x["features"].toArray().tolist()), x["_y"], x["_w"]) for x in r.collect())
    for k, inputs in ((1, ML.Inputs(["a", "b"], ["c"])), (4, ML.Inputs(["a"]))):
        assert seen(counted.rows(k, inputs)[1]) == seen(ML.tree_rows(d.where(F.col("fold") != k), inputs, "y")[1])
    ready, fit_rows, _ = counted.rows(1)
    raw = ready.transform(d.where("fold <> 1")).select("features", F.col("y").alias("_y"), F.lit(1.0).alias("_w"))
    assert seen(raw) == seen(fit_rows)          # the stages give raw rows the same bins


def test_gaps_and_categories_of_a_linear_model_are_those_of_spark_ml(df):
    from pyspark.ml import Pipeline
    d, inputs = df.withColumn("w", F.lit(1.0)), ML.Inputs(["x", "z"], ["st"])
    for kind in ("linear", "ridge"):
        own, spark_ml = ML.fit(d, kind, inputs, "y"), Pipeline(stages=[*ML.preprocess(d, inputs), ML.maker(kind)().setLabelCol("y")]).fit(d)
        assert len(own.stages) == 1
        gap = ML.predict(own, ML.predict(spark_ml, d, "a"), "b").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
        assert gap < 1e-6


def test_a_stack_of_lines_reads_its_moments_once(df, monkeypatch):
    """The fit on residuals follows from the moments of the first scan and equals two fits one after the other."""
    d = SP.group_kfold(df, "huc", 3, 0).withColumn("u", F.col("id") % 11 / 10).persist()
    calls, scan = [], ML.L.moments_by_weight
    monkeypatch.setattr(ML.L, "moments_by_weight", lambda *a: calls.append(1) or scan(*a))
    got = ML.residual_stack(d, "fold", range(3), ML.Inputs(["x"]), ML.Inputs(["u", "x"]), "y", "ridge")
    assert len(calls) == 1
    first = ML.oof(d, "fold", range(3), "ridge", ML.Inputs(["x"]), "y", "base").withColumn("left", F.col("y") - F.col("base"))
    want = {r["id"]: r for r in ML.oof(first, "fold", range(3), "ridge", ML.Inputs(["u", "x"]), "left", "resid").collect()}
    assert got.columns == [*d.columns, "base", "resid", "stacked"] and got.count() == len(want) == 600
    for r in got.collect():
        assert r["base"] == pytest.approx(want[r["id"]]["base"], abs=1e-9) and r["resid"] == pytest.approx(want[r["id"]]["resid"], abs=1e-9)
    gaps = ML.residual_stack(d, "fold", range(3), ML.Inputs(["x"]), ML.Inputs(["z"]), "y", "linear")
    assert gaps.count() == 600 and gaps.where("stacked IS NULL").count() == 0
