"""Column expressions and cleaning rules on the edge cases that decide results."""
import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillmap.functions import geo as G
from rillmap.functions import scoring as SC
from rillmap.functions import text as X
from rillmap.operators import clean as C
from rillmap.operators import joins as J
from rillmap.operators import metrics as M
from rillmap.plans.surveys import clean_surveys, cleaning_counts


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v"))).first()[0]


def test_positions(spark):
    lat = lambda v: one(spark, lambda c: X.dms_to_degrees(c, 2), v)
    for d, m, s in ((0, 0, 0.0), (38, 59, 59.99), (47, 1, 0.5)):
        assert lat(f"{d:02d}{m:02d}{round(s * 100):04d}") == pytest.approx(d + m / 60 + s / 3600)
    assert one(spark, lambda c: X.dms_to_degrees(c, 3), "009000100") == pytest.approx(9 + 1 / 3600)
    assert [lat(v) for v in ("38600000", "38006000", "thirty", None)] == [None] * 4


def test_curves(spark):
    d = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,), (3.0,), (-1.0,), (None,)], "v double")
    drop = [r[0] for r in d.select(SC.outlet_drop_score(F.col("v"))).collect()]
    assert drop[0] == 1.0 and drop[:5] == sorted(drop[:5], reverse=True) and drop[4] < 0.2 and drop[5] == 1.0 and drop[6] is None
    op = [r[0] for r in d.select(SC.openness_score(F.col("v"))).collect()]
    assert op[0] == 0.0 and op[:5] == sorted(op[:5]) and max(op[:5]) <= 1
    assert max(r[0] for r in d.where("v is not null").select(SC.height_score(F.col("v"))).collect()) == pytest.approx(1.1 * 9 / (4.84 + 9))
    assert sum(SC.WEIGHTS.values()) == pytest.approx(1.0)


def test_composite(spark):
    cols = [c for c, _, _ in SC.CATEGORIES.values()]
    fields = ", ".join(f"{c} string" for c in cols)
    df = spark.createDataFrame([(0.16, 3.0, 0.0, *["None"] * len(cols)), (None, None, None, *[None] * len(cols)), (0.5, 5.0, 1.5, *["Severe"] * len(cols))],
                               f"Outlet_Openness double, Outlet_Height double, Outlet_Drop_To_Water_Surface double, {fields}")
    out = [tuple(r) for r in SC.add_passability(df).select("composite", "final").collect()]
    assert out[1] == (0.0, 0.0) and out[0][1] > out[2][1] and all(0 <= f <= 1 for _, f in out)
    kept = SC.add_passability(df).select("physical_barriers").first()[0]
    gone = SC.add_passability(df, none_is_null=True).select("physical_barriers").first()[0]
    assert kept == 1.0 and gone is None


@pytest.mark.parametrize("tags, want", [
    ({"railway": "tram", "surface": "asphalt"}, "railroad"), ({"highway": "service"}, "paved"), ({"highway": "service", "service": "alley", "surface": "dirt"}, "unpaved"),
    ({"highway": "path", "lanes": "6"}, "trail"), ({"highway": "primary", "lanes": "3"}, "multilane road (>2 lanes)"), ({"highway": "primary", "lanes": "two"}, "paved"),
    ({"highway": "track"}, "unpaved"), ({"surface": "concrete"}, "paved"), ({"highway": None, "railway": None}, "unknown")])
def test_road_classes(spark, tags, want):
    names = ("highway", "railway", "surface", "service", "lanes")
    d = spark.createDataFrame([tuple(tags.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    assert d.select(X.classify_road(*[F.col(n) for n in names])).first()[0] == want


def test_hstore_and_measures(spark):
    m = one(spark, X.parse_hstore, '"a"=>"1", "b" => "x=>y","c"=>"he said \\"no\\"","a"=>"2"')
    assert m["a"] == "2" and len(m) >= 2 and one(spark, X.parse_hstore, "") in ({}, None)
    f = lambda v: tuple(one(spark, X.parse_measure, v))
    assert f("36") == (3.0, 3.0, 3.0) and f("0") == (0.0, 0.0, 0.0) and f("6-12") == pytest.approx((0.75, 0.5, 1.0)) and f(">12") == (1.0, 1.0, None)
    assert f("unknown") == f("") == f(None) == (None, None, None)
    assert one(spark, X.is_range, "3-4") is True


def test_geometry(spark):
    d = spark.range(1)
    assert d.select(G.haversine_km(*[F.lit(v) for v in (42.0, -76.0, 43.0, -76.0)])).first()[0] == pytest.approx(111.2, abs=0.1)
    x, y = d.select(*G.albers(F.lit(-75.0), F.lit(42.5))).first()
    assert (x, y) == pytest.approx((1701310.397, 2355568.897), abs=1e-2)
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((-76.0, 43.0), (-75.9, 43.0), (-75.9, 43.1), (-76.0, 43.1), (-76.0, 43.0))])
    assert 60 < d.select(G.ring_area_km2(ring)).first()[0] < 100


def test_null_rules(spark):
    d = spark.createDataFrame([("Yes",), (" no ",), (None,)], "t string")
    assert d.where(C.not_text("t", "yes")).count() == 1 and d.where(C.not_in_text("t", ["yes"])).count() == 2
    assert one(spark, lambda c: C.clip(c, 0.0, 1.0), None, "double") is None and one(spark, lambda c: C.clip(c, 0.0, 1.0), 3.0, "double") == 1.0


def test_collapse_modes(spark):
    d = spark.createDataFrame([("a", 0.5, "x", None), ("a", 0.2, None, 7), ("a", 0.9, "z", 1), (None, 0.1, "n", 2)], "k string, s double, t string, u int")
    assert rows(C.collapse_first(d, ["k"], ["s"]), "k") == [(None, 0.1, "n", 2), ("a", 0.2, "x", 7)]
    assert rows(C.collapse_first(d, ["k"], ["s"], mode="row"), "k") == [(None, 0.1, "n", 2), ("a", 0.2, None, 7)]
    days = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1), ("a", None, 2)], "k string, d date, v int")
    assert rows(C.collapse_first(days, ["k"], ["d"], last=True).select("k", "v")) == [("a", 2)]      # an unknown date sorts last


def test_survey_plan(spark):
    cols = ["Survey_Id", "Crossing_Code", "Date_Observed", "_geom_x", "_geom_y", "Aqua_Pass_Score", "Tidal_Site", "Crossing_Type", "Approved", "NHD_HUC8_Watershed", "Inlet_Height"]
    ok = ("-75.0", "42.0", "0.5", "No", "Culvert", "1", "Mohawk", "-1")
    data = [("1", "c1", "2019-05-01", *ok), ("2", "c1", "2019-05-01", "-75.0", "42.0", "0.2", "No", None, "1.0", None, "3"), ("3", "c1", "2015-01-01", *ok),
            ("4", "c2", "2019-05-01", "-75.0", "42.0", "-1", *ok[3:]), ("5", "c3", "2019-05-01", "-75.0", "42.0", "0.4", None, *ok[4:]), ("6", "c4", "2019-05-01", "-10.0", *ok[1:])]
    raw = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    out = clean_surveys(raw, ["Survey_Id", "NHD_HUC8_Watershed", "Inlet_Height"]).collect()
    assert len(out) == 1 and out[0]["passability"] == 0.2 and out[0]["huc8_name"] == "Mohawk" and out[0]["year"] == 2019 and out[0]["Inlet_Height"] == 3.0
    counts = rows(cleaning_counts(raw).select("before", "after"), F.col("step"))
    assert counts == [(6, 5), (5, 5), (5, 4), (4, 3), (3, 3), (3, 3)]


def test_guard_and_columns(spark):
    a = spark.createDataFrame([(1, 0.5)], "k int, a double")
    ok, bad = spark.createDataFrame([(1, 0.501)], "k int, b double"), spark.createDataFrame([(1, 0.6)], "k int, b double")
    assert J.join_guarded(a, ok, "k", "a", "b").count() == 1
    with pytest.raises(Exception, match="disagree"):
        J.join_guarded(a, bad, "k", "a", "b").collect()
    assert J.resolve_columns(["Survey ID ", "x"], {"sid": "survey_id"}, {"q": "absent"}) == {"Survey ID ": "sid"}
    with pytest.raises(ValueError, match="missing"):
        J.resolve_columns(["x"], {"sid": "survey_id"})


def test_metric_identities(spark):
    d = spark.createDataFrame([(v,) for v in (0.1, 0.5, 0.9, 0.3)], "y double")
    m = M.regression_by(d.withColumn("p", F.lit(0.45)), "y", "p").first()
    assert m["r2"] == pytest.approx(0.0) and m["pred_sd_ratio"] == 0.0
    assert M.regression_by(d.withColumn("p", F.col("y")), "y", "p").first()["r2"] == 1.0
    assert M.regression_by(d.withColumns({"k": F.lit(1.0), "p": F.lit(0.5)}), "k", "p").first()["r2"] is None
    assert rows(M.bin_counts(spark.createDataFrame([(0.0,), (5.0,), (5.1,)], "d double"), "d", [0, 5, 10]).select("lo", "hi", "n"), "lo") == [(0.0, 5.0, 1), (5.0, 10.0, 1)]
