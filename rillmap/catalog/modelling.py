"""Queries for feature tables and models.

Linear fits of one or two inputs have a closed form, and their twins compute it. Of tree models the twins check what must hold for any fit: every row predicted
once, bounds, and an error below that of the mean.
"""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.catalog.evaluation import KEY, MET, greedy
from rillmap.catalog.spatial_shapes import EDGED, EDGES, INSIDE, SEGD
from rillmap.operators import metrics as M
from rillmap.operators import points as P
from rillmap.operators import shapes as S
from rillmap.operators import splits as SP
from rillmap.plans import features as FE
from rillmap.plans import models as ML
from rillmap.plans import tuning as TU
from rillmap.session import cut, scratch_path
from rillmap.sources import readers as RD
from rillmap.sources import writers as WR

NUM = ["f_quantity", "f_price", "f_tax", "f_signal"]
CAT = ["flag", "status"]
FOLDS = range(5)
ROUNDS = dict(maxIter=20, maxDepth=3, stepSize=0.2)          # settings of the registered queries; the library's own defaults are the full ones
TREES = dict(numTrees=20, maxDepth=6)

BASE = """SELECT ((l_orderkey*8+l_linenumber)*64+CAST(l_quantity AS BIGINT))*1048576+l_partkey AS rid, CAST(l_discount*10 AS DOUBLE) AS y, CASE WHEN l_quantity=7 THEN NULL ELSE l_quantity END AS f_quantity,
      l_extendedprice AS f_price, l_tax AS f_tax, l_discount*4+l_tax*2+l_quantity/200 AS f_signal, l_returnflag AS flag, CASE WHEN l_linenumber=3 THEN NULL ELSE l_linestatus END AS status,
      CAST(l_suppkey%40 AS INT) AS huc, CAST(l_suppkey%7 AS INT) AS st, CAST(year(CAST(l_shipdate AS DATE)) AS INT) AS year, CAST(CASE WHEN l_discount>0.05 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS poor FROM lineitem"""


def table(t):
    """Rows with a target, inputs with gaps, categories, groups and a group fold."""
    return SP.group_kfold(t.sql(BASE), "huc", 5, 0)


# ---- closed forms for the twins

D = f"WITH RECURSIVE {greedy(KEY.format(0, 'huc') + ', huc::VARCHAR')}, d AS (SELECT b.*, f.fold FROM ({BASE}) b JOIN f USING (huc)), ks AS (SELECT DISTINCT fold AS k FROM f)"


def one(name, x, y="y", where="TRUE", w="1.0"):
    """Least squares on one input, fitted without fold k: tables <name>_f (k, a, b) and <name> (all rows of d with p)."""
    s = f"sum({w}) AS sw, sum({w}*{x}) AS sx, sum({w}*{y}) AS sy, sum({w}*{x}*{x}) AS sxx, sum({w}*{x}*{y}) AS sxy"
    return f"""{name}_s AS (SELECT k, {s} FROM d JOIN ks ON fold<>k WHERE {where} GROUP BY k),
{name}_f AS (SELECT k, (sw*sxy-sx*sy)/(sw*sxx-sx*sx) AS b, (sy-(sw*sxy-sx*sy)/(sw*sxx-sx*sx)*sx)/sw AS a FROM {name}_s),
{name} AS (SELECT d.*, a+b*{x} AS p FROM d JOIN {name}_f ON k=fold)"""


def two(name, x1, x2, y="y", where="TRUE", train=("", "")):
    """Least squares on two inputs; ``train`` names other columns to fit on."""
    t1, t2 = train[0] or x1, train[1] or x2
    return f"""{name}_s AS (SELECT k, var_pop({t1}) AS v1, var_pop({t2}) AS v2, covar_pop({t1},{t2}) AS c, covar_pop({t1},{y}) AS c1, covar_pop({t2},{y}) AS c2, avg({t1}) AS m1, avg({t2}) AS m2, avg({y}) AS my FROM d JOIN ks ON fold<>k WHERE {where} GROUP BY k),
{name}_f AS (SELECT *, (v2*c1-c*c2)/(v1*v2-c*c) AS b1, (v1*c2-c*c1)/(v1*v2-c*c) AS b2 FROM {name}_s),
{name} AS (SELECT d.*, my+b1*({x1}-m1)+b2*({x2}-m2) AS p FROM d JOIN {name}_f ON k=fold)"""


IN = ML.Inputs(NUM, CAT)
SIGNAL = ML.Inputs(["f_signal"])


def r6(df, *keep):
    return df.select(*[c if c in keep else F.round(c, 6).alias(c) for c in df.columns])


def beats(df, *by, p="oof", y="y"):
    """Rows, whether all predictions are there and bounded, and whether they are closer to the truth than its mean."""
    out = M.regression_by(df, y, p, by, extra=[F.bool_and(F.col(p).between(-0.5, 1.5)).alias("in_bounds")])
    return out.select(*by, "n", "in_bounds", (F.col("r2") > 0).alias("beats_mean"))


@query("preprocess", f"""WITH d AS ({BASE}), q AS (SELECT median(f_quantity) AS m FROM d), w AS (SELECT 4+1+(SELECT count(DISTINCT flag)+2 FROM d)+(SELECT count(DISTINCT status)+2 FROM d) AS width)
SELECT flag, status, count(*) AS n, CAST((SELECT width FROM w) AS INT) AS width, round(avg(coalesce(f_quantity,(SELECT m FROM q))),6) AS mean_filled, count(*) FILTER (WHERE f_quantity IS NULL) AS n_flagged FROM d GROUP BY flag, status""")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    d = table(t)
    ready = Pipeline(stages=ML.preprocess(d, IN)).fit(d).transform(d)
    v = vector_to_array("features")
    return ready.groupBy("flag", "status").agg(F.count("*").alias("n"), F.max(F.size(v)).alias("width"), F.round(F.avg(v[0]), 6).alias("mean_filled"), F.sum(v[4]).cast("bigint").alias("n_flagged"))


@query("model_ladder", f"""{D}, {two('lin', 'f_price', 'f_signal')}, mean AS (SELECT d.*, (SELECT avg(y) FROM d o WHERE o.fold<>d.fold) AS p FROM d),
m AS (SELECT 'linear' AS variant, {MET} FROM lin UNION ALL SELECT 'mean', {MET} FROM mean)
SELECT variant, n, r2, r2>0 AS beats_mean FROM m UNION ALL SELECT v, (SELECT count(*) FROM d), NULL, TRUE FROM (VALUES ('ridge'),('elasticnet'),('random_forest'),('boosted')) q(v)""")
def _(t):
    with ML.kept(table(t).select("fold", "y", "f_price", "f_signal")) as d:
        m = ML.model_ladder(d, "fold", FOLDS, ML.Inputs(["f_price", "f_signal"]), "y", settings={"boosted": ROUNDS, "random_forest": TREES})
    return m.select("variant", "n", F.when(F.col("variant").isin("mean", "linear"), F.round("r2", 6)).alias("r2"), (F.col("r2") > 0).alias("beats_mean"))


MEMBERS = [("linear", {}), ("boosted", ROUNDS), ("random_forest", TREES)]
ROWS_PER_FOLD = f"{D} SELECT fold, count(*) AS n, TRUE AS in_bounds, TRUE AS beats_mean FROM d GROUP BY fold"


@query("ensemble_mean", ROWS_PER_FOLD)
def _(t):
    with ML.kept(table(t).select("fold", "y", *NUM, *CAT)) as d:
        return beats(ML.ensemble_oof(d, "fold", FOLDS, MEMBERS, IN, "y"), "fold")


@query("group_tuning", "SELECT 20::BIGINT AS n, 20::BIGINT AS n_distinct, TRUE AS ordered, TRUE AS better_than_mean")
def _(t):
    """All twenty settings of a ridge, each error at most the next one's; the best one is closer than the mean."""
    with ML.kept(table(t).select("fold", "y", *NUM, *CAT)) as d:
        tuned = ML.group_tuning(d, "fold", 5, IN, "y", "ridge", {"regParam": [0.001, 0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.0, 0.3, 0.6, 1.0]}, 20)
        flat = M.regression_by(d.withColumn("m", d.agg(F.avg("y")).scalar()), "y", "m").select("mae").first()[0]
    rows = tuned.collect()                                                              # twenty rows, best first
    errors = [r["mae"] for r in rows]
    found = (len(rows), len({r["params"] for r in rows}), all(x <= y for x, y in zip(errors, errors[1:])), errors[0] < flat)
    return t.spark.createDataFrame([found], "n bigint, n_distinct bigint, ordered boolean, better_than_mean boolean")


TWO_MEANS = "CASE WHEN f_signal>0.37 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"


@query("boosting_tuning", f"""{D}, t AS (SELECT y, fold, {TWO_MEANS} AS x FROM d), m AS (SELECT x, avg(y) AS p FROM t WHERE fold<>0 GROUP BY x)
SELECT 'boosted' AS objective, 20::BIGINT AS n, 1::BIGINT AS best_round, 20::BIGINT AS n_stopped, round(avg((y-p)*(y-p)),6) AS mse FROM t JOIN m USING (x) WHERE fold=0""")
def _(t):
    """Twenty draws of boosted trees on one binary input, where the first round gives the means of both halves and no later one helps: all stop at it. The log
    is written and the best setting read back from it."""
    d = table(t).withColumn("x", F.expr(TWO_MEANS))
    grid = {"maxDepth": [1, 2, 3, 4], "stepSize": [0.02, 0.05, 0.1, 0.3], "minInstancesPerNode": [1, 5, 20]}
    log = TU.tune_boosting(d, F.col("fold") == 0, ML.Inputs(["x"]), "y", grid, 20, first=4, last=64, patience=3, subsamplingRate=1.0)
    path = scratch_path(t.spark, "tuning")
    scores = TU.scored(log, "boosted")
    WR.append_chunk(scores, path)
    best = RD.best_results(t.spark, path, scores.schema, "objective", "score", "params")
    stopped = F.lit(log.where("stopped").count()).cast("bigint").alias("n_stopped")
    return best.select("objective", "n", F.get_json_object("params", "$.maxIter").cast("bigint").alias("best_round"), stopped, F.round(-F.col("score"), 6).alias("mse"))


@query("oof_predictions", ROWS_PER_FOLD)
def _(t):
    with ML.kept(table(t).select("fold", "y", *NUM, *CAT)) as d:
        return beats(ML.oof(d, "fold", FOLDS, "boosted", IN, "y", **ROUNDS), "fold")


def protocol():
    """Seven runs of one linear input: three seeds of row folds, three of group folds, and one state left out at a time."""
    folds = ["unused AS (SELECT 1)"]
    runs = []
    for seed in range(3):
        g = greedy(KEY.format(seed, "huc") + ", huc::VARCHAR")
        for name in ("g", "o", "w", "f"):
            g = g.replace(f"{name} AS (", f"{name}{seed} AS (").replace(f" FROM {name} ", f" FROM {name}{seed} {name} ").replace(f" FROM {name})", f" FROM {name}{seed} {name})").replace(f"JOIN {name} ON", f"JOIN {name}{seed} {name} ON")
        folds.append(g)
        runs.append(("group:huc", seed, f"SELECT b.y, b.f_signal AS x, f.fold FROM b JOIN f{seed} f USING (huc)"))
        runs.append(("random", seed, f"SELECT y, f_signal AS x, (row_number() OVER (ORDER BY {KEY.format(seed, 'rid')}, rid)-1)%5 AS fold FROM b"))
    runs.append(("leave:st", 0, "SELECT y, f_signal AS x, st AS fold FROM b"))
    parts = []
    for i, (scheme, seed, sql) in enumerate(runs):
        folds.append(f"""r{i} AS ({sql}), c{i} AS (SELECT k, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM r{i} JOIN (SELECT DISTINCT fold AS k FROM r{i}) q ON fold<>k GROUP BY k)""")
        parts.append(f"SELECT '{scheme}' AS scheme, 1-sum((a+b*x-y)*(a+b*x-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS r2, count(*) AS n FROM r{i} JOIN c{i} ON k=fold")
    return f"""WITH RECURSIVE b AS ({BASE}), {', '.join(folds)}, m AS ({' UNION ALL '.join(parts)})
SELECT scheme, 'linear' AS variant, count(*) AS n_runs, round(avg(r2),6) AS mean, round(stddev_pop(r2),6) AS sd_pop, round(stddev_samp(r2),6) AS sd_samp FROM m GROUP BY scheme"""


@query("cv_protocol", protocol())
def _(t):
    runs = ML.cross_validate(t.sql(BASE), ["group:huc", "random", "leave:st"], [0, 1, 2], {"linear": ML.Variant("linear", SIGNAL)}, "y", "rid")
    return r6(M.summarise_runs(runs, "r2", ["scheme", "variant"]), "scheme", "variant", "n_runs")


@query("nested_aux_stack", ROWS_PER_FOLD)
def _(t):
    hook = ML.aux_stack_hook(ML.Inputs(NUM), "poor", "rid", "huc", 3, maxIter=5, maxDepth=3, stepSize=0.2)
    d = table(t).select("rid", "huc", "fold", "y", "poor", *NUM)
    return beats(ML.oof(d, "fold", FOLDS, "linear", ML.Inputs(NUM, (), ("aux_p",)), "y", prep=hook), "fold")


FOLD_KNN = """pairs AS (SELECT h.held, a.pid, b.pid AS rid, b.v AS label, CASE WHEN b.seg_name='BUILDING' THEN 1.0 ELSE 0.0 END AS flag, a.region=h.held AS test, a.grp AS qg, b.grp AS rg,
 sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM px_points a, px_points b, (VALUES (0),(1),(2),(3),(4)) h(held) WHERE b.region<>h.held),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held, pid ORDER BY d, rid) AS r0 FROM pairs) q WHERE r0<=40),
k AS (SELECT *, row_number() OVER (PARTITION BY held, pid ORDER BY d, rid) AS r, 1.0::DOUBLE/(d+100.0) AS w FROM top WHERE d>0.5 AND (test OR qg<>rg))"""


@query("fold_safe_neighbour_features", f"""WITH {FOLD_KNN} SELECT held, pid, round(sum(CASE WHEN r<=5 THEN w*label END)/sum(CASE WHEN r<=5 THEN w END),6) AS nb_mean_k5,
round(sum(CASE WHEN r<=15 THEN w*flag END)/sum(CASE WHEN r<=15 THEN w END),6) AS nb_flag_share_k15, round(min(d)/1000.0,6) AS nb_nearest_km, count(CASE WHEN d<=800 THEN 1 END) AS nb_n_ball FROM k GROUP BY held, pid""")
def _(t):
    p = t.px_points.withColumn("flag", F.col("seg_name") == "BUILDING")
    out = FE.fold_safe_neighbours(p, "pid", "v", "flag", "grp", "region", range(5), 40, 800.0)
    return r6(out.select("held", "pid", "nb_mean_k5", "nb_flag_share_k15", "nb_nearest_km", "nb_n_ball"), "held", "pid", "nb_n_ball")


@query("residual_stack", f"{D}, {one('b', 'f_signal')} SELECT 'base' AS variant, {MET.split(', round(sqrt')[0]}, TRUE AS beats_mean FROM b")
def _(t):
    d = table(t)
    s = ML.residual_stack(d, "fold", FOLDS, SIGNAL, ML.Inputs(["f_tax"]), "y", "linear")
    m = ML.score_variants(s, "y", ["base", "stacked"])
    return m.where("variant = 'base'").select("variant", "n", F.round("mae", 6).alias("mae"), (F.col("r2") > 0).alias("beats_mean"))


@query("residual_stack_stacked", f"""{D}, {one('b', 'f_signal')}, e AS (SELECT *, y-p AS resid FROM b), e_f AS (SELECT k, regr_slope(resid,f_tax) AS b2, regr_intercept(resid,f_tax) AS a2 FROM e JOIN ks ON fold<>k GROUP BY k),
s AS (SELECT y, greatest(0.0, least(1.0, p+a2+b2*f_tax)) AS p FROM e JOIN e_f ON k=fold)
SELECT 'base' AS variant, {MET.split(', round(sqrt')[0]}, TRUE AS beats_mean FROM b UNION ALL SELECT 'stacked', {MET.split(', round(sqrt')[0]}, TRUE FROM s""")
def _(t):
    """Both rows of the stack; ``residual_stack`` has the base alone."""
    d = table(t)
    s = ML.residual_stack(d, "fold", FOLDS, SIGNAL, ML.Inputs(["f_tax"]), "y", "linear")
    return ML.score_variants(s, "y", ["base", "stacked"]).select("variant", "n", F.round("mae", 6).alias("mae"), (F.col("r2") > 0).alias("beats_mean"))


@query("ablation_table", f"""{D}, {two('every', 'f_price', 'f_signal')}, {one('price', 'f_price')}, {one('signal', 'f_signal')}, {two('tp', 'f_tax', 'f_price')}, {two('ts', 'f_tax', 'f_signal')}
SELECT 'all' AS variant, {MET} FROM every UNION ALL SELECT 'drop_price', {MET} FROM signal UNION ALL SELECT 'only_price', {MET} FROM price UNION ALL SELECT 'add_price', {MET} FROM tp
UNION ALL SELECT 'drop_signal', {MET} FROM price UNION ALL SELECT 'only_signal', {MET} FROM signal UNION ALL SELECT 'add_signal', {MET} FROM ts""")
def _(t):
    sets = ML.drop_only_add({"price": ["f_price"], "signal": ["f_signal"]}, ["f_tax"])
    d = table(t)
    return r6(ML.ablation_table(d, "fold", FOLDS, sets, "y", "linear"), "variant", "n")


@query("weighted_fit", f"""{D.replace("d AS (SELECT b.*, f.fold", "d AS (SELECT b.*, f.fold, 1.0/sqrt(CAST(f.n AS DOUBLE)) AS w_group, exp((year-2026)/8.0) AS w_recent").replace("JOIN f USING (huc))", "JOIN (SELECT f.*, g.n FROM f JOIN g USING (huc)) f USING (huc))")},
{one('plain', 'f_signal')}, {one('grp', 'f_signal', w='w_group')}, {one('yr', 'f_signal', w='w_recent')}
SELECT 'plain' AS variant, {MET} FROM plain UNION ALL SELECT 'by_group', {MET} FROM grp UNION ALL SELECT 'by_year', {MET} FROM yr""")
def _(t):
    rows = t.sql(BASE)
    counts = SP.group_counts(rows, "huc")
    d = SP.group_size_weight(SP.group_kfold(rows, "huc", 5, 0, counts=counts), "huc", 0.5, "w_group", counts).withColumn("w_recent", F.exp((F.col("year") - 2026) / 8.0))
    a = ML.oof_many(d, "fold", FOLDS, {"plain": ML.Variant("linear", SIGNAL), "by_group": ML.Variant("linear", SIGNAL, weight="w_group"),
                                       "by_year": ML.Variant("linear", SIGNAL, weight="w_recent")}, "y")
    return r6(ML.score_variants(a, "y", ["plain", "by_group", "by_year"]), "variant", "n")


@query("domain_weights", f"SELECT st, count(*) AS n, TRUE AS in_bounds, 1.0::DOUBLE AS mean_all FROM ({BASE}) b WHERE st<>3 GROUP BY st")
def _(t):
    d = t.sql(BASE).select("rid", "st", (F.col("st") == 3).cast("int").alias("dom"), *NUM)
    with ML.kept(d) as d:
        w = ML.domain_weights(d, "dom", "rid", ML.Inputs(NUM), 0, **ROUNDS)
        whole = w.agg(F.round(F.avg("weight"), 6)).scalar()
        return w.groupBy("st").agg(F.count("*").alias("n"), F.bool_and(F.col("weight") > 0).alias("in_bounds")).withColumn("mean_all", whole)


def left_out(t, *variants):
    """States are placed by their mean price; the nearest three are each state's region."""
    rows = t.sql(BASE)
    centres = rows.groupBy("st").agg(F.avg("f_price").alias("x"), F.lit(0.0).alias("y"))
    found = P.nearest_groups(centres, "st", 3).collect()                 # three rows a state
    near = {}
    for r in found:
        near.setdefault(r["st"], []).append(r["other"])
    rows = rows.select("rid", "st", "y", "f_signal")
    return ML.leave_group_out_variants(rows, "st", sorted(near), near, SIGNAL, "y", "rid", weight_params=ROUNDS, variants=variants)


@query("leave_state_out_variants", f"""WITH d AS (SELECT *, st AS fold FROM ({BASE}) b), ks AS (SELECT DISTINCT fold AS k FROM d), {one('pooled', 'f_signal')},
c AS (SELECT st, avg(f_price) AS cx FROM d GROUP BY st), near AS (SELECT * FROM (SELECT a.st AS k, b.st AS other, row_number() OVER (PARTITION BY a.st ORDER BY abs(a.cx-b.cx), b.st) AS rn FROM c a JOIN c b ON a.st<>b.st) q WHERE rn<=3),
rf AS (SELECT k, regr_slope(y,f_signal) AS b, regr_intercept(y,f_signal) AS a FROM d JOIN near ON d.st=other GROUP BY k),
v AS (SELECT pooled.st, y, p AS pp, a+b*f_signal AS pr, (p+a+b*f_signal)/2 AS pe FROM pooled JOIN rf ON k=fold),
m AS (SELECT st, 1-sum((pp-y)*(pp-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS rp, 1-sum((pr-y)*(pr-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS rr, 1-sum((pe-y)*(pe-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS re FROM v GROUP BY st HAVING count(*)>=300)
SELECT 'regional' AS variant, count(*) AS groups, round(avg(rr),6) AS mean_r2, count(CASE WHEN rr>rp THEN 1 END) AS wins FROM m UNION ALL SELECT 'ensemble', count(*), round(avg(re),6), count(CASE WHEN re>rp THEN 1 END) FROM m""")
def _(t):
    return r6(ML.win_table(left_out(t, "pooled", "regional"), "st", "y", "pooled", ["regional", "ensemble"]), "variant", "groups", "wins")


@query("leave_state_out_weighted", f"SELECT st, count(*) AS n, TRUE AS in_bounds, TRUE AS beats_mean FROM ({BASE}) b GROUP BY st")
def _(t):
    """The variant that weights rows toward the state; its weights come from boosted trees, which have no closed form."""
    return beats(left_out(t, "weighted"), "st", p="weighted")


@query("per_group_models", f"""{D.replace("d AS (SELECT b.*, f.fold", "d AS (SELECT b.*, f.fold, CAST(floor(st/3.0) AS INT) AS region")}, {one('pooled', 'f_signal')},
gf AS (SELECT k, region, regr_slope(y,f_signal) AS b, regr_intercept(y,f_signal) AS a, avg(f_signal) AS mx, avg(y) AS my, regr_sxy(y,f_signal) AS sxy, regr_sxx(y,f_signal) AS sxx FROM d JOIN ks ON fold<>k GROUP BY k, region),
wf AS (SELECT k, sum(sxy)/sum(sxx) AS bw FROM gf GROUP BY k),
v AS (SELECT pooled.y, p AS p1, my+bw*(f_signal-mx) AS p2, gf.a+gf.b*f_signal AS p3 FROM pooled JOIN gf ON gf.k=fold AND gf.region=pooled.region JOIN wf ON wf.k=fold)
SELECT 'pooled' AS variant, {MET} FROM (SELECT y, p1 AS p FROM v) q UNION ALL SELECT 'pooled_group', {MET} FROM (SELECT y, p2 AS p FROM v) q UNION ALL SELECT 'own', {MET} FROM (SELECT y, p3 AS p FROM v) q
UNION ALL SELECT 'ensemble', {MET} FROM (SELECT y, (p2+p3)/2 AS p FROM v) q""")
def _(t):
    with ML.kept(table(t).withColumn("region", F.floor(F.col("st") / 3).cast("int"))) as d:
        o = ML.per_group_models(d, "region", "fold", FOLDS, SIGNAL, "y", 800)
    return r6(ML.score_variants(o, "y", ["pooled", "pooled_group", "own", "ensemble"]), "variant", "n")


@query("forward_selection", f"""{D}, {one('price', 'f_price')}, {one('signal', 'f_signal')}, {two('every', 'f_price', 'f_signal')}, s AS (SELECT 'price' AS g, {MET} FROM price UNION ALL SELECT 'signal', {MET} FROM signal),
first AS (SELECT g, r2 FROM s ORDER BY r2 DESC, g LIMIT 1), b AS (SELECT {MET} FROM every)
SELECT 1 AS step, g AS added, r2, TRUE AS kept FROM first UNION ALL SELECT 2, CASE g WHEN 'price' THEN 'signal' ELSE 'price' END, b.r2, b.r2>=first.r2+0.001 FROM first, b""")
def _(t):
    d = table(t)
    return r6(ML.forward_selection(d, "fold", FOLDS, {"price": ["f_price"], "signal": ["f_signal"]}, "y"), "step", "added", "kept")


@query("infold_top_k_features", ROWS_PER_FOLD)
def _(t):
    with ML.kept(table(t).select("fold", "y", *NUM)) as d:
        return beats(ML.top_k_oof(d, "fold", FOLDS, NUM, "y", 2, **ROUNDS), "fold")


@query("direct_classifier_ranking", """SELECT 'regression, ranked' AS model, TRUE AS better_than_chance, TRUE AS in_bounds UNION ALL SELECT 'classifier', TRUE, TRUE""")
def _(t):
    d = table(t).select("rid", "fold", "y", (F.col("y") < 0.3).cast("int").alias("label"), *NUM)
    o = ML.oof_many(d, "fold", FOLDS, {"reg": ML.Variant("boosted", ML.Inputs(NUM), params=ROUNDS), "direct": ML.Variant("classifier", ML.Inputs(NUM), "label", params=ROUNDS)}, "y")
    parts = []
    for how, risk in (("regression, ranked", 1 - F.col("reg")), ("classifier", F.col("direct"))):
        s = o.select("rid", "label", risk.alias("risk"))
        one_row = M.capture_at(s, "label", "risk", "rid").withColumns({"auc": M.roc_auc(s, "label", "risk").scalar(), "ap": M.average_precision(s, "label", "risk").scalar()})
        parts.append(ML.labelled(one_row, model=how))
    both = parts[0].unionByName(parts[1])
    return both.select("model", ((F.col("auc") > 0.6) & (F.col("caught_20") > 0.2)).alias("better_than_chance"), (F.col("ap").between(0, 1) & (F.col("caught_10") <= F.col("caught_20"))).alias("in_bounds"))


@query("train_window_filter", f"""{D}, {one('every', 'f_signal')}, {one('late', 'f_signal', where='year>=1999')}, v AS (SELECT 'all_years' AS variant, y, p, year FROM every UNION ALL SELECT 'recent', y, p, year FROM late)
SELECT variant, CASE WHEN year>=1999 THEN 'recent rows' ELSE 'older rows' END AS part, {MET} FROM v GROUP BY 1, 2""")
def _(t):
    d = table(t)
    o = ML.oof_many(d, "fold", FOLDS, {"all_years": ML.Variant("linear", SIGNAL), "recent": ML.Variant("linear", SIGNAL, where=F.col("year") >= 1999)}, "y")
    recent = o.withColumn("part", F.when(F.col("year") >= 1999, "recent rows").otherwise("older rows"))
    return r6(ML.score_variants(recent, "y", ["all_years", "recent"], ["part"]), "variant", "part", "n")


@query("transfer_eval", f"""{D}, {one('alone', 'f_signal', where='st<4')}, {one('every', 'f_signal')}, v AS (SELECT 'from_a' AS variant, y, p, st FROM alone UNION ALL SELECT 'from_both', y, p, st FROM every)
SELECT variant, CASE WHEN st<4 THEN 'A' ELSE 'B' END AS source, {MET} FROM v GROUP BY 1, 2""")
def _(t):
    d = table(t).withColumn("source", F.when(F.col("st") < 4, "A").otherwise("B"))
    a = ML.oof_many(d, "fold", FOLDS, {"from_a": ML.Variant("linear", SIGNAL, where=F.col("source") == "A"), "from_both": ML.Variant("linear", SIGNAL)}, "y")
    return r6(ML.score_variants(a, "y", ["from_a", "from_both"], ["source"]), "variant", "source", "n")


@query("permutation_importance", "SELECT 'sizes' AS grp, TRUE AS not_negative, TRUE AS matters UNION ALL SELECT 'signal', TRUE, TRUE")
def _(t):
    """Shuffling the signal hurts, and so does shuffling the sizes, which the signal is mixed with."""
    with ML.kept(table(t)) as d:
        m = ML.fit(d.where("fold <> 0"), "boosted", ML.Inputs(NUM), "y", **ROUNDS)
        out = ML.permutation_importance(d, m, {"sizes": ["f_quantity", "f_price"], "signal": ["f_signal"]}, "y", "rid", 8, 1)
        return out.select("grp", (F.col("mae_increase") > -0.01).alias("not_negative"), (F.col("mae_increase") > 0.05).alias("matters"))


RATES = (0.0, 0.1, 0.2, 0.3)


def flipped(seed, rate, kind):
    u = f"(({KEY.format(seed, 'rid')})/4294967296.0::DOUBLE)"
    wrong = f"{u}<{rate}" if kind == "symmetric" else f"(CASE WHEN poor=1 THEN {u}<={rate} ELSE {u}<{rate}/6.0::DOUBLE END)"
    return f"(CASE WHEN {wrong} THEN 1-poor ELSE poor END)"


def noise_sql():
    noisy = ", ".join(f"{flipped(10 + int(e * 100), e, kind)} AS tr{i}_{kind}, {flipped(1, e, kind)} AS te{i}_{kind}" for kind in ("symmetric", "miss") for i, e in enumerate(RATES))
    cells = [(kind, i, j) for kind in ("symmetric", "miss") for i in range(4) for j in range(4)]
    fits = ", ".join(two(f"c_{kind}_{i}_{j}", "f_tax", f"te{j}_{kind}", train=("f_tax", f"tr{i}_{kind}")) for kind, i, j in cells)
    out = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {RATES[i]}::DOUBLE AS train_noise, {RATES[j]}::DOUBLE AS test_noise, count(*) AS n, round(1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2 FROM c_{kind}_{i}_{j}"
                             for kind, i, j in cells)
    return D.replace("d AS (SELECT b.*", f"d AS (SELECT b.*, {noisy}") + f", {fits} {out}"


@query("noise_grid", noise_sql())
def _(t):
    """Four rates of noise in training by four in testing, for both kinds of noise."""
    with ML.kept(table(t)) as d:
        parts = [ML.labelled(ML.noise_grid(d, "fold", FOLDS, ML.Inputs(["f_tax"]), "poor", "y", "rid", RATES, kind, "linear"), kind=kind) for kind in ("symmetric", "miss")]
        return r6(parts[0].unionByName(parts[1]), "kind", "train_noise", "test_noise", "n")


COMPONENTS = [(f"comp_{i:02d}", (i + 1) / 100) for i in range(13)]          # names and weights of the parts of a score


def component(i):
    """A part of the score in terms of the rows, NULL where it was not recorded."""
    return f"CASE WHEN l_linenumber%13<>{i} THEN least(1.0, CAST(y*(0.4+{i}/10.0)+f_tax*{i % 3} AS DOUBLE)) END"


@query("component_predictability", f"""{D.replace("FROM lineitem", ", l_linenumber FROM lineitem")}, """ + ", ".join(
    one(f"v{i}", "f_signal", y=f"({component(i)})", where=f"({component(i)}) IS NOT NULL") for i in range(13)) + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS component, {weight}::DOUBLE AS weight, {MET}, round(avg(CASE WHEN y>=1 THEN 1.0 ELSE 0.0 END),6) AS share_1 FROM (SELECT {component(i)} AS y, p FROM v{i}) q WHERE y IS NOT NULL"
    for i, (name, weight) in enumerate(COMPONENTS)))
def _(t):
    d = SP.group_kfold(t.sql(BASE.replace("FROM lineitem", ", l_linenumber FROM lineitem")), "huc", 5, 0)
    d = d.withColumns({name: F.expr(component(i)).cast("double") for i, (name, _) in enumerate(COMPONENTS)})
    parts = []
    with ML.kept(d) as d:
        for name, weight in COMPONENTS:
            o = ML.oof(d.where(F.col(name).isNotNull()).select("fold", "f_signal", name), "fold", FOLDS, "linear", SIGNAL, name)
            parts.append(cut(ML.labelled(M.regression_by(o, name, "oof", extra=[F.avg((F.col(name) >= 1).cast("double")).alias("share_1")]), component=name, weight=weight)))
    out = parts[0]
    for one_part in parts[1:]:
        out = out.unionByName(one_part)
    return r6(out, "component", "weight", "n")


@query("model_store", f"{D} SELECT fold, count(*) AS n, 0.0::DOUBLE AS max_gap, (SELECT count(*) FROM d WHERE fold=0) AS n_res FROM d GROUP BY fold")
def _(t):
    d = table(t)

    def train():
        m = ML.fit(d.where("fold <> 0"), "linear", IN, "y")
        return m, ML.predict(m, d.where("fold = 0"), "p").select(F.abs(F.col("y") - F.col("p")).alias("res"))
    path = scratch_path(t.spark, "model")
    first, _res = ML.load_or_train(t.spark, path, train)
    again, res = ML.load_or_train(t.spark, path, lambda: (_ for _ in ()).throw(AssertionError("trained twice")))
    both = ML.predict(again, ML.predict(first, d, "a"), "b")
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_gap")).withColumn("n_res", res.agg(F.count("*")).scalar())


@query("batch_score", "SELECT region, count(*) AS n, TRUE AS ordered, TRUE AS in_bounds, 1::BIGINT AS widths FROM px_points GROUP BY region")
def _(t):
    """New points: inventory match and nearest line as inputs, a stored model, prediction with interval."""
    def inputs(p):
        m = P.match_inventory(p, t.px_structs.select("sid", "sx", "sy", "size_m"), "pid", "sid", 250.0)
        line = S.nearest_line(p, t.px_lines, "pid", "lid", 200.0).select("pid", F.col("dist").alias("line_m"))
        return m.join(line, "pid", "left").withColumn("target", (F.col("v") + 1000) / 11000.0)
    known = inputs(t.px_points)
    cols = ML.Inputs(["x", "y", "size_m", "matched", "line_m"])
    with ML.kept(known) as known:
        train, cal = known.where("region <> 0"), known.where("region = 0")
        model = ML.fit(train, "boosted", cols, "target", **ROUNDS)
        res = ML.predict(model, cal, "p").select(F.abs(F.col("target") - F.col("p")).alias("res"))
        out = ML.score_with_interval(model, res, inputs(t.px_points))
        ordered = (F.col("lower") <= F.col("point")) & (F.col("point") <= F.col("upper"))
        return out.groupBy("region").agg(F.count("*").alias("n"), F.bool_and(ordered).alias("ordered"), F.bool_and(F.col("lower").between(0, 1) & F.col("upper").between(0, 1)).alias("in_bounds"),
                                         F.count_distinct("half_width").alias("widths"))


@query("prediction_table", """SELECT basis, count(*) AS n, round(1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2 FROM (SELECT y, p, CASE WHEN huc<30 THEN 'out of fold' ELSE 'held out' END AS basis FROM px_preds) q GROUP BY basis""")
def _(t):
    p = t.px_preds
    both = ML.prediction_table(p.where("huc < 30"), p.where("huc >= 30"), ["rid", "y", "p"])
    return r6(M.regression_by(both, "y", "p", ["basis"]).select("basis", "n", "r2"), "basis", "n")


def half(edges, name):
    return edges.withColumnRenamed("gid", name)


@query("feature_pipeline_multi", f"""WITH {EDGES}, {INSIDE}, {EDGED}, {SEGD},
nr AS (SELECT pid, gid FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, gid) AS rn FROM ed) q WHERE rn=1),
pr AS (SELECT pid, sid, size_m, sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)) AS d FROM px_points, px_structs),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, sid) AS rn FROM pr WHERE d<=250.0) q WHERE rn=1),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d, pid) AS rn FROM pr WHERE d<=250.0) q WHERE rn=1),
mt AS (SELECT b1.* FROM b1 JOIN b2 ON b1.pid=b2.pid AND b1.sid=b2.sid),
wy AS (SELECT * FROM (SELECT pid, lid, d, CASE WHEN lid<30 THEN 'road_bridge' WHEN lid<60 THEN 'road_culvert' ELSE 'stream_culvert' END AS kind, row_number() OVER (PARTITION BY pid, CASE WHEN lid<30 THEN 0 WHEN lid<60 THEN 1 ELSE 2 END ORDER BY d, lid) AS rn FROM sd WHERE d<=200.0) q WHERE rn=1)
SELECT p.pid, ins.gid AS state, lpad(CAST(coalesce(ins.gid,nr.gid) AS VARCHAR),8,'0') AS huc8, substr(lpad(CAST(coalesce(ins.gid,nr.gid) AS VARCHAR),8,'0'),1,6) AS huc6, round(log10(greatest(v,1.0)),6) AS log_v,
 mt.size_m, round(mt.d,6) AS nbi_dist_m, CASE WHEN mt.sid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS nbi_matched,
 (SELECT round(d,6) FROM wy WHERE wy.pid=p.pid AND kind='road_bridge') AS osm_road_bridge_dist_m, CASE WHEN EXISTS (SELECT 1 FROM wy WHERE wy.pid=p.pid AND kind='stream_culvert') THEN 1.0 ELSE 0.0 END::DOUBLE AS osm_stream_culvert_flag,
 CAST((SELECT 3 FROM wy WHERE wy.pid=p.pid AND kind='road_bridge') AS INT) AS osm_bridge_hw_rank
FROM px_points p LEFT JOIN ins ON ins.pid=p.pid JOIN nr ON nr.pid=p.pid LEFT JOIN mt ON mt.pid=p.pid""")
def _(t):
    e = S.boxes_to_edges(t.px_polys, "gid")
    basins = e.withColumn("huc8", F.lpad(F.col("gid").cast("string"), 8, "0")).drop("gid")
    kind = F.when(F.col("lid") < 30, "road_bridge").when(F.col("lid") < 60, "road_culvert").otherwise("stream_culvert")
    tags = {"highway": "primary", "lanes": "2 lanes", "maxspeed": "30 mph", "layer": "1", "bridge": "yes", "structure": "box_culvert"}
    ways = t.px_lines.withColumn("kind", kind).withColumns({k: F.lit(v) for k, v in tags.items()}).withColumn("named", F.lit(1.0))
    out = FE.build_multi(t.px_points, "pid", half(e, "state"), basins, t.px_structs.select("sid", "sx", "sy", "size_m"), "sid", 250.0, 1000.0, ["v"], (ways, "lid", 200.0))
    return out.select("pid", "state", "huc8", "huc6", F.round("log_v", 6).alias("log_v"), "size_m", F.round("nbi_dist_m", 6).alias("nbi_dist_m"), "nbi_matched",
                      F.round("osm_road_bridge_dist_m", 6).alias("osm_road_bridge_dist_m"), "osm_stream_culvert_flag", "osm_bridge_hw_rank")


@query("feature_pipeline_single", f"""WITH {INSIDE}, {SEGD},
dr AS (SELECT p_partkey AS pid, p_size AS comid, CASE WHEN p_size%4=0 THEN NULL ELSE p_retailprice/100-9 END AS da FROM part), sc AS (SELECT s_suppkey AS comid, abs(s_acctbal)/100 AS area, s_acctbal AS precip FROM supplier),
rd AS (SELECT * FROM (SELECT pid, lid, row_number() OVER (PARTITION BY pid ORDER BY d, lid) AS rn FROM sd WHERE d<=75.0) q WHERE rn=1),
ad AS (SELECT * FROM (SELECT pid, lid, row_number() OVER (PARTITION BY pid ORDER BY d, lid) AS rn FROM sd WHERE d<=200.0) q WHERE rn=1),
st AS (SELECT * FROM (SELECT pid, sid, size_m, row_number() OVER (PARTITION BY pid ORDER BY sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)), sid) AS rn FROM px_points, px_structs WHERE sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy))<=100.0) q WHERE rn=1),
f AS (SELECT p.pid, n_regionkey AS county_income, coalesce(dr.da, sc.area) AS da, sc.precip, CASE WHEN rd.lid IS NULL THEN 'unknown' WHEN rd.lid<50 THEN 'unpaved' ELSE 'paved' END AS road_class, CAST(ad.lid*100 AS DOUBLE) AS aadt,
 coalesce(CAST(ins.gid AS VARCHAR),'unknown') AS ecoregion, CASE WHEN st.sid IS NULL THEN 'none' WHEN st.size_m>25 THEN 'bridge' ELSE 'culvert' END AS kind, st.size_m, CASE WHEN g.val<>0 THEN g.val/1000 END AS precip_in
 FROM px_points p JOIN nation ON n_nationkey=p.grp LEFT JOIN dr ON dr.pid=p.pid LEFT JOIN sc ON sc.comid=dr.comid LEFT JOIN rd ON rd.pid=p.pid LEFT JOIN ad ON ad.pid=p.pid LEFT JOIN ins ON ins.pid=p.pid LEFT JOIN st ON st.pid=p.pid
 LEFT JOIN px_grid g ON col_i=CAST(floor(x/400.0) AS INT) AND row_i=CAST(floor((20000-y)/400.0) AS INT))
SELECT pid, county_income, round(da,6) AS drainage_area_km2, CASE WHEN da IS NOT NULL THEN round(log10(greatest(da,0.001)),6) END AS log_drainage_area, precip AS sc_precip_mm, road_class, aadt, ecoregion, kind AS structure_is_bridge,
 CAST(CASE WHEN kind<>'none' THEN 2026-(1900+size_m) END AS INT) AS structure_age_yr, CASE WHEN da IS NOT NULL THEN round(CASE kind WHEN 'bridge' THEN size_m*0.3048::DOUBLE WHEN 'culvert' THEN size_m*0.1524::DOUBLE END/(16.9::DOUBLE*power(greatest(da*0.3861021585::DOUBLE,0.01),0.401)*0.3048),6) END AS constriction_ratio,
 round(precip_in,6)::DOUBLE AS precip_24h_10yr_in FROM f""")
def _(t):
    county = t.nation.select(F.upper("n_name").alias("county_name"), F.col("n_regionkey").alias("county_income"))
    p = t.px_points.join(t.nation.select(F.col("n_nationkey").alias("grp"), F.concat("n_name", F.lit(" County")).alias("County")), "grp")
    p = p.withColumn("region_name", F.lit(None).cast("string"))
    drain = t.part.select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("bigint").alias("comid"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") / 100 - 9).alias("drainage_area_km2"))
    sc = FE.catchment_features(t.supplier.select(F.col("s_suppkey").alias("comid"), (F.abs("s_acctbal") / 100).alias("wsareasqkm"), F.col("s_acctbal").alias("precip8110ws")), "comid")
    sc = sc.select("comid", "sc_watershed_area_km2", "sc_precip_mm")
    surface = F.when(F.col("lid") < 50, "gravel")
    ways = t.px_lines.withColumns({"highway": F.lit("tertiary"), "railway": F.lit(None).cast("string"), "surface": surface, "service": F.lit(None).cast("string"), "lanes": F.lit("2"), "volume": (F.col("lid") * 100).cast("double")})
    size = F.col("size_m")
    structs = t.px_structs.select("sid", "sx", "sy", (size + 1900).alias("year_built"), size.alias("condition"), size.alias("length_ft"), (size / F.lit(2.0)).alias("width_ft"), (size > 25).alias("is_bridge"), F.concat(F.lit("40 - "), "kind").alias("type"))
    steps = {"county": FE.attach_county(county, "County", "county_name"), "drainage": FE.attach_lookup(drain, "pid", ["comid"]),
             "streamcat": lambda d: d.transform(FE.attach_lookup(sc, "comid")).transform(FE.backfill_drainage()), "log": FE.attach_drainage_log(),
             "road": FE.attach_road_class(ways, "pid", "lid"), "traffic": FE.attach_traffic(ways, "pid", "lid", "volume"),
             "ecoregion": FE.attach_ecoregion(S.boxes_to_edges(t.px_polys, "gid"), "pid", "gid", 1000.0), "structures": FE.attach_structures(structs, "pid", "sid"),
             "constriction": FE.attach_constriction(), "precipitation": FE.attach_precipitation({"precip_24h_10yr_in": t.px_grid}, 0.0, 0.0, 400.0, 50, 0.0)}
    out = FE.build_predictor_table(p, steps, list(steps))
    return out.select("pid", "county_income", F.round("drainage_area_km2", 6).alias("drainage_area_km2"), F.round("log_drainage_area", 6).alias("log_drainage_area"), "sc_precip_mm", "road_class", "aadt", "ecoregion",
                      "structure_is_bridge", "structure_age_yr", F.round("constriction_ratio", 6).alias("constriction_ratio"), F.round("precip_24h_10yr_in", 6).alias("precip_24h_10yr_in"))


@query("train_test_hook", f"""{D.replace("ks AS (", "tm AS (SELECT k, flag, avg(y) AS fm FROM d JOIN (SELECT DISTINCT fold AS k FROM f) q ON fold<>k GROUP BY k, flag), ks AS (")},
tf AS (SELECT tm.k, regr_slope(y, fm) AS b, regr_intercept(y, fm) AS a FROM d JOIN tm ON tm.flag=d.flag AND d.fold<>tm.k GROUP BY tm.k),
v AS (SELECT d.fold, d.y, a+b*fm AS p FROM d JOIN tm ON tm.flag=d.flag AND tm.k=d.fold JOIN tf ON tf.k=d.fold) SELECT fold, {MET} FROM v GROUP BY fold""")
def _(t):
    """A hook that adds the training mean of the target per category; test rows only ever see training means."""
    def hook(train, test):
        means = train.groupBy("flag").agg(F.avg("y").alias("flag_mean"))
        return train.join(means, "flag"), test.join(means, "flag", "left")
    with ML.kept(table(t)) as d:
        return r6(M.regression_by(ML.oof(d, "fold", FOLDS, "linear", ML.Inputs([], (), ("flag_mean",)), "y", prep=hook), "y", "oof", ["fold"]), "fold", "n")
