"""Queries of linear models from sufficient statistics; the twins fit and predict row by row in closed form."""
from rillmap.catalog.base import query
from rillmap.catalog.modelling import D, one, table, two
from rillmap.plans import linear as LI
from pyspark.sql import functions as F

PAIR = ["f_price", "f_signal"]
#: mean squared errors on the inner folds j of every outer fold k, for ridges of two standardised inputs
RIDGES = f"""{D}, pairs AS (SELECT a.k, b.k AS j FROM ks a JOIN ks b ON a.k<>b.k), pens AS (SELECT pow(10.0, -3.0+6.0*i/24.0) AS penalty FROM range(25) q(i)),
st AS (SELECT k, j, count(*) AS n, avg(f_price) AS m1, avg(f_signal) AS m2, avg(y) AS my, var_pop(f_price) AS v1, var_pop(f_signal) AS v2, covar_pop(f_price,f_signal) AS c,
 covar_pop(f_price,y) AS c1, covar_pop(f_signal,y) AS c2 FROM d JOIN (SELECT * FROM pairs UNION ALL SELECT k, NULL FROM ks) p ON fold<>k AND fold IS DISTINCT FROM j GROUP BY k, j),
sd AS (SELECT *, 1+penalty/n AS g, c/sqrt(v1*v2) AS r, c1/sqrt(v1) AS q1, c2/sqrt(v2) AS q2 FROM st, pens),
wt AS (SELECT *, (g*q1-r*q2)/(g*g-r*r)/sqrt(v1) AS b1, (g*q2-r*q1)/(g*g-r*r)/sqrt(v2) AS b2 FROM sd),
er AS (SELECT k, penalty, avg(pow(y-my-b1*(f_price-m1)-b2*(f_signal-m2), 2)) AS mse FROM d JOIN wt ON fold=j GROUP BY k, penalty),
ch AS (SELECT *, penalty=max(CASE WHEN mse<=least_mse*(1+1e-9) THEN penalty END) OVER (PARTITION BY k) AS chosen FROM (SELECT *, min(mse) OVER (PARTITION BY k) AS least_mse FROM er) q)"""


@query("penalty_paths", f"""{RIDGES} SELECT CAST(k AS VARCHAR) AS fold, round(penalty,6) AS penalty, round(mse,6) AS mse, chosen FROM ch""")
def _(t):
    """Inner errors of 25 ridge penalties for every held-out fold, from one scan."""
    parts = LI.moments(table(t), PAIR, "y", "fold")
    found = LI.path_table(t.spark, LI.penalty_paths(parts, ["ridge"]))
    return found.select("fold", F.round("penalty", 6).alias("penalty"), F.round("mse", 6).alias("mse"), "chosen")


@query("penalised_ladder", f"""{RIDGES}, rp AS (SELECT y, fold, my+b1*(f_price-m1)+b2*(f_signal-m2) AS p FROM d JOIN wt ON wt.k=fold AND wt.j IS NULL JOIN ch ON ch.k=wt.k AND ch.penalty=wt.penalty AND ch.chosen),
{two('lp', 'f_price', 'f_signal')},
sh AS (SELECT unnest([0.1, 0.5, 0.9, 1.0]) AS share),
ns AS (SELECT k, j, m2, my, v2, c2/sqrt(v2) AS q FROM st),
nt AS (SELECT k, share, pow(0.001, i/49.0)*abs(q)/share AS a FROM ns, sh, range(50) z(i) WHERE j IS NULL),
nw AS (SELECT ns.*, share, a, sign(q)*greatest(abs(q)-a*share,0)/(1+a*(1-share))/sqrt(v2) AS b FROM ns JOIN nt USING (k)),
ne AS (SELECT k, share, a, avg(pow(y-my-b*(f_signal-m2), 2)) AS mse FROM d JOIN nw ON fold=j GROUP BY ALL),
nm AS (SELECT *, min(mse) OVER (PARTITION BY k) AS least_mse FROM ne),
nc AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a DESC, share DESC) AS i FROM nm WHERE mse<=least_mse*(1+1e-9)),
np AS (SELECT y, my+b*(f_signal-m2) AS p FROM d JOIN nw ON nw.k=fold AND nw.j IS NULL JOIN nc ON nc.k=nw.k AND nc.i=1 AND nc.share=nw.share AND nc.a=nw.a),
al AS (SELECT 'linear' AS variant, y, p FROM lp UNION ALL SELECT 'ridge', y, p FROM rp UNION ALL SELECT 'elasticnet', y, p FROM np)
SELECT variant, count(*) AS n, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2, round(avg(p-y),6)+0.0 AS bias FROM al GROUP BY variant""")
def _(t):
    """Least squares and a ridge of chosen penalty on two inputs, an elastic net of chosen penalty and share on one; errors from moments, no row is predicted."""
    d = table(t)
    parts = LI.moments(d, PAIR, "y", "fold")
    single = {k: m.of([1]) for k, m in parts.items()}
    rows = LI.score(parts, LI.chosen_models(LI.penalty_paths(parts, ["linear", "ridge"])), ["linear", "ridge"])
    rows += LI.score(single, LI.chosen_models(LI.penalty_paths(single, ["elasticnet"])), ["elasticnet"])
    out = t.spark.createDataFrame(rows, "variant string, n bigint, rmse double, r2 double, bias double")
    return out.select("variant", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("rmse", "r2", "bias")])


@query("moment_selection", f"""{D}, {one('price', 'f_price')}, {one('signal', 'f_signal')}, {one('tax', 'f_tax')}, {two('ps', 'f_price', 'f_signal')}, {two('st2', 'f_signal', 'f_tax')}, {two('pt', 'f_price', 'f_tax')},
al AS (SELECT 'price' AS inputs, y, p FROM price UNION ALL SELECT 'signal', y, p FROM signal UNION ALL SELECT 'tax', y, p FROM tax UNION ALL SELECT 'price+signal', y, p FROM ps
 UNION ALL SELECT 'signal+tax', y, p FROM st2 UNION ALL SELECT 'price+tax', y, p FROM pt)
SELECT inputs, round(1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2 FROM al GROUP BY inputs""")
def _(t):
    """Held-out R2 of six input sets from the one scan that all of them share."""
    columns = ["f_price", "f_signal", "f_tax"]
    sets = {"+".join(c[2:] for c in s): s for s in ([c] for c in columns)} | {"price+signal": columns[:2], "signal+tax": columns[1:], "price+tax": [columns[0], columns[2]]}
    found = LI.ablate(LI.moments(table(t), columns, "y", "fold"), columns, sets)
    return t.spark.createDataFrame([(k, float(v)) for k, v in found.items()], "inputs string, r2 double").select("inputs", F.round("r2", 6).alias("r2"))


@query("moment_predictions", f"""{D}, {two('ps', 'f_price', 'f_signal')} SELECT fold, count(*) AS n, round(avg(p),6) AS mean_p, round(avg(abs(p-y)),6) AS mae FROM ps GROUP BY fold""")
def _(t):
    """Predictions of every row by the least-squares model that has not seen its fold."""
    d = table(t)
    rest = LI.without_each(LI.moments(d, PAIR, "y", "fold"))
    out = LI.predict_folds(d, PAIR, "fold", {k: LI.ridge_path(m, [0.0])[0] for k, m in rest.items()}, "p")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"))
