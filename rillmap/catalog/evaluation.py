"""Queries for metrics, ranks, windows, samples, splits, resampling and intervals."""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.operators import metrics as M
from rillmap.operators import ranking as R
from rillmap.operators import splits as SP


def r(c, n=6):
    return F.round(c, n)


def rounded(df, *keep, n=6):
    return df.select(*[c if c in keep else r(c, n).alias(c) for c in df.columns])


KEY = "('0x'||substr(md5('{0}:'||{1}),1,8))::BIGINT"
MET = """count(*) AS n, round(avg(abs(p-y)),6) AS mae, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)),6) AS r2,
round(avg(p-y),6) AS bias, round(stddev_pop(p)/stddev_pop(y),6) AS pred_sd_ratio"""
SPEAR = """SELECT corr(ra, rb) AS c FROM (SELECT rank() OVER (ORDER BY {a})+(count(*) OVER (PARTITION BY {a})-1)/2.0::DOUBLE AS ra,
rank() OVER (ORDER BY {b})+(count(*) OVER (PARTITION BY {b})-1)/2.0::DOUBLE AS rb FROM {t}) q"""


@query("regression_metrics", f"SELECT {MET} FROM px_preds")
def _(t):
    return rounded(M.regression_by(t.px_preds, "y", "p"), "n")


@query("metrics_by_group", f"SELECT st, {MET} FROM px_preds GROUP BY st HAVING count(*)>=100")
def _(t):
    return rounded(M.regression_by(t.px_preds, "y", "p", ["st"], 100), "st", "n")


@query("spearman", f"SELECT count(*) AS n, round(({SPEAR.format(a='y', b='p', t='px_preds')}),6) AS spearman FROM px_preds")
def _(t):
    return rounded(M.spearman(t.px_preds, "y", "p"), "n")


@query("tail_mae", """WITH q AS (SELECT quantile_cont(y,0.15) AS a, quantile_cont(y,0.85) AS b FROM px_preds)
SELECT round(avg(CASE WHEN y<=a THEN abs(p-y) END),6) AS mae_low_tail, round(avg(CASE WHEN y>=b THEN abs(p-y) END),6) AS mae_high_tail FROM px_preds, q""")
def _(t):
    return rounded(M.tail_mae(t.px_preds, "y", "p"))


DEC = ",".join(f"quantile_cont(p,{i / 10})" for i in range(1, 10))


@query("calibration_table", f"""WITH e AS (SELECT list_distinct([{DEC}]) AS q, min(p) AS mn FROM px_preds), b AS (SELECT y, p, len(list_filter(q, lambda z: z<p AND z>mn)) AS bin FROM px_preds, e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p),6) AS pred_mean, round(avg(y),6) AS obs_mean, round(avg(y)-avg(p),6) AS gap FROM b GROUP BY 1""")
def _(t):
    return rounded(M.calibration_table(t.px_preds, "y", "p"), "bin", "n")


@query("bin_histogram", "SELECT lo, hi, count(*) AS n FROM lineitem JOIN (VALUES (0::DOUBLE,1::DOUBLE),(1,5),(5,10),(10,25),(25,40)) e(lo,hi) ON l_quantity>lo AND l_quantity<=hi GROUP BY lo, hi")
def _(t):
    return M.bin_counts(t.lineitem, "l_quantity", [0, 1, 5, 10, 25, 40])


@query("crosstab_overlap", "SELECT round(CAST(sum(top) AS DOUBLE)/CAST(sum(n) AS DOUBLE),6) AS overlap, CAST(sum(n) AS BIGINT) AS n FROM (SELECT st, max(n) AS top, sum(n) AS n FROM (SELECT st, l_linenumber, count(*) AS n FROM px_preds GROUP BY 1,2) a GROUP BY st) b")
def _(t):
    return rounded(M.crosstab_overlap(t.px_preds, "st", "l_linenumber"), "n")


PRIO = """a AS (SELECT rid, row_number() OVER (ORDER BY {x}, rid) AS ra, row_number() OVER (ORDER BY {y}, rid) AS rb, CAST(floor(count(*) OVER ()*0.2) AS BIGINT) AS k FROM px_preds)"""


@query("priority_overlap", f"""WITH {PRIO.format(x='p', y='p0')} SELECT max(k) AS k, round(count(CASE WHEN ra<=k AND rb<=k THEN 1 END)/count(CASE WHEN ra<=k OR rb<=k THEN 1 END)::DOUBLE,6) AS jaccard,
max(k)-count(CASE WHEN ra<=k AND rb<=k THEN 1 END) AS changed, round(({SPEAR.format(a='p', b='p0', t='px_preds')}),6) AS spearman FROM a""")
def _(t):
    return rounded(M.priority_overlap(t.px_preds, "p", "p0", "rid"), "k", "changed")


@query("capture_at_share", """WITH a AS (SELECT CASE WHEN y<0.3 THEN 1 ELSE 0 END AS lab, row_number() OVER (ORDER BY 1-p DESC, rid) AS rn, count(*) OVER () AS n FROM px_preds)
SELECT round(sum(CASE WHEN rn<=round(n*0.1) THEN lab END)::DOUBLE/sum(lab),6) AS caught_10, round(sum(CASE WHEN rn<=round(n*0.2) THEN lab END)::DOUBLE/sum(lab),6) AS caught_20 FROM a""")
def _(t):
    d = t.px_preds.select("rid", (F.col("y") < 0.3).cast("int").alias("lab"), (1 - F.col("p")).alias("risk"))
    return rounded(M.capture_at(d, "lab", "risk", "rid"))


LAB = "lab AS (SELECT CASE WHEN y<0.3 THEN 1 ELSE 0 END AS lab, 1-p AS risk FROM px_preds)"


@query("roc_auc", f"""WITH {LAB}, k AS (SELECT lab, rank() OVER (ORDER BY risk)+(count(*) OVER (PARTITION BY risk)-1)/2.0::DOUBLE AS rk FROM lab)
SELECT round((sum(CASE WHEN lab=1 THEN rk END)-sum(lab)*(sum(lab)+1)/2.0::DOUBLE)/(sum(lab)::DOUBLE*(count(*)-sum(lab))),6)::DOUBLE AS auc FROM k""")
def _(t):
    return rounded(M.roc_auc(t.px_preds.select((F.col("y") < 0.3).cast("int").alias("lab"), (1 - F.col("p")).alias("risk")), "lab", "risk"))


@query("average_precision", f"""WITH {LAB}, g AS (SELECT risk, count(*) AS n, sum(lab) AS pos FROM lab GROUP BY risk),
c AS (SELECT pos, sum(pos) OVER (ORDER BY risk DESC) AS pu, sum(n) OVER (ORDER BY risk DESC) AS nu FROM g)
SELECT round(sum(pos::DOUBLE*pu::DOUBLE/nu::DOUBLE)/sum(pos)::DOUBLE,6) AS ap FROM c""")
def _(t):
    return rounded(M.average_precision(t.px_preds.select((F.col("y") < 0.3).cast("int").alias("lab"), (1 - F.col("p")).alias("risk")), "lab", "risk"))


@query("interval_coverage", "SELECT st, round(avg(CASE WHEN y BETWEEN p-0.2 AND p+0.15 THEN 1.0 ELSE 0.0 END),6) AS coverage, round(avg((p+0.15)-(p-0.2)),6) AS mean_width FROM px_preds GROUP BY st")
def _(t):
    d = t.px_preds.withColumn("lo", F.col("p") - 0.2).withColumn("hi", F.col("p") + 0.15)
    return rounded(M.interval_coverage(d, "y", "lo", "hi", ["st"]), "st")


@query("calibration_slope", "SELECT round(regr_slope(y,p),6) AS slope, count(*) AS n FROM px_preds")
def _(t):
    return rounded(M.calibration_slope(t.px_preds, "y", "p"), "n")


@query("feature_label_corr", """SELECT * FROM (SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity,l_discount)),6) AS abs_corr FROM lineitem UNION ALL SELECT 'l_extendedprice', round(abs(corr(l_extendedprice,l_discount)),6) FROM lineitem
UNION ALL SELECT 'l_tax', round(abs(corr(l_tax,l_discount)),6) FROM lineitem UNION ALL SELECT 'l_linenumber', round(abs(corr(l_linenumber,l_discount)),6) FROM lineitem) q ORDER BY abs_corr DESC LIMIT 3""")
def _(t):
    return rounded(M.feature_label_corr(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber"], "l_discount", 3), "feature")


RUNS = "runs AS (SELECT st, l_linenumber AS run, 1-sum((p-y)*(p-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS r2, 1-sum((p0-y)*(p0-y))/(sum(y*y)-sum(y)*sum(y)/count(*)) AS r0 FROM px_preds GROUP BY 1,2)"


def runs(t):
    a = M.regression_by(t.px_preds, "y", "p", ["st", "l_linenumber"]).select("st", F.col("l_linenumber").alias("run"), "r2", F.lit("p").alias("variant"))
    b = M.regression_by(t.px_preds, "y", "p0", ["st", "l_linenumber"]).select("st", F.col("l_linenumber").alias("run"), "r2", F.lit("p0").alias("variant"))
    return a.unionByName(b)


@query("summarise_runs", f"WITH {RUNS} SELECT st, count(*) AS n_runs, round(avg(r2),6) AS mean, round(stddev_pop(r2),6) AS sd_pop, round(stddev_samp(r2),6) AS sd_samp FROM runs GROUP BY st")
def _(t):
    return rounded(M.summarise_runs(runs(t).where("variant='p'"), "r2", ["st"]), "st", "n_runs")


@query("paired_gain", f"WITH {RUNS} SELECT st, count(*) AS n_runs, round(avg(r2-r0),6) AS mean_gain, round(stddev_samp(r2-r0),6) AS sd_gain, count(CASE WHEN r2>r0 THEN 1 END) AS wins FROM runs GROUP BY st")
def _(t):
    return rounded(M.paired_gain(runs(t), "run", "variant", "r2", "p0", "p", ["st"]), "st", "n_runs", "wins")


@query("within_tolerance", "SELECT count(*) AS n, round(avg(CASE WHEN abs(p-y)<=0.05+1e-9 THEN 1.0 ELSE 0.0 END),6) AS within_005, round(avg(CASE WHEN abs(p-y)<=0.1+1e-9 THEN 1.0 ELSE 0.0 END),6) AS within_010, round(avg(CASE WHEN abs(p-y)<=0.2+1e-9 THEN 1.0 ELSE 0.0 END),6) AS within_020 FROM px_preds")
def _(t):
    return rounded(M.within_tolerance(t.px_preds, "y", "p"), "n")


@query("invariant_checks", """SELECT * FROM (SELECT 'row ids are unique' AS "check", CASE WHEN count(*)=count(DISTINCT rid) THEN 'PASS' ELSE 'FAIL' END AS result FROM px_preds UNION ALL
SELECT 'truth in [0, 1]', CASE WHEN min(y)>=0 AND max(y)<=1 THEN 'PASS' ELSE 'FAIL' END FROM px_preds UNION ALL SELECT 'all orders known', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))=0 THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'one priority per customer', CASE WHEN (SELECT max(k) FROM (SELECT count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY o_custkey) q)=1 THEN 'PASS' ELSE 'FAIL' END) z""")
def _(t):
    per_id = t.px_preds.groupBy("rid").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"))
    lost = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n"))
    both = t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b")).agg(F.bool_and(F.col("a") == F.col("b")).alias("ok"))
    return M.invariant_report([("row ids are unique", per_id, F.col("top") == 1),
                               ("truth in [0, 1]", t.px_preds.agg(F.min("y").alias("a"), F.max("y").alias("b")), (F.col("a") >= 0) & (F.col("b") <= 1)),
                               ("all orders known", lost, F.col("n") == 0), ("one priority per customer", both, F.col("ok"))])


@query("source_agreement", """WITH a AS (SELECT p_partkey AS k, p_type AS kind, p_size>20 AS f FROM part WHERE p_size<45), b AS (SELECT p_partkey AS k, p_retailprice>1000 AS f FROM part WHERE p_size>5)
SELECT kind, count(a.f) AS n_a, count(b.f) AS n_b, round(avg(CASE WHEN a.f THEN 1.0 WHEN NOT a.f THEN 0.0 END),6) AS share_a, round(avg(CASE WHEN b.f THEN 1.0 WHEN NOT b.f THEN 0.0 END),6) AS share_b,
round(avg(CASE WHEN a.f=b.f THEN 1.0 WHEN a.f<>b.f THEN 0.0 END),6) AS agree FROM a FULL JOIN b USING (k) GROUP BY kind""")
def _(t):
    a = t.part.where("p_size < 45").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("kind"), (F.col("p_size") > 20).alias("f"))
    b = t.part.where("p_size > 5").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") > 1000).alias("f"))
    return rounded(M.source_agreement(a, b, "k", "f", "kind"), "kind", "n_a", "n_b")


# ---- windows and ranks

@query("dedupe_keep_best", "SELECT code, pipe, score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY drop_ft, pipe, l_partkey, l_suppkey) AS rn FROM px_surveys) q WHERE rn=1")
def _(t):
    return R.keep_best(t.px_surveys, ["code"], ["drop_ft", "pipe", "l_partkey", "l_suppkey"]).select("code", "pipe", "score")


@query("stratified_prefix_sample", f"SELECT rid, huc FROM (SELECT rid, huc, row_number() OVER (PARTITION BY huc ORDER BY {KEY.format(5, 'rid')}, rid) AS rn FROM px_preds) q WHERE rn<=100")
def _(t):
    return SP.stratified_prefix(t.px_preds.select("rid", "huc"), "huc", "rid", 100, 5)


@query("average_rank", "SELECT rid, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS mid_rank FROM px_preds")
def _(t):
    return R.average_rank(t.px_preds, "p").select("rid", F.col("mid_rank").cast("double").alias("mid_rank"))


@query("group_size_weight", "SELECT huc, count(*) AS n, round(max(w),8) AS w FROM (SELECT huc, 1/power(count(*) OVER (PARTITION BY huc),0.5) AS w FROM px_preds) q GROUP BY huc")
def _(t):
    return SP.group_size_weight(t.px_preds, "huc", 0.5).groupBy("huc").agg(F.count("*").alias("n"), r(F.max("weight"), 8).alias("w"))


@query("permute_within_group", f"""WITH a AS (SELECT rid, st, row_number() OVER (PARTITION BY st ORDER BY rid) AS i FROM px_preds), b AS (SELECT st, p, row_number() OVER (PARTITION BY st ORDER BY {KEY.format(9, 'rid')}, rid) AS i FROM px_preds)
SELECT rid, a.st, p FROM a JOIN b ON a.st=b.st AND a.i=b.i""")
def _(t):
    return R.permute(t.px_preds.select("rid", "st", "p"), "p", ["rid"], 9, ["st"])


@query("permute_pairs", f"""WITH a AS (SELECT rid, y, row_number() OVER (ORDER BY rid) AS i FROM px_preds), b AS (SELECT p, row_number() OVER (ORDER BY {KEY.format(10, 'rid')}, rid) AS i FROM px_preds)
SELECT count(*) AS n, round(corr(y,p),6) AS baseline FROM a JOIN b USING (i)""")
def _(t):
    return R.permute(t.px_preds.select("rid", "y", "p"), "p", ["rid"], 10).agg(F.count("*").alias("n"), r(F.corr("y", "p")).alias("baseline"))


@query("quantile_higher", "SELECT e AS q FROM (SELECT abs(y-p) AS e, row_number() OVER (ORDER BY abs(y-p)) AS rn, count(*) OVER () AS n FROM px_preds) z WHERE rn=ceil(0.9*(n-1))+1")
def _(t):
    e = t.px_preds.select(F.abs(F.col("y") - F.col("p")).alias("e"))
    total = e.agg(F.ceil(F.lit(0.9) * (F.count("*") - 1)) + 1).scalar()
    return R.quantile_higher(e, "e", total)


# ---- sorts, limits, samples

@query("top_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 30")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_suppkey").limit(30)


@query("bottom_k", "SELECT rid, p FROM px_preds ORDER BY p, rid LIMIT 100")
def _(t):
    return t.px_preds.select("rid", "p").orderBy("p", "rid").limit(100)


@query("rank_by_risk", "SELECT rid, row_number() OVER (ORDER BY 1-p DESC, rid) AS rn FROM px_preds")
def _(t):
    return R.with_rank(t.px_preds.select("rid", (1 - F.col("p")).alias("risk")), [F.col("risk").desc(), "rid"]).select("rid", "rn")


@query("random_sample_n", f"SELECT rid, p FROM px_preds ORDER BY {KEY.format(3, 'rid')}, rid LIMIT 500")
def _(t):
    return SP.sample_n(t.px_preds.select("rid", "p"), "rid", 500, 3)


@query("sorted_report", f"SELECT st, {MET} FROM px_preds GROUP BY st ORDER BY r2 DESC")
def _(t):
    return rounded(M.regression_by(t.px_preds, "y", "p", ["st"]), "st", "n").orderBy(F.col("r2").desc(), "st")


# ---- splits

@query("random_kfold", f"SELECT rid, CAST((row_number() OVER (ORDER BY {KEY.format(1, 'rid')}, rid)-1)%5 AS INT) AS fold FROM px_preds")
def _(t):
    return SP.random_kfold(t.px_preds.select("rid"), "rid", 5, 1)


def greedy(order, k=5):
    loads = "[" + ",".join(["0::BIGINT"] * k) + "]"
    return f"""g AS (SELECT huc, count(*) AS n FROM px_preds GROUP BY huc), o AS (SELECT huc, n, row_number() OVER (ORDER BY {order}) AS i FROM g),
w AS (SELECT 0::BIGINT AS i, NULL::INT AS huc, NULL::BIGINT AS fold, {loads} AS load UNION ALL
 SELECT o.i, o.huc, list_position(load, list_min(load))-1, list_transform(load, lambda x, j: CASE WHEN j=list_position(load, list_min(load)) THEN x+o.n ELSE x END) FROM w JOIN o ON o.i=w.i+1),
f AS (SELECT huc, CAST(fold AS INT) AS fold FROM w WHERE i>0)"""


@query("group_kfold_random", f"WITH RECURSIVE {greedy(KEY.format(0, 'huc') + ', huc::VARCHAR')} SELECT fold, huc, count(*) AS n FROM px_preds JOIN f USING (huc) GROUP BY 1,2")
def _(t):
    return SP.group_kfold(t.px_preds, "huc", 5, 0).groupBy("fold", "huc").agg(F.count("*").alias("n"))


@query("group_kfold_sized", f"WITH RECURSIVE {greedy('n DESC, ' + KEY.format(0, 'huc') + ', huc::VARCHAR')} SELECT fold, huc, count(*) AS n FROM px_preds JOIN f USING (huc) GROUP BY 1,2")
def _(t):
    return SP.group_kfold(t.px_preds, "huc", 5, 0, True).groupBy("fold", "huc").agg(F.count("*").alias("n"))


@query("repeated_group_kfold", f"""WITH RECURSIVE g AS (SELECT huc, count(*) AS n FROM px_preds GROUP BY huc),
o AS (SELECT r, huc, n, row_number() OVER (PARTITION BY r ORDER BY n DESC, ('0x'||substr(md5(r||':'||huc),1,8))::BIGINT, huc::VARCHAR) AS i FROM g, (VALUES (0),(1),(2)) v(r)),
w AS (SELECT r, 0::BIGINT AS i, NULL::INT AS huc, NULL::BIGINT AS fold, [{",".join(["0::BIGINT"] * 5)}] AS load FROM (VALUES (0),(1),(2)) v(r) UNION ALL
 SELECT o.r, o.i, o.huc, list_position(load, list_min(load))-1, list_transform(load, lambda x, j: CASE WHEN j=list_position(load, list_min(load)) THEN x+o.n ELSE x END) FROM w JOIN o ON o.r=w.r AND o.i=w.i+1)
SELECT r AS repeat, CAST(fold AS INT) AS fold, count(*) AS n, count(DISTINCT w.huc) AS groups FROM w JOIN px_preds p ON p.huc=w.huc WHERE i>0 GROUP BY 1,2""")
def _(t):
    folds = SP.repeated_group_kfold(t.px_preds, "huc", 5, 3)
    sizes = t.px_preds.groupBy("huc").agg(F.count("*").alias("_n"))      # rows meet the folds as counts of their groups
    return sizes.join(folds, "huc").groupBy("repeat", "fold").agg(F.sum("_n").alias("n"), F.count("huc").alias("groups"))


@query("leave_one_group_out", "SELECT huc, count(*) AS n_test, (SELECT count(*) FROM px_preds)-count(*) AS n_train FROM px_preds GROUP BY huc HAVING count(*)>=1480")
def _(t):
    return SP.leave_one_out_groups(t.px_preds, "huc", 1480)


@query("locked_group_holdout", f"""WITH RECURSIVE d AS (SELECT l_partkey%97 AS basin, st FROM px_preds), c AS (SELECT basin, count(*) AS n FROM d GROUP BY basin),
o AS (SELECT basin, n, row_number() OVER (ORDER BY {KEY.format(20, 'basin')}, basin::VARCHAR) AS i FROM c WHERE n>=20),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS basin, 0::BIGINT AS acc, false AS took UNION ALL
 SELECT o.i, o.basin, CASE WHEN acc<0.15*(SELECT count(*) FROM d) AND acc+o.n<=0.19*(SELECT count(*) FROM d) THEN acc+o.n ELSE acc END, acc<0.15*(SELECT count(*) FROM d) AND acc+o.n<=0.19*(SELECT count(*) FROM d) FROM w JOIN o ON o.i=w.i+1),
k AS (SELECT basin FROM w WHERE took)
SELECT basin IN (SELECT basin FROM k) AS locked, count(*) AS n, count(DISTINCT basin) AS groups, count(DISTINCT st) AS regions FROM d GROUP BY 1""")
def _(t):
    d = SP.locked_holdout(t.px_preds.select((F.col("l_partkey") % 97).alias("basin"), "st"), "basin", "st", 20, min_group=20)
    return d.groupBy("locked").agg(F.count("*").alias("n"), F.count_distinct("basin").alias("groups"), F.count_distinct("st").alias("regions"))


@query("calibration_split", f"""WITH k AS (SELECT rid, p, row_number() OVER (ORDER BY {KEY.format(4, 'rid')}, rid) AS rn FROM px_preds) SELECT CASE WHEN rn<=2000 THEN 'calibration' ELSE 'train' END AS part, count(*) AS n, round(sum(p),4) AS s FROM k GROUP BY 1""")
def _(t):
    return SP.calibration_split(t.px_preds.select("rid", "p"), "rid", 2000, 4).groupBy("part").agg(F.count("*").alias("n"), r(F.sum("p"), 4).alias("s"))


@query("learning_curve_thin", f"""WITH t AS (SELECT rid, p, h.held, row_number() OVER (PARTITION BY h.held ORDER BY {KEY.format(6, 'rid')}, rid) AS rn, count(*) OVER (PARTITION BY h.held) AS n
 FROM px_preds JOIN (VALUES (0),(1),(2)) h(held) ON huc%3<>held),
f AS (SELECT held, p, CASE WHEN rn<=floor(n*0.25) THEN 0.25 WHEN rn<=floor(n*0.5) THEN 0.5 WHEN rn<=floor(n*0.75) THEN 0.75 ELSE 1.0 END::DOUBLE AS fraction FROM t)
SELECT held, fraction, count(*) AS n, round(avg(p),6) AS mean FROM f GROUP BY 1,2""")
def _(t):
    d = t.px_preds.select("rid", "p", (F.col("huc") % 3).cast("int").alias("fold"))
    return SP.thin_training(d, "rid", "fold", 3, [0.25, 0.5, 0.75, 1.0], 6).groupBy("held", "fraction").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean"))


@query("stratified_kfold", f"SELECT st, CAST((row_number() OVER (PARTITION BY st ORDER BY {KEY.format(2, 'rid')}, rid)-1)%3 AS INT) AS fold, rid FROM px_preds")
def _(t):
    return SP.stratified_kfold(t.px_preds.select("rid", "st"), "rid", "st", 3, 2)


BOOT = f"""g AS (SELECT huc, count(*) AS n, sum(y) AS sy, sum(y*y) AS syy, sum((y-p)*(y-p)) AS rp, sum((y-p0)*(y-p0)) AS r0, row_number() OVER (ORDER BY huc) AS g FROM px_preds GROUP BY huc),
dr AS (SELECT a.rep, {KEY.format(8, "a.rep||':'||b.slot")} % (SELECT count(*) FROM g) + 1 AS g FROM (SELECT range AS rep FROM range(2000)) a, (SELECT range AS slot FROM range((SELECT count(*) FROM g))) b),
bt AS (SELECT rep, 1-sum(rp)/(sum(syy)-sum(sy)*sum(sy)/sum(n)) AS p, 1-sum(r0)/(sum(syy)-sum(sy)*sum(sy)/sum(n)) AS p0 FROM dr JOIN g USING (g) GROUP BY rep)"""


@query("cluster_bootstrap_ci", f"""WITH {BOOT} SELECT 'p' AS model, round(avg(p),6) AS mean, round(quantile_cont(p,0.025),6) AS lo, round(quantile_cont(p,0.975),6) AS hi FROM bt UNION ALL
SELECT 'p0', round(avg(p0),6), round(quantile_cont(p0,0.025),6), round(quantile_cont(p0,0.975),6) FROM bt""")
def _(t):
    return rounded(SP.bootstrap_ci(SP.bootstrap_r2(t.px_preds, "huc", "y", ["p", "p0"], 2000, 8), ["p", "p0"]), "model")


@query("paired_bootstrap_delta", f"""WITH {BOOT} SELECT round(avg(p-p0),6) AS mean, round(quantile_cont(p-p0,0.025),6) AS lo, round(quantile_cont(p-p0,0.975),6) AS hi, round(avg(CASE WHEN p-p0>0 THEN 1.0 ELSE 0.0 END),6) AS p_gt0 FROM bt""")
def _(t):
    return rounded(SP.paired_delta(SP.bootstrap_r2(t.px_preds, "huc", "y", ["p", "p0"], 2000, 8), "p0", "p"))


# ---- intervals

@query("split_conformal", """WITH c AS (SELECT abs(y-p) AS e, row_number() OVER (ORDER BY abs(y-p)) AS rn, count(*) OVER () AS n FROM px_preds WHERE huc<20),
h AS (SELECT min(e) AS q FROM c WHERE rn>=least(n, ceil((n+1)*9/10.0)+1)), t AS (SELECT *, greatest(0.0,least(1.0,p-q)) AS lo, greatest(0.0,least(1.0,p+q)) AS hi FROM px_preds, h WHERE huc>=20)
SELECT st, count(*) AS n, round(max(q),6) AS half_width, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END),6) AS coverage, round(avg(hi-lo),6)::DOUBLE AS mean_width FROM t GROUP BY st""")
def _(t):
    half = SP.conformal_half_width(t.px_preds.where("huc < 20"), "y", "p").scalar()
    iv = SP.with_interval(t.px_preds.where("huc >= 20"), "p", half)
    cov = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    return iv.groupBy("st").agg(F.count("*").alias("n"), r(F.max("half_width")).alias("half_width"), r(cov).alias("coverage"), r(F.avg(F.col("upper") - F.col("lower"))).alias("mean_width"))


@query("binned_conformal", """WITH d AS (SELECT * FROM px_preds WHERE huc<20), e AS (SELECT [quantile_cont(p,0.2),quantile_cont(p,0.4),quantile_cont(p,0.6),quantile_cont(p,0.8)] AS q FROM d),
w AS (SELECT len(list_filter(q, lambda z: z<=p)) AS pbin, quantile_cont(abs(y-p),0.9) AS half FROM d, e GROUP BY 1),
t AS (SELECT px_preds.*, len(list_filter(q, lambda z: z<=p)) AS pbin FROM px_preds, e WHERE huc>=20)
SELECT CAST(t.pbin AS INT) AS pbin, count(*) AS n, round(max(half),6) AS half_width, round(avg(CASE WHEN y BETWEEN greatest(0.0,least(1.0,p-half)) AND greatest(0.0,least(1.0,p+half)) THEN 1.0 ELSE 0.0 END),6) AS coverage FROM t JOIN w ON w.pbin=t.pbin GROUP BY 1""")
def _(t):
    iv = SP.conformal_by_bin(t.px_preds.where("huc < 20"), t.px_preds.where("huc >= 20"), "y", "p")
    cov = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    return iv.groupBy("pbin").agg(F.count("*").alias("n"), r(F.max("half_width")).alias("half_width"), r(cov).alias("coverage"))
