"""Queries for cleaning, collapsing and describing survey tables."""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.operators import clean as C
from rillmap.operators.ranking import keep_best
from rillmap.plans.surveys import collapse

TIE = ["pipe", "l_partkey", "l_suppkey"]
BAD = ("closed", "f")
LABELS = ("measured", "scored", "score in range", "not tidal", "has structure", "approved")


def steps():
    return list(zip(LABELS, _conditions()))


def _conditions():
    return [F.col("drop_ft").between(0.0, 4.5), F.col("score").isNotNull(), F.col("score").between(0.0, 1.0), C.not_text("tidal", "yes"),
            C.not_in_text("status", BAD), F.col("pipe").isin(1, 2, 3, 4, 5, 6)]


CONDS = ["drop_ft BETWEEN 0.0 AND 4.5", "score IS NOT NULL", "score BETWEEN 0.0 AND 1.0", "lower(trim(tidal)) <> 'yes'",
         "NOT coalesce(lower(trim(status)) IN ('closed','f'), false)", "pipe IN (1,2,3,4,5,6)"]
KEYROW = "row(score, pipe, l_partkey, l_suppkey)"


def first(c):
    return f"arg_min({c}, {KEYROW}) FILTER (WHERE {c} IS NOT NULL) AS {c}"


PER_DAY = f"""ok AS (SELECT * FROM px_surveys WHERE {' AND '.join(CONDS)}),
day1 AS (SELECT code, observed, {', '.join(first(c) for c in ('score', 'pipe', 'tidal', 'status', 'drop_ft'))} FROM ok GROUP BY code, observed)"""


@query("clean_surveys", f"""WITH {PER_DAY}
SELECT code, max(observed) AS observed, {', '.join(f'arg_max({c}, observed) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('score', 'pipe', 'tidal', 'status', 'drop_ft'))},
 CAST(year(max(observed)) AS INT) AS year FROM day1 GROUP BY code""")
def _(t):
    one = collapse(C.apply_steps(t.px_surveys, steps()), "code", "observed", "score", TIE)
    return C.assemble(one, ["code", "observed", "score", "pipe", "tidal", "status", "drop_ft"], derive={"year": F.year("observed")})


_acc = []
_rep = []
for i, (label, cond) in enumerate(zip(LABELS, CONDS)):
    before = " AND ".join(f"coalesce({c}, false)" for c in _acc) or "true"
    _acc.append(cond)
    after = " AND ".join(f"coalesce({c}, false)" for c in _acc)
    _rep.append(f"SELECT {i + 1} AS step, '{label}' AS label, count(CASE WHEN {before} THEN 1 END) AS before, count(CASE WHEN {after} THEN 1 END) AS after FROM px_surveys")


@query("cleaning_report", f"SELECT *, before - after AS dropped FROM ({' UNION ALL '.join(_rep)}) q")
def _(t):
    return C.cleaning_report(t.px_surveys, steps())


@query("filter_between", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity BETWEEN 5 AND 20 AND l_discount BETWEEN 0.02 AND 0.06")
def _(t):
    return t.lineitem.where(F.col("l_quantity").between(5, 20) & F.col("l_discount").between(0.02, 0.06)).agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("filter_text_3vl", """SELECT status, count(*) AS n FROM px_surveys WHERE lower(trim(tidal)) <> 'yes'
AND NOT coalesce(lower(trim(status)) IN ('closed','f'), false) GROUP BY status""")
def _(t):
    return t.px_surveys.where(C.not_text("tidal", "yes") & C.not_in_text("status", BAD)).groupBy("status").agg(F.count("*").alias("n"))


@query("filter_in_list", "SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('ECONOMY','SMALL') GROUP BY p_type")
def _(t):
    return t.part.where(C.in_text("p_type", ["ECONOMY", "SMALL"])).groupBy("p_type").agg(F.count("*").alias("n"))


@query("validate_digit_code", """SELECT code, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]') THEN CAST(p_size AS DOUBLE) END AS code
FROM part) q GROUP BY code""")
def _(t):
    return t.part.select(C.digit_code(F.col("p_size").cast("string")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("filter_any_present", "SELECT pipe, count(*) AS n FROM px_surveys WHERE coalesce(tidal, status) IS NOT NULL GROUP BY pipe")
def _(t):
    return t.px_surveys.where(C.any_present("tidal", "status")).groupBy("pipe").agg(F.count("*").alias("n"))


@query("audit_flags", """SELECT count(CASE WHEN pipe=7 THEN 1 END) AS removed, count(CASE WHEN drop_ft<=0 THEN 1 END) AS drop_le_0,
count(CASE WHEN tidal IS NULL OR status IS NULL THEN 1 END) AS any_predictor_missing FROM px_surveys""")
def _(t):
    f = C.audit_flags(t.px_surveys, {"removed": F.col("pipe") == 7, "drop_le_0": F.col("drop_ft") <= 0}, ["tidal", "status"])
    return f.agg(*[F.count_if(c).alias(c) for c in ("removed", "drop_le_0", "any_predictor_missing")])


@query("sentinel_to_null", """SELECT pipe, count(CASE WHEN score<>-1 THEN score END) AS n_score, count(CASE WHEN drop_ft>=0 THEN drop_ft END) AS n_drop,
round(avg(CASE WHEN drop_ft>=0 THEN drop_ft END),6) AS mean_drop FROM px_surveys GROUP BY pipe""")
def _(t):
    s = C.sentinels_to_null(t.px_surveys, {"score": "minus_one", "drop_ft": "negative"})
    return s.groupBy("pipe").agg(F.count("score").alias("n_score"), F.count("drop_ft").alias("n_drop"), F.round(F.avg("drop_ft"), 6).alias("mean_drop"))


@query("coalesce_chain", """SELECT v, count(*) AS n FROM (SELECT coalesce(trim(tidal), status, 'unknown') AS v FROM px_surveys) q GROUP BY v""")
def _(t):
    return t.px_surveys.select(F.coalesce(F.trim("tidal"), "status", F.lit("unknown")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("mask_beyond_distance", """SELECT count(CASE WHEN l_tax<=0.05 THEN l_quantity END) AS sc_q, round(sum(CASE WHEN l_tax<=0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END),2)::DOUBLE AS sc_p FROM lineitem""")
def _(t):
    m = C.mask_beyond(t.lineitem.select("l_tax", F.col("l_quantity").alias("sc_q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("sc_p")),
                      "l_tax", 0.05, ["sc_q", "sc_p"])
    return m.agg(F.count("sc_q").alias("sc_q"), F.sum("sc_p").cast("double").alias("sc_p"))


@query("feature_groups", """SELECT * FROM (SELECT 'keys' AS grp, count(*) AS n_rows, 3 AS n_cols FROM lineitem UNION ALL
SELECT 'sizes', count(*), 3 FROM lineitem UNION ALL SELECT 'words', count(*), 3 FROM lineitem) q""")
def _(t):
    renamed = t.lineitem.withColumnsRenamed({"l_orderkey": "key_o", "l_partkey": "key_p", "l_suppkey": "key_s", "l_quantity": "size_q", "l_extendedprice": "size_e",
                                             "l_discount": "size_d", "l_returnflag": "word_r", "l_linestatus": "word_l", "l_shipdate": "word_d", "l_tax": "size_dist_m"})
    g = C.feature_groups(renamed.columns, {"keys": ["key_"], "sizes": ["size_"], "words": ["word_"]}, ["_dist_m"])
    counts = renamed.agg(F.count("*").alias("n_rows"))
    rows = F.array(*[F.struct(F.lit(k).alias("grp"), F.lit(len(v)).alias("n_cols")) for k, v in g.items()])
    return counts.select(F.inline(rows), "n_rows").select("grp", "n_rows", "n_cols")


@query("unmatched_default", """SELECT coalesce(o_orderpriority,'none') AS kind, CASE WHEN o_orderkey IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS matched, count(*) AS n
FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='P' GROUP BY 1,2""")
def _(t):
    j = t.customer.join(t.orders.where("o_orderstatus='P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    d = C.unmatched_defaults(j, F.col("o_orderkey").isNotNull(), {"o_orderpriority": "none"})
    return d.groupBy(F.col("o_orderpriority").alias("kind"), "matched").agg(F.count("*").alias("n"))


@query("clip", """SELECT s, count(*) AS n FROM (SELECT CASE WHEN tidal IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, drop_ft)),6) END AS s FROM px_surveys) q GROUP BY s""")
def _(t):
    c = C.clip(F.when(F.col("tidal").isNotNull(), F.col("drop_ft")), 0.0, 1.0)
    return t.px_surveys.select(F.round(c, 6).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


@query("category_codes", """WITH k AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type)-1 AS INT) AS code FROM (SELECT DISTINCT p_type FROM part) q)
SELECT p.p_type, code, CASE WHEN p.p_type='SMALL' THEN 1.0 ELSE 0.0 END::DOUBLE AS t_SMALL, count(*) AS n FROM part p JOIN k USING (p_type) GROUP BY 1,2,3""")
def _(t):
    d = C.dummies(C.category_codes(t.part, "p_type"), ["p_partkey"], "p_type", ["SMALL"], "t_")
    return d.groupBy("p_type", "code", "t_SMALL").agg(F.count("*").alias("n"))


@query("assemble_columns", "SELECT o_orderkey AS code, o_orderdate AS day, o_totalprice AS price, o_orderkey AS order_id, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def _(t):
    return C.assemble(t.orders, ["o_orderkey", "o_orderdate", "o_orderkey", "o_absent", "o_totalprice"],
                      {"o_orderkey": "code", "o_orderdate": "day", "o_totalprice": "price"}, {"order_id": F.col("code"), "year": F.year("day")})


# ---- aggregations

@query("audit_summary", """WITH p AS (SELECT code, count(*) AS n, count(CASE WHEN score BETWEEN 0 AND 1 THEN 1 END) AS valid, count(CASE WHEN score=-1 THEN 1 END) AS un, max(pipe) AS top FROM px_surveys GROUP BY code)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(code) AS n_keys, CAST(sum(valid) AS BIGINT) AS n_valid, CAST(sum(un) AS BIGINT) AS n_unscored, count(CASE WHEN n>1 THEN 1 END) AS n_repeated,
max(n) AS max_rows, max(top) AS max_sub FROM p""")
def _(t):
    return C.audit_summary(t.px_surveys, "code", "pipe", "score")


@query("group_stats", "SELECT status, count(drop_ft) AS n, round(avg(drop_ft),6) AS mean, min(drop_ft) AS min, max(drop_ft) AS max, round(stddev_samp(drop_ft),6) AS sd FROM px_surveys GROUP BY status")
def _(t):
    return C.group_stats(t.px_surveys, ["status"], "drop_ft").select("status", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("sd", 6).alias("sd"))


@query("value_counts", "SELECT event_type, count(*) AS n, round(count(*)/(SELECT count(*) FROM events)::DOUBLE,6) AS share FROM events GROUP BY event_type")
def _(t):
    return C.value_counts(t.events, "event_type").withColumn("share", F.round("share", 6))


@query("missingness", """SELECT * FROM (SELECT 'tidal' AS "column", round(avg(CASE WHEN tidal IS NULL THEN 1.0 ELSE 0.0 END)*100,4) AS pct_missing FROM px_surveys
UNION ALL SELECT 'status', round(avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END)*100,4) FROM px_surveys UNION ALL SELECT 'score', round(avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END)*100,4) FROM px_surveys) q""")
def _(t):
    return C.missingness(t.px_surveys, ["tidal", "status", "score"]).withColumn("pct_missing", F.round("pct_missing", 4))


@query("describe_dataset", """SELECT count(y) AS n, round(avg(y),6) AS mean, round(stddev_samp(y),6) AS sd, round(avg(CASE WHEN y=0 THEN 1.0 ELSE 0.0 END),6) AS share_0,
round(avg(CASE WHEN y=1 THEN 1.0 ELSE 0.0 END),6) AS share_1, round(quantile_cont(y,0.25),6) AS q25, round(quantile_cont(y,0.5),6) AS q50, round(quantile_cont(y,0.75),6) AS q75,
round(quantile_cont(y,0.95),6) AS q95 FROM px_preds""")
def _(t):
    d = C.describe(t.px_preds, "y")
    return d.select("n", *[F.round(c, 6).alias(c) for c in d.columns if c != "n"])


COLS = ("score", "pipe", "tidal", "status", "drop_ft")


@query("collapse_first_nonnull", f"SELECT code, observed, {', '.join(first(c) for c in COLS)} FROM px_surveys GROUP BY code, observed")
def _(t):
    return C.collapse_first(t.px_surveys, ["code", "observed"], ["score", *TIE]).select("code", "observed", *COLS)


@query("collapse_min_spread", """SELECT code, min(d) AS d, coalesce(round(max(d)-min(d),6),0.0) AS spread, count(*) AS n_rows,
arg_min(status, row(d,pipe,l_partkey,l_suppkey)) FILTER (WHERE d IS NOT NULL AND status IS NOT NULL) AS status0, coalesce(max(d)-min(d) > 0.05, false) AS ambiguous
FROM (SELECT *, CASE WHEN drop_ft>=0 THEN drop_ft END AS d FROM px_surveys) q GROUP BY code""")
def _(t):
    d = t.px_surveys.withColumn("d", F.when(F.col("drop_ft") >= 0, F.col("drop_ft"))).withColumn("status0", F.col("status"))
    with_status = d.withColumn("_k", F.when(F.col("status0").isNotNull(), F.col("d")))
    out = C.collapse_min_spread(d, ["code"], "d", [], TIE)
    low = keep_best(with_status.where("_k IS NOT NULL").select("code", "d", *TIE, "status0"), ["code"], ["d", *TIE]).select("code", "status0")
    return out.join(low, "code", "left").select("code", "d", F.round("spread", 6).alias("spread"), "n_rows", "status0", "ambiguous")


@query("share_by_group", "SELECT status, count(*) AS n, count(CASE WHEN drop_ft>1 THEN 1 END) AS n_true, round(avg(CASE WHEN drop_ft>1 THEN 1.0 ELSE 0.0 END),6) AS share FROM px_surveys GROUP BY status")
def _(t):
    return C.share_by(t.px_surveys, ["status"], F.col("drop_ft") > 1).withColumn("share", F.round("share", 6))


@query("group_eligibility_rule", """WITH r AS (SELECT l_suppkey AS g, score*10 AS v FROM px_surveys WHERE score>=0),
s AS (SELECT g, avg(CASE WHEN v=0 THEN 1.0 ELSE 0.0 END) AS z, bool_and(floor(v)=v) AS whole FROM r GROUP BY g)
SELECT g, round(z,6) AS zero_share, whole, z>=0.1 AND whole AS usable FROM s""")
def _(t):
    r = t.px_surveys.where("score >= 0").select(F.col("l_suppkey").alias("g"), (F.col("score") * 10).alias("v"))
    return C.eligible_groups(r, "g", "v", F.floor("v") == F.col("v")).withColumn("zero_share", F.round("zero_share", 6))


@query("sum_null_if_all_null", """SELECT count(CASE WHEN s IS NULL THEN 1 END) AS n_null, round(sum(s),4) AS total FROM
(SELECT CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a,0.0)+coalesce(b,0.0) END AS s FROM (SELECT CASE WHEN l_tax>0.03 THEN l_quantity END AS a, CASE WHEN l_discount>0.05 THEN l_quantity*2 END AS b FROM lineitem) q) r""")
def _(t):
    q = t.lineitem
    s = C.sum_parts([F.when(F.col("l_tax") > 0.03, F.col("l_quantity")), F.when(F.col("l_discount") > 0.05, F.col("l_quantity") * 2)])
    return q.select(s.alias("s")).agg(F.count_if(F.col("s").isNull()).alias("n_null"), F.round(F.sum("s"), 4).alias("total"))
