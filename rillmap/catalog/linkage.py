"""Queries for lookups, record linkage and set operations."""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.functions import text as X
from rillmap.operators import clean as C
from rillmap.operators import joins as J
from rillmap.operators import points as P

ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) q WHERE rn=1"


@query("join_normalised_key", f"""WITH one AS ({ONE}) SELECT p.p_partkey, o.p_partkey AS first_key, o.p_size AS first_size FROM part p LEFT JOIN one o ON o.p_name=p.p_name""")
def _(t):
    look = t.part.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("label"), F.col("p_partkey").alias("first_key"), F.col("p_size").alias("first_size"))
    left = t.part.withColumn("named", F.concat(F.col("p_name"), F.lit(" County ")))
    look = look.select("first_key", "label", "first_size")
    return J.join_name(left, look, "named", "label", " County").select("p_partkey", "first_key", "first_size")


@query("join_left_lookup", """WITH one AS (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey)
SELECT c_custkey, k AS o_orderkey, price AS o_totalprice FROM customer LEFT JOIN one ON o_custkey=c_custkey""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return J.join_lookup(t.customer.select("c_custkey"), o, "c_custkey", ["o_orderkey"])


@query("join_inner", "SELECT o_orderstatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


AB = """a AS (SELECT code, min(drop_ft) AS d FROM px_surveys WHERE drop_ft>=0 AND status='O' GROUP BY code),
b AS (SELECT code, min(drop_ft) AS d FROM px_surveys WHERE drop_ft>=0 AND status='F' GROUP BY code)"""


def sides(t):
    s = t.px_surveys.where("drop_ft >= 0")
    return [s.where(F.col("status") == x).groupBy("code").agg(F.min("drop_ft").alias("d")) for x in "OF"]


@query("join_full_outer_coalesce", f"WITH {AB} SELECT coalesce(a.code,b.code) AS code, coalesce(a.d,b.d) AS d, CASE WHEN a.d IS NOT NULL THEN 'a' ELSE 'b' END AS source FROM a FULL JOIN b ON a.code=b.code")
def _(t):
    return J.join_first_wins(*sides(t), ["code"], "d")


@query("join_anti_unused", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def _(t):
    taken = t.orders.where("o_orderstatus='P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unused(t.customer.select("c_custkey", "c_nationkey"), taken, "c_custkey")


@query("join_pointer_self", """SELECT a.o_orderkey, d.o_totalprice AS down, u.o_totalprice AS up, round(a.o_totalprice-d.o_totalprice,4) AS drop_down, round(u.o_totalprice-a.o_totalprice,4) AS drop_up
FROM orders a LEFT JOIN orders d ON d.o_orderkey=a.o_custkey LEFT JOIN orders u ON u.o_orderkey=a.o_orderkey+a.o_custkey""")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("dn_seq"), (F.col("o_orderkey") + F.col("o_custkey")).alias("up_seq"))
    out = J.follow_pointers(o, "o_orderkey", {"down": "dn_seq", "up": "up_seq"}, "o_totalprice")
    return out.select("o_orderkey", "down", "up", F.round(F.col("o_totalprice") - F.col("down"), 4).alias("drop_down"), F.round(F.col("up") - F.col("o_totalprice"), 4).alias("drop_up"))


# Linkage fixture: parts against the same parts moved by a size-dependent shift and a score that is sometimes off.
LINK = """l AS (SELECT sid AS id, sid AS lid, sx AS lx, sy AS ly, size_m/50.0::DOUBLE AS ls FROM px_structs),
r AS (SELECT CASE WHEN kind='SMALL' THEN NULL ELSE sid END AS id, sid AS rid, sx+size_m AS rx, sy AS ry, CASE WHEN kind='LARGE' THEN size_m/50.0::DOUBLE+0.5 ELSE size_m/50.0::DOUBLE END AS rs, size_m/10.0::DOUBLE AS dv FROM px_structs)"""


def link_sides(t):
    s = t.px_structs
    left = s.select(F.col("sid").alias("id"), F.col("sid").alias("lid"), F.col("sx").alias("lx"), F.col("sy").alias("ly"), (F.col("size_m") / F.lit(50.0)).alias("ls"))
    right = s.select(F.when(F.col("kind") != "SMALL", F.col("sid")).alias("id"), F.col("sid").alias("rid"), (F.col("sx") + F.col("size_m")).alias("rx"), F.col("sy").alias("ry"),
                     (F.col("size_m") / F.lit(50.0) + F.when(F.col("kind") == "LARGE", 0.5).otherwise(0.0)).alias("rs"), (F.col("size_m") / F.lit(10.0)).alias("dv"))
    return left, right


@query("join_verified_id", f"WITH {LINK} SELECT lid, rid, abs(lx-rx) AS match_m FROM l JOIN r USING (id) WHERE abs(lx-rx)<=30 AND abs(ls-rs)<0.02")
def _(t):
    left, right = link_sides(t)
    return J.verified_pairs(left, right, "id", F.abs(F.col("lx") - F.col("rx")), F.abs(F.col("ls") - F.col("rs"))).select("lid", "rid", "match_m")


@query("match_multipass", f"""WITH {LINK},
c1 AS (SELECT lid, rid, dv, abs(ls-rs) AS gap, sqrt((lx-rx)*(lx-rx)+(ly-ry)*(ly-ry)) AS m FROM l JOIN r USING (id)),
one AS (SELECT lid, arg_min(rid, row(m,rid,gap)) AS rid, min(dv) AS dv, 1 AS pass, min(m) AS m, coalesce(max(dv)-min(dv),0.0)>0.05 AS ambiguous FROM c1 WHERE m<=30 AND gap<0.02 GROUP BY lid),
c2 AS (SELECT lid, rid, dv, abs(ls-rs) AS gap, sqrt((lx-rx)*(lx-rx)+(ly-ry)*(ly-ry)) AS m FROM l, r WHERE lid NOT IN (SELECT lid FROM one) AND rid NOT IN (SELECT rid FROM one)),
two0 AS (SELECT lid, arg_min(rid, row(m,rid,gap)) AS rid, min(dv) AS dv, 2 AS pass, min(m) AS m, coalesce(max(dv)-min(dv),0.0)>0.05 AS ambiguous FROM c2 WHERE m<=30 AND gap<0.02 GROUP BY lid),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY m, lid) AS rn FROM two0) q WHERE rn=1),
un AS (SELECT lid, rid, dv, pass, m, ambiguous FROM one UNION ALL SELECT lid, rid, dv, pass, m, ambiguous FROM two),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY m, lid) AS rn FROM un) q WHERE rn=1),
k2 AS (SELECT lid, rid, dv, pass, m, ambiguous FROM (SELECT lid, rid, dv, pass, m, ambiguous, row_number() OVER (PARTITION BY lid ORDER BY m, rid) AS r2 FROM k1) q WHERE r2=1),
fb AS (SELECT sid AS lid, size_m/100.0::DOUBLE AS old FROM px_structs WHERE kind='LARGE')
SELECT l.lid, rid, coalesce(dv, old) AS dv, CASE WHEN dv IS NULL AND old IS NOT NULL THEN 3 ELSE pass END AS pass, round(m,6) AS match_m, coalesce(ambiguous,false) AS ambiguous
FROM l LEFT JOIN k2 ON k2.lid=l.lid LEFT JOIN fb ON fb.lid=l.lid""")
def _(t):
    left, right = link_sides(t)
    fb = t.px_structs.where("kind='LARGE'").select(F.col("sid").alias("lid"), (F.col("size_m") / F.lit(100.0)).alias("dv"))
    out = J.match_multipass(left, right, "id", "lid", "rid", ("lx", "ly"), ("rx", "ry"), "ls", "rs", "dv", fb)
    return out.select("lid", "rid", "dv", "pass", F.round("match_m", 6).alias("match_m"), "ambiguous")


@query("join_guard_conflict", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def _(t):
    left = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber").join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k")
    return J.join_guarded(left, t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k", "o_totalprice", "price").select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_totalprice")


@query("diff_two_sources", """WITH a AS (SELECT code, arg_min(score, row(pipe,l_partkey,l_suppkey)) AS s, arg_min(observed, row(pipe,l_partkey,l_suppkey)) AS d FROM px_surveys GROUP BY code),
b AS (SELECT code, min(score) AS lo, max(score) AS hi, min(observed) AS day FROM px_surveys GROUP BY code),
j AS (SELECT abs(s-hi) AS g, s, d, lo, hi, day FROM a JOIN b USING (code) WHERE lo>=0)
SELECT count(*) AS n_shared, round(avg(CASE WHEN g<0.001 THEN 1.0 ELSE 0.0 END),6) AS share_same, count(CASE WHEN g>=0.001 THEN 1 END) AS n_differ, count(CASE WHEN g>0.05 THEN 1 END) AS n_over_05,
count(CASE WHEN g>0.2 THEN 1 END) AS n_over_20, count(CASE WHEN g>0.05 AND d=day THEN 1 END) AS n_same_day, count(CASE WHEN g>0.05 AND s<hi THEN 1 END) AS n_lower, count(CASE WHEN hi-lo>0.001 THEN 1 END) AS n_inner FROM j""")
def _(t):
    a = C.collapse_first(t.px_surveys.select("code", "pipe", "l_partkey", "l_suppkey", "score", "observed"), ["code"], ["pipe", "l_partkey", "l_suppkey"], mode="row")
    return J.diff_sources(a, t.px_surveys, "code", "score", "observed").withColumn("share_same", F.round("share_same", 6))


RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("map_dictionary", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS rank, CASE o_orderstatus WHEN 'O' THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.lookup(F.col("o_orderpriority"), RANK).alias("rank"), X.lookup(F.col("o_orderstatus"), {"O": 1.0}, 0.5).alias("w"))


@query("score_once_ledger", "SELECT DISTINCT p_brand AS tier FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def _(t):
    done = t.part.where("p_size > 48").select(F.col("p_brand").alias("tier"))
    return J.not_in_ledger(t.part.select(F.col("p_brand").alias("tier")).distinct(), done, "tier")


@query("join_stack_sources", "SELECT source, region, count(*) AS n, round(avg(bal),4) AS mean FROM (SELECT 'a' AS source, c_nationkey AS region, c_acctbal AS bal FROM customer UNION ALL SELECT 'b', s_nationkey, s_acctbal FROM supplier) q GROUP BY 1,2")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("bal"), "c_mktsegment")
    b = t.supplier.select(F.col("s_nationkey").alias("region"), F.col("s_acctbal").alias("bal"), "s_name")
    return J.stack_sources(a, b).groupBy("source", "region").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 4).alias("mean"))


@query("select_new_rows", """WITH s AS (SELECT * FROM px_structs WHERE size_m>=5 AND kind IN ('ECONOMY','SMALL','STANDARD')),
f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM px_points WHERE sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy))<=150.0) AND substr(lpad(CAST(size_m AS VARCHAR),2,'0'),1,1) NOT IN ('1'))
SELECT sid, sx, sy FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.sid<a.sid AND sqrt((a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy))<=300.0)""")
def _(t):
    s = t.px_structs.where((F.col("size_m") >= 5) & C.in_text("kind", ["ECONOMY", "SMALL", "STANDARD"]))
    s = s.where(~X.code_prefix(F.lpad(F.col("size_m").cast("string"), 2, "0"), 1).isin("1"))
    s = P.farther_than(s, t.px_points, "sid", "pid", 150.0, ("sx", "sy"), ("x", "y"))
    return P.dedupe_within(s, "sid", 300.0, ("sx", "sy")).select("sid", "sx", "sy")


@query("union_by_name", "SELECT grp, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (SELECT c_nationkey AS grp, c_acctbal AS a, NULL::DOUBLE AS b FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) q GROUP BY grp")
def _(t):
    u = J.union_all([t.customer.select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("a")), t.supplier.select(F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("b"))])
    return u.groupBy("grp").agg(F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("union_distinct_by_id", "SELECT id, min(v) AS v FROM (SELECT o_custkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus='O' UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus<>'P') q GROUP BY id")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return J.union_distinct([o.where("o_orderstatus='O'"), o.where("o_orderstatus<>'P'")], "id", ["v"]).select("id", "v")


@query("key_set_compare", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_only_b,
(SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b))=0 AND (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a))=0 AS equal""")
def _(t):
    return J.compare_keys(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")), "k")


@query("index_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return J.unused(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
