"""Queries for column expressions, each inside a job over a whole table."""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.functions import geo as G
from rillmap.functions import scoring as SC
from rillmap.functions import terrain as TE
from rillmap.functions import text as X
from rillmap.functions import weights as W
from rillmap.operators import shapes as S


def on(key, source, oracle):
    """A query whose input is the same SQL text in both engines; ``s`` names it in the twin."""
    def add(build):
        query(key, f"WITH s AS ({source})\n{oracle}")(lambda t: build(t.sql(source)))
        return build
    return add


def r(c, n=6):
    return F.round(c, n)


DMS = """SELECT c_custkey AS id, concat(lpad(CAST(40+c_nationkey%5 AS STRING),2,'0'), lpad(CAST(c_custkey%70 AS STRING),2,'0'), lpad(CAST((c_custkey*37)%7000 AS STRING),4,'0')) AS la,
concat(CASE WHEN c_nationkey=3 THEN '' ELSE '0' END, CAST(70+c_nationkey%9 AS STRING), lpad(CAST(c_custkey%60 AS STRING),2,'0'), CASE WHEN c_nationkey=7 THEN 'N/A ' ELSE lpad(CAST((c_custkey*91)%6000 AS STRING),4,'0') END) AS lo FROM customer"""


def dms_sql(c, k):
    full = f"CASE WHEN length(trim({c}))>{k + 6} THEN trim({c}) ELSE lpad(trim({c}),{k + 6},'0') END"
    d, m, s = f"TRY_CAST(substr({full},1,{k}) AS DOUBLE)", f"TRY_CAST(substr({full},{k + 1},2) AS DOUBLE)", f"TRY_CAST(substr({full},{k + 3}) AS DOUBLE)/100.0"
    return f"CASE WHEN {m}<60 AND {s}<60 THEN round({d}+{m}/60.0+{s}/3600.0,8) END"


@on("dms_to_degrees", DMS, f"SELECT id, {dms_sql('la', 2)} AS lat, {dms_sql('lo', 3)} AS lon FROM s")
def _(s):
    return s.select("id", r(X.dms_to_degrees(F.col("la"), 2), 8).alias("lat"), r(X.dms_to_degrees(F.col("lo"), 3), 8).alias("lon"))


@on("strip_quotes", "SELECT p_partkey AS id, concat('  ''', p_name, ' '' ') AS q FROM part", "SELECT id, trim(trim(trim(q), '''')) AS v FROM s")
def _(s):
    return s.select("id", X.strip_quotes(F.col("q")).alias("v"))


@on("normalise_name", "SELECT p_partkey AS id, concat('  ', upper(p_name), ' County ') AS q FROM part",
    "SELECT id, array_to_string(list_transform(string_split(trim(replace(trim(q),' County','')),' '), lambda w: upper(w[1])||lower(w[2:])),' ') AS v FROM s")
def _(s):
    return s.select("id", X.normalise_name(F.col("q"), " County").alias("v"))


@on("code_prefix", "SELECT lpad(CAST(l_suppkey*7919 AS STRING),8,'0') AS huc8 FROM lineitem",
    "SELECT substr(huc8,1,6) AS huc6, substr(huc8,1,4) AS huc4, count(*) AS n FROM s GROUP BY 1,2")
def _(s):
    return s.groupBy(X.code_prefix(F.col("huc8"), 6).alias("huc6"), X.code_prefix(F.col("huc8"), 4).alias("huc4")).agg(F.count("*").alias("n"))


@query("extract_number", r"SELECT event_id, TRY_CAST(nullif(regexp_extract(props,'(\d+(?:\.\d+)?)',1),'') AS DOUBLE) AS v FROM events")
def _(t):
    return t.events.select("event_id", X.extract_number(F.col("props")).alias("v"))


HST = r"""SELECT event_id AS id, concat('"bridge"=>"', event_type, '","layer"=>"', CAST(user_id AS STRING), '","name"=>"A \\"q\\" b"', CASE WHEN event_type='view' THEN ',"bridge"=>"no"' ELSE '' END) AS h FROM events"""
HST_DUCK = HST.replace("\\\\", "\\")
PAT = r"'\"([^\"]+)\"=>\"((?:[^\"\\]|\\.)*)\"'"
PAT_DUCK = r"""'"([^"]+)"=>"((?:[^"\\]|\\.)*)"'"""


@query("parse_hstore", f"""WITH s AS ({HST_DUCK}), kv AS (SELECT id, regexp_extract_all(h, {PAT_DUCK}, 1) AS k, regexp_extract_all(h, {PAT_DUCK}, 2) AS v FROM s)
SELECT id, v[len(k)-list_position(list_reverse(k),'bridge')+1] AS bridge, v[len(k)-list_position(list_reverse(k),'layer')+1] AS layer, v[list_position(k,'name')] AS name,
v[list_position(k,'surface')] AS surface, list_contains(k,'name') AS has_name FROM kv""")
def _(t):
    m = t.sql(HST).withColumn("m", X.parse_hstore(F.col("h")))
    return m.select("id", *[X.tag(F.col("m"), k).alias(k) for k in ("bridge", "layer", "name", "surface")], X.has_key(F.col("m"), "name").alias("has_name"))


TAGS = """SELECT p_partkey AS id, CASE WHEN p_size=1 THEN 'rail' END AS railway,
CASE WHEN p_size<5 THEN NULL WHEN p_size<10 THEN 'service' WHEN p_size<14 THEN 'footway' WHEN p_size<18 THEN 'motorway' WHEN p_size<25 THEN 'track' WHEN p_size<35 THEN 'Residential' ELSE 'tertiary' END AS highway,
CASE p_type WHEN 'SMALL' THEN 'gravel' WHEN 'LARGE' THEN 'Asphalt' WHEN 'PROMO' THEN 'unlisted' END AS surface, CASE WHEN p_size=7 THEN 'driveway' END AS service,
CASE WHEN p_size=30 THEN '4' WHEN p_size=31 THEN '2.5' WHEN p_size=32 THEN 'many' END AS lanes,
CASE WHEN p_size<20 THEN 'yes' WHEN p_size<30 THEN 'no' END AS bridge, CASE WHEN p_size IN (3,6) THEN 'box_culvert' END AS bstruct FROM part"""
PV, UV, TV = (", ".join(f"'{w}'" for w in ws) for ws in (X.PAVED, X.UNPAVED, X.TRAILS))


@on("classify_road_tags", TAGS, f"""SELECT id, CASE WHEN railway IS NOT NULL THEN 'railroad' WHEN hw='service' AND service='driveway' THEN 'driveway' WHEN hw IN ({TV}) THEN 'trail'
WHEN ln>2 OR (hw IN ('motorway','trunk') AND ln IS NULL) THEN 'multilane road (>2 lanes)' WHEN hw='track' THEN CASE WHEN su IN ({PV}) THEN 'paved' ELSE 'unpaved' END
WHEN su IN ({UV}) THEN 'unpaved' WHEN su IN ({PV}) OR hw<>'' THEN 'paved' ELSE 'unknown' END AS class
FROM (SELECT *, lower(coalesce(highway,'')) AS hw, lower(coalesce(surface,'')) AS su, floor(TRY_CAST(lanes AS DOUBLE)) AS ln FROM s) q""")
def _(s):
    return s.select("id", X.classify_road(*[F.col(c) for c in ("highway", "railway", "surface", "service", "lanes")]).alias("class"))


@on("classify_structure_kind", TAGS, """SELECT CASE WHEN highway IS NOT NULL AND coalesce(bridge,'no')<>'no' THEN 'road_bridge' WHEN highway IS NOT NULL THEN 'road_culvert' ELSE 'stream_culvert' END AS kind,
CASE WHEN coalesce(bridge='culvert',false) OR coalesce(bstruct IN ('culvert','box_culvert'),false) THEN 1.0 ELSE 0.0 END::DOUBLE AS culvert_like, count(*) AS n FROM s GROUP BY 1,2""")
def _(s):
    return s.groupBy(X.structure_kind(F.col("highway"), F.col("bridge")).alias("kind"), X.culvert_like(F.col("bridge"), F.col("bstruct")).alias("culvert_like")).agg(F.count("*").alias("n"))


@on("strip_code_label", "SELECT p_partkey AS id, CASE WHEN p_size<25 THEN concat(CAST(p_size AS STRING),' - ',p_name,' - x ') ELSE concat(' ',p_name) END AS q FROM part",
    "SELECT id, trim(CASE WHEN instr(q,' - ')>0 THEN substr(q, instr(q,' - ')+3) ELSE q END) AS v FROM s")
def _(s):
    return s.select("id", X.strip_code_label(F.col("q")).alias("v"))


MEAS = """SELECT p_partkey AS id, CASE WHEN p_size<12 THEN CAST(p_size AS STRING) WHEN p_size<15 THEN concat(CAST(p_size AS STRING),'.5') WHEN p_size<25 THEN concat(CAST(p_size-14 AS STRING),'-',CAST(p_size AS STRING))
WHEN p_size<35 THEN concat('> ',CAST(p_size AS STRING)) WHEN p_size<40 THEN '-2' WHEN p_size<45 THEN 'No data' END AS q FROM part"""


@on("parse_measure_text", MEAS, r"""SELECT id, round(coalesce(n/12,(a+b)/24,o/12),6) AS point, round(coalesce(n/12,a/12,o/12),6) AS low, round(coalesce(n/12,b/12),6) AS high,
coalesce(regexp_matches(q,'[->]'),false) AS is_range, coalesce(regexp_matches(q,'[->]'),false) OR n IS NULL OR n=floor(n) AS whole,
coalesce(regexp_matches(q,'[->]'),false) AND coalesce(coalesce(n/12,a/12,o/12)<0.25,false) AND coalesce(coalesce(n/12,b/12)>0.25,false) AS straddles
FROM (SELECT *, TRY_CAST(trim(q) AS DOUBLE) AS n, TRY_CAST(nullif(regexp_extract(q,'^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$',1),'') AS DOUBLE) AS a,
TRY_CAST(nullif(regexp_extract(q,'^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$',2),'') AS DOUBLE) AS b, TRY_CAST(nullif(regexp_extract(q,'^\s*>\s*(\d+(?:\.\d+)?)\s*$',1),'') AS DOUBLE) AS o FROM s) z""")
def _(s):
    m = s.withColumn("m", X.parse_measure(F.col("q")))
    ranged = X.is_range(F.col("q"))
    return m.select("id", *[r(F.col(f"m.{c}")).alias(c) for c in ("point", "low", "high")], ranged.alias("is_range"), X.is_whole(F.col("q")).alias("whole"),
                    X.straddles(ranged, F.col("m.low"), F.col("m.high"), 0.25).alias("straddles"))


@on("token_overlap", "SELECT a.p_partkey AS id, concat(a.p_name,' creek') AS a, concat('Creek ',b.p_name) AS b FROM part a JOIN part b ON b.p_partkey=a.p_size",
    "SELECT id, list_has_any(string_split(replace(a,' creek',''),' '), string_split(replace(b,'Creek ',''),' ')) AS agree FROM s")
def _(s):
    return s.select("id", X.shared_token(X.tokens(F.col("a")), X.tokens(F.col("b"))).alias("agree"))


DATES = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus='P' THEN 'not a date' ELSE substr(CAST(o_orderdate AS STRING),1,10) END AS d, CAST(o_custkey AS BIGINT)*1000000000 AS ms FROM orders"


@on("date_parts", DATES, """SELECT id, CAST(year(TRY_CAST(d AS DATE)) AS INT) AS year, CAST(year(epoch_ms(ms)) AS INT) AS ms_year, CAST(CASE WHEN greatest(2025-year(epoch_ms(ms)),0)<40 THEN greatest(2025-year(epoch_ms(ms)),0) END AS INT) AS since,
CAST(TRY_CAST(d AS DATE) AS DATE)=DATE '1996-03-01' AS same_day FROM s""")
def _(s):
    d = X.parse_date(F.col("d"))
    y = X.epoch_ms_year(F.col("ms"))
    return s.select("id", F.year(d).alias("year"), y.alias("ms_year"), X.years_since(y, 2025).alias("since"), X.same_day(d, F.lit("1996-03-01").cast("timestamp")).alias("same_day"))


@query("temporal_inconsistency", "SELECT count(*) AS matched, count(CASE WHEN year(o_orderdate)>year(l_shipdate) THEN 1 END) AS built_after FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(F.count("*").alias("matched"), F.count_if(F.year("o_orderdate") > F.year("l_shipdate")).alias("built_after"))


@query("log_transforms", "SELECT c_custkey, round(log10(greatest(c_acctbal,1.0)),6) AS log_a, round(ln(1+greatest(c_acctbal,0.0)),6) AS log_b FROM customer")
def _(t):
    return t.customer.select("c_custkey", r(W.log10_clipped(F.col("c_acctbal"), 1.0)).alias("log_a"), r(F.log1p(F.greatest("c_acctbal", F.lit(0.0)))).alias("log_b"))


OPEN = "power(1-exp(-15.0::DOUBLE*{0}*(1-0.62::DOUBLE)),1.0/(1-0.62::DOUBLE))"
HGT = "least(1.1::DOUBLE*{0}*{0}/(2.2::DOUBLE*2.2+{0}*{0}),1.0)"
DRP = "greatest(0.0,least(1.0,1-1.029412::DOUBLE*{0}*{0}/(0.51449575::DOUBLE*0.51449575+{0}*{0})))"
CURVE = "SELECT pipe, drop_ft, greatest(drop_ft,0.0) AS x FROM px_surveys"


@query("component_curves", f"""WITH s AS (SELECT pipe, greatest(drop_ft,0.0) AS x FROM px_surveys)
SELECT pipe, round(avg({OPEN.format('x')}),6)::DOUBLE AS openness, round(avg({HGT.format('x')}),6)::DOUBLE AS height, round(avg({DRP.format('x')}),6)::DOUBLE AS outlet_drop FROM s GROUP BY pipe""")
def _(t):
    d = F.col("drop_ft")
    return t.px_surveys.groupBy("pipe").agg(r(F.avg(SC.openness_score(d))).alias("openness"), r(F.avg(SC.height_score(d))).alias("height"), r(F.avg(SC.outlet_drop_score(d))).alias("outlet_drop"))


# One survey row per part: every component category appears, with padding, case changes, unlisted words and NULLs.
CYCLE = {"Crossing_Span": ["Severe", " moderate", "Spans Only Bankfull", "no data", "unknown", "odd"], "Inlet_Grade": ["Perched", "At Stream Grade", "odd"],
         "Internal_Structure": ["None", "Supports", "Baffles/Weirs", "odd"], "Armoring": ["Extensive", "None", "Not Extensive"], "Barrier_Severity": ["Minor", "Severe", "None", "moderate"],
         "Scour_Pool": ["Large", "small", "no data", "none", "odd"], "Substrate_Continuous": ["25%", "100%", "unknown", "none", "odd"],
         "Structure_Substrate_Matches_Stream": ["comparable", "none", "unknown", "odd"], "Water_Depth_Matches_Stream": ["yes", "dry", "no-deeper", "unknown", "odd"],
         "Water_Velocity": ["no-faster", "no-slower", "comparable", "unknown", "odd"]}


def cycle_sql():
    out = []
    for i, (col, words) in enumerate(CYCLE.items()):
        n = len(words) + 1
        out.append(f"CASE (p_partkey*{2 * i + 3}+p_size)%{n} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + f" END AS {col}")
    return ", ".join(out)


SURV = f"""SELECT p_partkey AS id, CASE WHEN p_size%6=0 THEN NULL ELSE CAST(p_size AS DOUBLE)/40 END AS Outlet_Openness, CAST(p_size AS DOUBLE)/5 AS Outlet_Height,
CASE WHEN p_size%5=0 THEN NULL ELSE CAST(p_size-3 AS DOUBLE)/20 END AS Outlet_Drop_To_Water_Surface, CASE WHEN p_size%10=0 THEN NULL ELSE CAST(p_size AS DOUBLE)/30 END AS Outlet_Drop_To_Stream_Bottom, {cycle_sql()} FROM part"""


def category_sql(name):
    col, scores, default = SC.CATEGORIES[name]
    num = lambda v: "NULL" if v is None else f"{v}::DOUBLE"
    return f"CASE WHEN {col} IS NULL THEN NULL ELSE CASE lower(trim({col})) " + " ".join(f"WHEN '{k}' THEN {num(v)}" for k, v in scores.items()) + f" ELSE {num(default)} END END"


COMP = {"openness": OPEN.format("greatest(Outlet_Openness,0.0)"), "height": HGT.format("greatest(Outlet_Height,0.0)"), "outlet_drop": DRP.format("od"),
        **{c: category_sql(c) for c in SC.CATEGORIES}}
COMP["openness"] = f"CASE WHEN Outlet_Openness IS NOT NULL THEN {COMP['openness']} END"
COMP["outlet_drop"] = f"CASE WHEN od IS NOT NULL THEN {COMP['outlet_drop']} END"
SCORED = f"""d AS (SELECT *, CASE WHEN coalesce(Outlet_Drop_To_Water_Surface, Outlet_Drop_To_Stream_Bottom) IS NOT NULL THEN greatest(coalesce(Outlet_Drop_To_Water_Surface, Outlet_Drop_To_Stream_Bottom),0.0) END AS od FROM s),
c AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in COMP.items())} FROM d),
w AS (SELECT *, ({' + '.join(f'coalesce({k},0.0)*{w}' for k, w in SC.WEIGHTS.items())}) / nullif({' + '.join(f'CASE WHEN {k} IS NULL THEN 0.0 ELSE {w} END' for k, w in SC.WEIGHTS.items())},0) AS composite FROM c)"""


@on("category_score_map", SURV, f"SELECT id, {', '.join(f'({category_sql(c)})::DOUBLE AS {c}' for c in SC.CATEGORIES)} FROM s")
def _(s):
    return s.select("id", *[SC.category_score(F.col(col), scores, default).alias(n) for n, (col, scores, default) in SC.CATEGORIES.items()])


@query("weighted_composite", f"WITH s AS ({SURV}), {SCORED} SELECT id, round(coalesce(composite,0.0),9)::DOUBLE AS composite, round(greatest(0.0,least(1.0,least(coalesce(composite,0.0),coalesce(outlet_drop,1.0)))),9)::DOUBLE AS final FROM w")
def _(t):
    return SC.add_passability(t.sql(SURV)).select("id", r("composite", 9).alias("composite"), r("final", 9).alias("final"))


@query("polygon_area", """WITH p AS (SELECT gid, radians(40+ymin/20000) AS a, radians(40+ymax/20000) AS b, radians(-75+xmin/20000) AS w, radians(-75+xmax/20000) AS e FROM px_polys)
SELECT gid, round((e-w)*(b-a)*6371.0088*6371.0088*cos((3*a+2*b)/5),4) AS km2 FROM p""")
def _(t):
    lo, la = (lambda c: -75 + F.col(c) / 20000), (lambda c: 40 + F.col(c) / 20000)
    pt = lambda x, y: F.struct(lo(x).alias("x"), la(y).alias("y"))
    ring = F.array(pt("xmin", "ymin"), pt("xmax", "ymin"), pt("xmax", "ymax"), pt("xmin", "ymax"), pt("xmin", "ymin"))
    return t.px_polys.select("gid", r(G.ring_area_km2(ring), 4).alias("km2"))


LL = "SELECT pid, 40+y/20011*5 AS lat, -80+x/20011*8 AS lon, 40+x/20011*5 AS lat2, -80+y/20011*8 AS lon2, v, grp FROM px_points"


@on("haversine_km", LL, """SELECT pid, round(2*6371.0088*asin(sqrt(power(sin(radians(lat2-lat)/2),2)+cos(radians(lat))*cos(radians(lat2))*power(sin(radians(lon2-lon)/2),2))),6) AS km FROM s""")
def _(s):
    return s.select("pid", r(G.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("km"))


@on("planar_distance_m", LL, "SELECT pid, round(sqrt(power((lat-lat2)*110540.0,2)+power((lon-lon2)*111320.0*cos(radians(lat)),2)),4) AS m FROM s")
def _(s):
    from rillmap.operators.joins import flat_metres
    return s.select("pid", r(flat_metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("m"))


@on("offset_latlon", LL, """SELECT pid, count(*) AS n, round(max(lat+100/111320.0),8) AS north_lat, round(max(lon+100/(111320.0*cos(radians(lat)))),8) AS east_lon, round(max(lon+40*sqrt(0.5)/(111320.0*cos(radians(lat)))),8) AS ne_lon
FROM s, range(49) GROUP BY pid""")
def _(s):
    ring = s.select("pid", "lat", "lon", F.inline(G.sample_ring(F.col("lat"), F.col("lon"), [3, 6, 10, 15, 25, 40]).alias("q")).alias("i", "qlon", "qlat"))
    north, _ = G.offset(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(100.0))
    _, east = G.offset(F.col("lat"), F.col("lon"), F.lit(100.0), F.lit(0.0))
    return ring.groupBy("pid").agg(F.count("*").alias("n"), r(F.max(north), 8).alias("north_lat"), r(F.max(east), 8).alias("east_lon"),
                                   r(F.max(F.when(F.col("i") == 42, F.col("qlon"))), 8).alias("ne_lon"))


@on("project_albers", LL, f"""SELECT pid, round(rho*sin(th),3) AS x, round({G.RHO0}-rho*cos(th),3) AS y FROM (SELECT pid, {G.A}::DOUBLE*sqrt({G.C}::DOUBLE-{G.N}::DOUBLE*q)/{G.N}::DOUBLE AS rho, {G.N}::DOUBLE*radians(lon+96.0) AS th FROM
(SELECT pid, lon, (1-{G.E2}::DOUBLE)*(sp/(1-{G.E2}::DOUBLE*sp*sp)-ln((1-sqrt({G.E2}::DOUBLE)*sp)/(1+sqrt({G.E2}::DOUBLE)*sp))/(2*sqrt({G.E2}::DOUBLE))) AS q FROM (SELECT pid, lon, sin(radians(lat)) AS sp FROM s) a) b) c""")
def _(s):
    x, y = G.albers(F.col("lon"), F.col("lat"))
    return s.select("pid", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("bearing_skew", """WITH b AS (SELECT lid, max(CASE WHEN seg=0 THEN br END) AS a, max(CASE WHEN seg=1 THEN br END) AS b FROM (SELECT lid, seg, ((degrees(atan2(x2-x1,y2-y1)) % 180)+180) % 180 AS br FROM px_lines) q GROUP BY lid)
SELECT lid, round(a,6) AS a, round(b,6) AS b, round(90-least(abs(a-b),180-abs(a-b)),6) AS skew FROM b""")
def _(t):
    br = t.px_lines.withColumn("br", S.bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    w = br.groupBy("lid").agg(F.max(F.when(F.col("seg") == 0, F.col("br"))).alias("a"), F.max(F.when(F.col("seg") == 1, F.col("br"))).alias("b"))
    return w.select("lid", r("a").alias("a"), r("b").alias("b"), r(S.skew(F.col("a"), F.col("b"))).alias("skew"))


REG = """SELECT p_partkey AS id, CASE WHEN p_size<10 THEN 'Bankfull_Region_3_SIR2009_5144' WHEN p_size<20 THEN 'Bankfull_Region_4a_SIR2009_5144' WHEN p_size<30 THEN 'elsewhere' END AS region,
CASE WHEN p_size=40 THEN NULL ELSE CAST(p_retailprice/100-9.5 AS DOUBLE) END AS da, CASE p_type WHEN 'SMALL' THEN 'bridge' WHEN 'LARGE' THEN 'culvert' ELSE 'none' END AS kind, CAST(p_size AS DOUBLE) AS len, p_size/3.0::DOUBLE AS opening FROM part"""
REG_SPARK = REG.replace("p_size/3.0::DOUBLE", "p_size/CAST(3.0 AS DOUBLE)")
BF = """CASE WHEN da IS NOT NULL THEN coalesce(CASE region WHEN 'Bankfull_Region_3_SIR2009_5144' THEN 24.0 WHEN 'Bankfull_Region_4a_SIR2009_5144' THEN 9.1 END,16.9)::DOUBLE
*power(greatest(da*0.3861021585::DOUBLE,0.01),coalesce(CASE region WHEN 'Bankfull_Region_3_SIR2009_5144' THEN 0.292 WHEN 'Bankfull_Region_4a_SIR2009_5144' THEN 0.545 END,0.401)::DOUBLE)*0.3048::DOUBLE END"""


@query("bankfull_width", f"WITH s AS ({REG}) SELECT id, round({BF},6)::DOUBLE AS width_m FROM s")
def _(t):
    return t.sql(REG_SPARK).select("id", r(G.bankfull_width_m(F.col("region"), F.col("da"))).alias("width_m"))


@query("constriction_ratio", f"""WITH s AS ({REG}) SELECT id, round(CASE kind WHEN 'bridge' THEN len WHEN 'culvert' THEN opening END/nullif({BF},0),6)::DOUBLE AS ratio,
round(log10(greatest(len,0.1))-0.4*log10(greatest(da,0.001)),6)::DOUBLE AS log_ratio FROM s""")
def _(t):
    s = t.sql(REG_SPARK)
    width = G.bankfull_width_m(F.col("region"), F.col("da"))
    ratio = G.constriction_ratio(F.col("kind"), F.col("len"), F.col("opening"), width)
    area = F.when(F.col("da").isNotNull(), F.log10(F.greatest(F.col("da"), F.lit(0.001))))
    return s.select("id", r(ratio).alias("ratio"), r(G.log_size_ratio(F.col("len"), F.coalesce(area, F.lit(-3.0)))).alias("log_ratio"))


# Elevations from the embedding values; some samples are missing.
ELEV = "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN abs(v)<0.01 THEN NULL ELSE v*100 END) AS z FROM embeddings"


def elevations(t):
    z = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) >= 0.01, v * 100))
    return t.embeddings.select("vec_id", z.alias("z"))


@query("window_array_features", f"""WITH s AS ({ELEV}), a AS (SELECT vec_id, z[1:10] AS a FROM s), f AS (SELECT *, len(list_filter(a, lambda v: v IS NOT NULL))=10 AS full_ FROM a)
SELECT vec_id, CASE WHEN full_ THEN round(list_avg(a),6) END AS w_mean, CASE WHEN full_ THEN round(list_max(a),7) END AS w_max, CAST(CASE WHEN full_ THEN [90,150,210,270,330,390,450,510,570,630][list_position(a,list_max(a))] END AS INT) AS w_argmax,
CASE WHEN full_ THEN round((-4.5::DOUBLE*a[1]-3.5*a[2]-2.5*a[3]-1.5*a[4]-0.5*a[5]+0.5*a[6]+1.5*a[7]+2.5*a[8]+3.5*a[9]+4.5*a[10])/82.5,6)::DOUBLE END AS w_slope,
round(a[1]/(abs(a[10])+0.001),6)::DOUBLE AS w_ratio_90_630, round(a[4]/(abs(a[10])+0.001),6)::DOUBLE AS w_ratio_270_630 FROM f""")
def _(t):
    a = elevations(t).select("vec_id", F.slice("z", 1, 10).alias("a"))
    out = TE.add_window_features(a, "a", "w").drop("a")
    return out.select("vec_id", r("w_max", 7).alias("w_max"), "w_argmax", *[r(c).alias(c) for c in ("w_mean", "w_slope", "w_ratio_90_630", "w_ratio_270_630")])


@query("ring_slope_roughness", f"""WITH s AS ({ELEV}), q AS (SELECT vec_id, z[1] AS n, z[2] AS s, z[3] AS e, z[4] AS w, z[1:4] AS a FROM s)
SELECT vec_id, round(coalesce(sqrt(power(abs(n-s)/200,2)+power(abs(e-w)/200,2)),abs(n-s)/200,abs(e-w)/200),6) AS slope, CASE WHEN len(list_filter(a, lambda v: v IS NOT NULL))>=2 THEN round(list_stddev_pop(a),6) END AS rough FROM q""")
def _(t):
    n, s, e, w = (F.get("z", F.lit(i)) for i in range(4))
    return elevations(t).select("vec_id", r(TE.ring_slope(n, s, e, w, 100.0)).alias("slope"), r(TE.ring_roughness(n, s, e, w)).alias("rough"))


def ring(i):
    return f"z[{2 + 8 * i}:{9 + 8 * i}]"


def at(i, d):
    return f"z[2+8*{i}+{d}]"


def mean_of(*xs):
    return f"list_avg([{', '.join(xs)}])"


PM = [mean_of(*[at(i, d) for d in (j, j + 4) for i in (2, 3, 4)]) for j in range(4)]
A_, B_ = (lambda i: at(i, "ax")), (lambda i: at(i, "(ax+4)"))
PROFILE = f"""WITH s AS ({ELEV}), p AS (SELECT vec_id, z, [{', '.join(PM)}] AS pm FROM s),
x AS (SELECT *, CASE WHEN list_min(pm) IS NULL THEN 0 ELSE list_position(pm, list_min(pm))-1 END AS ax FROM p),
h AS (SELECT *, coalesce({A_(5)},-1e9) >= coalesce({B_(5)},-1e9) AS hi, (ax+2)%4 AS rd FROM x),
u AS (SELECT *, [{', '.join(f'CASE WHEN hi THEN {A_(i)} ELSE {B_(i)} END' for i in range(6))}] AS up, [{', '.join(f'CASE WHEN hi THEN {B_(i)} ELSE {A_(i)} END' for i in range(6))}] AS dn FROM h)"""
COLS = {**{f"fd_ring_mean_{rr}": f"list_avg({ring(i)})-z[1]" for i, rr in enumerate(TE.RADII)}, **{f"fd_ring_sd_{rr}": f"list_stddev_pop({ring(i)})" for i, rr in enumerate(TE.RADII)},
        "fd_ring_min_10": f"list_min({ring(2)})-z[1]", "fd_ring_max_40": f"list_max({ring(5)})-z[1]", "fd_up_3": "up[1]-z[1]", "fd_dn_25": "dn[5]-z[1]",
        "fd_roadax_10": f"{mean_of(at(2, 'rd'), at(2, '(rd+4)'))}-z[1]", "fd_embank_15": f"z[1]-{mean_of(A_(3), B_(3))}", "fd_slope_local": "(up[3]-dn[3])/20.0",
        "fd_slope_mid": "(up[5]-dn[5])/50.0", "fd_slope_far": "(up[6]-dn[6])/80.0", "fd_slope_ratio_local_far": "((up[3]-dn[3])/20.0)/(abs((up[6]-dn[6])/80.0)+0.001)", "fd_step_dn_3_10": "dn[1]-dn[3]",
        "fd_step_dn_10_25": "dn[3]-dn[5]", "fd_step_up_3_10": "up[3]-up[1]", "fd_axis_idx": "ax", "fd_sd_all": "list_stddev_pop(z[1:49])", "fd_distinct": "len(list_distinct(list_transform(list_filter(z[1:49], lambda v: v IS NOT NULL), lambda v: round(v,2))))"}


@query("profile_features", PROFILE + f" SELECT vec_id, {', '.join(f'CASE WHEN z[1] IS NOT NULL THEN round(({v})::DOUBLE,7) END AS {k}' for k, v in COLS.items())} FROM u")
def _(t):
    out = TE.add_profile_features(elevations(t).withColumn("z", F.slice("z", 1, 49)), "z")
    return out.select("vec_id", *[r(c, 7).alias(c) for c in COLS])


@query("perched_flag", """SELECT CASE WHEN d IS NOT NULL THEN CASE WHEN d>0.25 THEN 1.0 ELSE 0.0 END END::DOUBLE AS perched, CAST(CASE WHEN d IS NULL THEN NULL WHEN d<=0 THEN 0 WHEN d<=0.25 THEN 1 ELSE 2 END AS INT) AS class, count(*) AS n
FROM (SELECT CASE WHEN drop_ft>=0 THEN drop_ft-0.5 END AS d FROM px_surveys) q GROUP BY 1,2""")
def _(t):
    d = F.when(F.col("drop_ft") >= 0, F.col("drop_ft") - 0.5)
    return t.px_surveys.groupBy(W.threshold_flag(d, 0.25).alias("perched"), W.three_classes(d, 0.0, 0.25).alias("class")).agg(F.count("*").alias("n"))


@query("unit_conversions", "SELECT p_partkey, round(p_size*0.3048::DOUBLE,6) AS m, round(p_size*0.3861021585::DOUBLE,6) AS mi2, round(p_size/12.0::DOUBLE,6) AS ft, round(p_size*900/1e6,6)::DOUBLE AS km2, round(p_size/1000.0::DOUBLE,6) AS inch FROM part")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", r(s * F.lit(G.FT_TO_M)).alias("m"), r(s * F.lit(G.KM2_TO_MI2)).alias("mi2"), r(s / F.lit(12.0)).alias("ft"), r(s * 900 / F.lit(1e6)).alias("km2"), r(s / F.lit(1000.0)).alias("inch"))


@query("recency_weight", "SELECT year(l_shipdate)::INT AS year, round(exp((year(l_shipdate)-2026)/8.0::DOUBLE),8) AS w, count(*) AS n FROM lineitem GROUP BY 1,2")
def _(t):
    y = F.year("l_shipdate")
    return t.lineitem.groupBy(y.alias("year"), r(W.recency_weight(y), 8).alias("w")).agg(F.count("*").alias("n"))


@query("density_ratio_weight", """WITH q AS (SELECT c_custkey, greatest(0.05,least(20.0,p/(1-p)*1500.0/100.0))::DOUBLE AS w FROM (SELECT c_custkey, greatest(0.001,least(0.999,abs(c_acctbal)/11000.0))::DOUBLE AS p FROM customer) z)
SELECT c_custkey, round(w/(SELECT avg(w) FROM q),6) AS weight FROM q""")
def _(t):
    p = t.customer.select("c_custkey", (F.abs("c_acctbal") / 11000.0).alias("p"))
    return W.density_ratio(p, "p", F.lit(1500.0), F.lit(100.0)).select("c_custkey", r("weight").alias("weight"))


U = "(('0x'||substr(md5('{0}:'||rid),1,8))::BIGINT/4294967296.0::DOUBLE)"


@query("inject_answer_noise", f"""WITH a AS (SELECT rid, CASE WHEN y>0.5 THEN 1.0 ELSE 0.0 END AS q, {U.format(11)} AS u, {U.format(12)} AS v FROM px_preds)
SELECT q::DOUBLE AS q, (CASE WHEN u<0.2 THEN 1-q ELSE q END)::DOUBLE AS sym, (CASE WHEN (q=1 AND v<=0.3) OR (q=0 AND v<0.05) THEN 1-q ELSE q END)::DOUBLE AS miss, count(*) AS n FROM a GROUP BY 1,2,3""")
def _(t):
    a = t.px_preds.select("rid", (F.col("y") > 0.5).cast("double").alias("q"))
    q = F.col("q")
    return a.groupBy("q", W.noisy_answer(q, "rid", 11, 0.2).alias("sym"), W.noisy_answer(q, "rid", 12, 0.3, "miss").alias("miss")).agg(F.count("*").alias("n"))


@query("link_verified", "SELECT count(CASE WHEN a>0 AND b>0 AND abs(log10(a/b))<log10(2.0) THEN 1 END) AS n_ok, count(*) AS n FROM (SELECT CASE WHEN l_linenumber=1 THEN 0.0 ELSE l_quantity END AS a, p_size::DOUBLE AS b FROM lineitem JOIN part ON p_partkey=l_partkey) q")
def _(t):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    a = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity"))
    return j.agg(F.count_if(W.link_verified(a, F.col("p_size").cast("double"))).alias("n_ok"), F.count("*").alias("n"))


@query("ambiguity_scenarios", """WITH a AS (SELECT pipe, CASE WHEN drop_ft>=0 THEN CASE WHEN drop_ft>2 THEN 1.0 ELSE 0.0 END END AS f, drop_ft BETWEEN 1 AND 3 AS u FROM px_surveys)
SELECT scenario, pipe, count(*) AS n, count(f2) AS n_known, round(avg(f2),6) AS share FROM (SELECT 'mid' AS scenario, pipe, f AS f2 FROM a UNION ALL SELECT 'no', pipe, CASE WHEN u THEN 0.0 ELSE f END FROM a
UNION ALL SELECT 'yes', pipe, CASE WHEN u THEN 1.0 ELSE f END FROM a UNION ALL SELECT 'left_out', pipe, CASE WHEN u THEN NULL ELSE f END FROM a) q GROUP BY 1,2""")
def _(t):
    f = W.threshold_flag(F.when(F.col("drop_ft") >= 0, F.col("drop_ft")), 2.0)
    s = W.ambiguity_scenarios(t.px_surveys.select("pipe", "drop_ft"), f, F.col("drop_ft").between(1, 3))
    return s.groupBy("scenario", "pipe").agg(F.count("*").alias("n"), F.count("flag").alias("n_known"), r(F.avg("flag")).alias("share"))
