"""Queries for scans, sinks and streams. Each lands a given table as files with Spark and reads it back through the operator."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmap.catalog.base import query
from rillmap.operators import joins as J
from rillmap.operators import shapes as S
from rillmap.plans import inventory as INV
from rillmap.session import scratch_path
from rillmap.sources import commits as CO
from rillmap.sources import readers as RD
from rillmap.sources import writers as WR
from rillmap.streaming import ingest as IN


def text_columns(df):
    return df.select(*[F.col(c).cast("string").alias(f" {c} ") for c in df.columns])


@query("scan_csv_strings", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(t):
    path = scratch_path(t.spark, "csv")
    text_columns(t.part.select("p_partkey", "p_name", "p_brand", "p_size")).write.option("header", True).csv(path)
    return RD.csv_strings(t.spark, path)


# Three state files with every structure of the part table: positions as degree text, some of them invalid, sentinel values.
NBI = """SELECT p_partkey, CASE WHEN p_size<20 THEN 'NY' WHEN p_size<40 THEN 'PA' ELSE 'CT' END AS st, concat('''S', CAST(p_partkey AS STRING), ' ''') AS STRUCTURE_NUMBER_008,
concat(CAST(38+p_size%10 AS STRING), lpad(CAST(p_partkey%62 AS STRING),2,'0'), lpad(CAST((p_partkey*37)%6400 AS STRING),4,'0')) AS LAT_016,
concat('0', CAST(67+p_size%20 AS STRING), lpad(CAST((p_partkey*7)%60 AS STRING),2,'0'), lpad(CAST((p_partkey*91)%6000 AS STRING),4,'0')) AS LONG_017,
CASE WHEN p_type='SMALL' THEN '1' WHEN p_type='LARGE' THEN '''5''' ELSE '8' END AS SERVICE_UND_042B, CASE WHEN p_size=30 THEN '0' ELSE CAST(1900+p_size AS STRING) END AS YEAR_BUILT_027,
CASE WHEN p_size=12 THEN '0' ELSE CAST(p_size AS STRING) END AS STRUCTURE_LEN_MT_049, CASE WHEN p_size>45 THEN 'N' ELSE substr(CAST(p_size AS STRING),1,1) END AS CHANNEL_COND_061, CASE WHEN p_brand='Brand#1' THEN '19' ELSE '02' END AS STRUCTURE_TYPE_043B FROM part"""


def land_inventory(t):
    folder = scratch_path(t.spark, "nbi")
    rows = t.sql(NBI)
    full = rows.select("st", *[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in INV.FIELDS])
    for st in ("NY", "PA", "CT"):
        full.where(F.col("st") == st).drop("st").coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/parts/{st}")
    return folder


def state_named(t, folder):
    """The reader expects one file per state, named by state and year; Hadoop renames what Spark wrote."""
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for st in ("NY", "PA", "CT"):
        part = fs.globStatus(path(f"{folder}/parts/{st}/part-*"))[0].getPath()
        fs.rename(part, path(f"{folder}/{st}25.txt"))
    return folder


LAT = "TRY_CAST(substr(LAT_016,1,2) AS DOUBLE)+TRY_CAST(substr(LAT_016,3,2) AS DOUBLE)/60+TRY_CAST(substr(LAT_016,5) AS DOUBLE)/100/3600"
LON = "TRY_CAST(substr(LONG_017,1,3) AS DOUBLE)+TRY_CAST(substr(LONG_017,4,2) AS DOUBLE)/60+TRY_CAST(substr(LONG_017,6) AS DOUBLE)/100/3600"


@query("scan_partitioned_pruned", f"WITH s AS ({NBI}) SELECT st AS src_state, count(*) AS n, count(DISTINCT STRUCTURE_NUMBER_008) AS ids FROM s GROUP BY st")
def _(t):
    folder = state_named(t, land_inventory(t))
    raw = RD.state_files(t.spark, folder, ["NY", "PA", "CT"], 2025, {"STRUCTURE_NUMBER_008": "nbi_id"})
    return raw.groupBy("src_state").agg(F.count("*").alias("n"), F.count_distinct("nbi_id").alias("ids"))


@query("load_inventory", f"""WITH s AS ({NBI}), d AS (SELECT *, {LAT} AS lat, -({LON}) AS lon FROM s WHERE TRY_CAST(substr(LAT_016,3,2) AS DOUBLE)<60 AND TRY_CAST(substr(LAT_016,5) AS DOUBLE)/100<60 AND TRY_CAST(substr(LONG_017,6) AS DOUBLE)/100<60)
SELECT concat('S',p_partkey) AS nbi_id, st AS src_state, round(lat,8) AS lat, round(lon,8) AS lon, CASE WHEN YEAR_BUILT_027<>'0' THEN CAST(YEAR_BUILT_027 AS DOUBLE) END AS nbi_year_built,
CASE WHEN STRUCTURE_LEN_MT_049<>'0' THEN CAST(STRUCTURE_LEN_MT_049 AS DOUBLE) END AS nbi_length_m, TRY_CAST(CHANNEL_COND_061 AS DOUBLE) AS nbi_channel_cond, CASE WHEN STRUCTURE_TYPE_043B='19' THEN 1.0 ELSE 0.0 END::DOUBLE AS nbi_is_culvert
FROM d WHERE SERVICE_UND_042B<>'1' AND lat BETWEEN 36 AND 48 AND lon BETWEEN -84 AND -66""")
def _(t):
    d = INV.load_inventory(t.spark, state_named(t, land_inventory(t)), ["NY", "PA", "CT"])
    return d.select("nbi_id", "src_state", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "nbi_year_built", "nbi_length_m", "nbi_channel_cond", "nbi_is_culvert")


@query("scan_by_format", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, length(lang) AS k FROM documents")
def _(t):
    path = scratch_path(t.spark, "cp1252")
    marked = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("n_chars").cast("string").alias("n_chars"), F.lit("café").alias("mark"))
    marked.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}.csv")
    WR.write_table(marked, path)
    both = RD.read_table(t.spark, f"{path}.csv").intersect(RD.read_table(t.spark, f"{path}.parquet"))
    return both.where("mark = 'café'").select("doc_id", "lang", "n_chars", F.length("lang").cast("bigint").alias("k"))


@query("scan_parquet_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return RD.parquet_columns(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("scan_parquet_in_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT')")
def _(t):
    ids = t.orders.where("o_orderpriority='1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return RD.parquet_in(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], "l_orderkey", ids)


@query("scan_jsonl_records", "SELECT event_id AS comid, value AS sc_precipws, CASE WHEN event_type='click' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS sc_wsarea FROM events WHERE event_type<>'error'")
def _(t):
    path = scratch_path(t.spark, "jsonl")
    area = F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("user_id").cast("string"))
    t.events.select(F.col("event_id").alias("comid"), F.when(F.col("event_type") == "error", "1").alias("_empty"), F.col("value").alias("precipws"), area.alias("wsareasqkm"), F.lit("x").alias("other")).write.json(path)
    return RD.jsonl_records(t.spark, path, "comid", ["precipws", "wsareasqkm"], rename={"wsareasqkm": "wsarea"})


@query("explode_nested_lines", """SELECT lid AS comid, CAST(lid%7 AS INT) AS "order", 0 AS path_no, CAST(seg+1 AS INT) AS seg, x1, y1, x2, y2 FROM px_lines""")
def _(t):
    path = scratch_path(t.spark, "lines")
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    seg = t.px_lines.groupBy("lid").agg(F.min_by(pt("x1", "y1"), "seg").alias("a"), F.min_by(pt("x2", "y2"), "seg").alias("b"), F.max_by(pt("x2", "y2"), "seg").alias("c"))
    paths = F.array(F.array("a", "b", "c"), F.array("a"))           # the second path has one point and goes
    line = F.struct(F.col("lid").alias("comid"), (F.col("lid") % 7).cast("int").alias("order"), F.lit(1).alias("ftype"), F.lit(1).cast("bigint").alias("hydroseq"), paths.alias("paths"))
    tiles = seg.select(line.alias("line"), F.explode(F.array(F.floor(F.col("lid") / 40), -1 - F.floor((F.col("lid") + 20) / 40))).alias("tx"))     # each line in two tiles of some 40 lines
    tiles.groupBy("tx").agg(F.collect_list("line").alias("lines")).select(F.array("tx", "tx").alias("tile"), "lines").write.json(path)
    return RD.points_to_segments(RD.nested_lines(t.spark, path), ["comid", "order", "path_no"])


@query("explode_tagged_elements", """SELECT event_id AS id, CASE WHEN event_type='view' THEN 'road_bridge' WHEN event_type IN ('click','signup') THEN 'road_culvert' ELSE 'stream_culvert' END AS osm_kind,
CASE WHEN event_type IN ('view','click','signup') THEN 'primary' END AS osm_highway, CASE WHEN event_type='error' THEN 1.0 ELSE 0.0 END::DOUBLE AS osm_has_name, 2 AS n_pts FROM events""")
def _(t):
    path = scratch_path(t.spark, "elements")
    e = F.col("event_type")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(e.isin("view", "click", "signup"), "primary"), F.lit("bridge"), F.when(e == "view", "yes").when(e == "click", "no"),
                                     F.lit("name"), F.when(e == "error", "n")), lambda k, v: v.isNotNull())
    geom = F.array(F.struct(F.lit(-75.0).alias("lon"), F.lit(42.0).alias("lat")), F.struct(F.lit(-75.1).alias("lon"), F.lit(42.0).alias("lat")))
    doc = t.events.select("user_id", F.struct(F.col("event_id").alias("id"), tags.alias("tags"), geom.alias("geometry")).alias("el"))
    docs = doc.groupBy(F.floor(F.col("el.id") / 400)).agg(F.collect_list("el").alias("elements")).select("elements")
    docs.unionByName(docs).write.json(path)                         # every way in two overlapping documents
    w = RD.tagged_elements(t.spark, path)
    return w.select("id", "osm_kind", "osm_highway", "osm_has_name", F.size("geometry").alias("n_pts"))


@query("scan_feature_pages", "SELECT c_custkey AS code, c_mktsegment AS kind, round(c_acctbal,2) AS _geom_x, CAST(c_nationkey AS DOUBLE) AS _geom_y FROM customer")
def _(t):
    path = scratch_path(t.spark, "pages")
    feature = F.struct(F.struct(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("kind")).alias("attributes"),
                       F.struct(F.round("c_acctbal", 2).alias("x"), F.col("c_nationkey").cast("double").alias("y")).alias("geometry"))
    t.customer.select(F.floor(F.col("c_custkey") / 500).alias("page"), feature.alias("f")).groupBy("page").agg(F.collect_list("f").alias("features")).select("features").write.json(path)
    return RD.feature_pages(t.spark, path, T.StructType([T.StructField("code", T.LongType()), T.StructField("kind", T.StringType())]))


@query("scan_geojson_polygons", """SELECT CAST(gid AS VARCHAR) AS gid, CAST(s AS INT) AS seg, CASE s WHEN 1 THEN xmin WHEN 2 THEN xmax WHEN 3 THEN xmax ELSE xmin END AS x1, CASE s WHEN 1 THEN ymin WHEN 2 THEN ymin WHEN 3 THEN ymax ELSE ymax END AS y1
FROM px_polys, (VALUES (1),(2),(3),(4)) v(s)""")
def _(t):
    path = scratch_path(t.spark, "geojson")
    p = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    multi = F.col("gid") % 2 == 0
    coords = F.when(multi, F.to_json(F.array(F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    text = F.concat(F.lit('{"type":"Feature","properties":{"gid":"'), F.col("gid").cast("string"), F.lit('"},"geometry":{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), coords, F.lit("}}"))
    t.px_polys.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list(text)), F.lit("]}")).alias("v")).write.text(path)
    return S.rings_to_edges(RD.geojson_polygons(t.spark, path, "gid"), "gid", "rings").select("gid", "seg", "x1", "y1")


@query("scan_column_list", "SELECT count(l_quantity) AS n_l_quantity, count(l_tax) AS n_l_tax FROM lineitem")
def _(t):
    path = scratch_path(t.spark, "columns")
    names = [c for c in t.lineitem.columns if c in ("l_quantity", "l_tax")]
    t.spark.createDataFrame([(x,) for x in (f"  {names[0]} ", "", names[1])], "value string").coalesce(1).write.text(path)
    cols = RD.column_list(t.spark, path)
    return t.lineitem.agg(*[F.count(c).alias(f"n_{c}") for c in cols])


@query("scan_ascii_grid", "SELECT row_i, col_i, val FROM px_grid")
def _(t):
    path = scratch_path(t.spark, "grid")
    rows = t.px_grid.groupBy("row_i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_i", "val"))), lambda c: c["val"].cast("string")), " ").alias("value"))
    head = t.px_grid.agg(F.max("col_i").alias("c"), F.max("row_i").alias("r")).select(F.explode(F.array(
        F.concat(F.lit("ncols "), F.col("c") + 1), F.concat(F.lit("nrows "), F.col("r") + 1), F.lit("xllcorner 0"), F.lit("yllcorner 0"), F.lit("cellsize 400"), F.lit("NODATA_value 0"))).alias("value"))
    lines = head.select(F.lit(-1).alias("k"), "value").unionByName(rows.select(F.col("row_i").alias("k"), "value"))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    header, cells = RD.ascii_grid(t.spark, path)
    assert header["cellsize"] == 400.0
    return cells


WAYS = """SELECT event_id AS osm_id, CASE WHEN event_type IN ('view','click') THEN 'primary' END AS highway, CASE WHEN event_type='error' THEN 'stream' END AS waterway,
CASE WHEN event_type='view' THEN '"bridge"=>"yes"' WHEN event_type='click' THEN '"bridge"=>"no","tunnel"=>"culvert"' WHEN user_id>25 THEN '"tunnel"=>"culvert"' END AS other_tags FROM events"""


@query("scan_ways_filtered", f"""WITH s AS ({WAYS}) SELECT osm_id, CASE WHEN other_tags LIKE '%"bridge"=>"yes"%' THEN 'road_bridge' WHEN highway IS NOT NULL THEN 'road_culvert' ELSE 'stream_culvert' END AS osm_kind FROM s
WHERE (highway IS NOT NULL AND other_tags LIKE '%"bridge"=>%') OR ((highway IS NOT NULL OR waterway IS NOT NULL) AND other_tags LIKE '%"tunnel"=>"culvert"%')""")
def _(t):
    return RD.structure_ways(t.sql(WAYS)).select("osm_id", "osm_kind")


@query("scan_results_log", "SELECT p_type AS objective, max(p_retailprice) AS score, arg_max(p_name, row(p_retailprice, p_name)) AS params, count(*) AS n FROM part GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "log")
    log = t.part.select(F.col("p_type").alias("objective"), F.col("p_retailprice").alias("score"), F.col("p_name").alias("params"))
    log.write.json(path)
    return RD.best_results(t.spark, path, log.schema, "objective", "score", "params")


@query("resume_todo", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax<>0.0 AND l_quantity>40)")
def _(t):
    done = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_tax") == 0, -1).otherwise(F.col("l_partkey")).alias("comid"))
    return RD.resume_todo(t.orders.select("o_orderkey"), done, "o_orderkey", "comid")


@query("sink_table", "SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def _(t):
    path = scratch_path(t.spark, "sink")
    WR.write_table(t.orders.select("o_orderkey", "o_orderstatus"), path, csv=True)
    parquet = t.spark.read.parquet(f"{path}.parquet").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("o_orderkey"))
    return parquet.join(RD.csv_strings(t.spark, f"{path}.csv"), ["o_orderkey", "o_orderstatus"], "left_semi")


@query("sink_append", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    path = scratch_path(t.spark, "append")
    for row in t.orders.select("o_orderstatus").distinct().collect():            # a chunk per status
        WR.append_chunk(t.orders.where(F.col("o_orderstatus").eqNullSafe(F.lit(row[0]))).select("o_orderkey", "o_custkey"), path)
    return t.spark.read.schema("o_orderkey BIGINT, o_custkey BIGINT").json(path)


@query("sink_metrics_json", "SELECT o_orderstatus AS model, count(*) AS n, round(avg(o_totalprice),4) AS mean FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "metrics")
    m = t.orders.groupBy(F.col("o_orderstatus").alias("model")).agg(F.struct(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).alias("metrics"))
    WR.write_metrics(m, path)
    return t.spark.read.schema(m.schema).json(path).select("model", "metrics.n", "metrics.mean")


@query("materialise_once", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "derived")
    build = lambda: t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    WR.materialise_once(t.spark, path, build, ["c_nationkey"])
    return WR.materialise_once(t.spark, path, build)


@query("source_completeness", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    return RD.missing_sources(t.nation.select("n_nationkey"), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query("required_columns", "SELECT o_orderkey AS sid, o_totalprice AS price FROM orders")
def _(t):
    odd = t.orders.withColumnsRenamed({"o_orderkey": " Order Key", "o_totalprice": "TOTAL price"})
    return odd.select(*[F.col(f"`{a}`").alias(n) for a, n in J.resolve_columns(odd.columns, {"sid": "order_key", "price": "Total_Price"}, {"date": "o_absent"}).items()])


@query("incremental_ingest", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1")
def _(t):
    base = scratch_path(t.spark, "stream")
    early = F.coalesce(F.col("event_type").isin("view", "click"), F.lit(False))
    for part in (early, ~early):                                             # two landings, two runs
        t.events.where(part).write.mode("append").parquet(f"{base}/landing")
        IN.ingest_new_files(t.spark, f"{base}/landing", t.events.schema, f"{base}/sink", f"{base}/ckpt")
    return t.spark.read.parquet(f"{base}/sink").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("stream_dedupe_by_id", "SELECT event_id, value FROM events")
def _(t):
    base = scratch_path(t.spark, "dedupe")
    for _run in range(2):                                                    # the same elements land twice
        t.events.write.mode("append").parquet(f"{base}/landing")
        IN.ingest_distinct(t.spark, f"{base}/landing", t.events.schema, f"{base}/sink", f"{base}/ckpt", "event_id", ["ts"])
    return t.spark.read.parquet(f"{base}/sink").select("event_id", "value")


@query("stream_dedupe_watermark", "SELECT event_id, value FROM events")
def _(t):
    """The same events land again a minute later, within the two hours that state remembers or behind the watermark: none counts twice."""
    base = scratch_path(t.spark, "within")
    for minutes in (0, 1):
        t.events.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTE")).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{base}/landing")
        schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in t.events.schema])
        IN.ingest_within(t.spark, f"{base}/landing", schema, f"{base}/sink", f"{base}/ckpt", "event_id", "ts", "2 hours", most_runs=1)
    return CO.read_committed(t.spark, f"{base}/sink").select("event_id", "value")


@query("sink_committed", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(t):
    """A chunk per status, each appended twice, and an attempt that left rows without a record; then one run takes the place of all."""
    path = scratch_path(t.spark, "committed")
    for row in t.orders.select("o_orderstatus").distinct().collect():            # three
        chunk = t.orders.where(F.col("o_orderstatus").eqNullSafe(F.lit(row[0]))).select("o_orderkey", "o_orderstatus")
        for _attempt in range(2):
            CO.append_run(chunk, path, f"status-{row[0]}")
    t.orders.select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/rows/run=killed")
    CO.compact(t.spark, path, "all")
    return CO.read_committed(t.spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
