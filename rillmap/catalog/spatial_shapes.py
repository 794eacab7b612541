"""Queries over lines, polygons, rasters, networks and paths."""
from pyspark.sql import functions as F

from rillmap.catalog.base import query
from rillmap.operators import paths as PA
from rillmap.operators import shapes as S

T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1),0.0), 0.0::DOUBLE)))"
SEGD = f"""seg AS (SELECT p.*, l.*, {T} AS t FROM px_points p, px_lines l),
sd AS (SELECT *, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))) AS d FROM seg)"""
EDGES = """edges AS (SELECT gid, xmin AS x1, ymin AS y1, xmax AS x2, ymin AS y2 FROM px_polys UNION ALL SELECT gid, xmax, ymin, xmax, ymax FROM px_polys
UNION ALL SELECT gid, xmax, ymax, xmin, ymax FROM px_polys UNION ALL SELECT gid, xmin, ymax, xmin, ymin FROM px_polys)"""
INSIDE = "ins AS (SELECT pid, min(gid) AS gid FROM px_points JOIN px_polys ON x>=xmin AND x<xmax AND y>=ymin AND y<ymax GROUP BY pid)"
EDGED = f"""eg AS (SELECT p.*, e.*, {T} AS t FROM px_points p, edges e),
ed AS (SELECT *, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))) AS d FROM eg)"""


@query("nearest_line", f"""WITH {SEGD}, k AS (SELECT *, CASE WHEN seg=0 THEN 'head' ELSE 'tail' END AS kind FROM sd)
SELECT pid, kind, lid, round(d,6) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY pid, kind ORDER BY d, lid) AS rn FROM k WHERE d<=200.0) q WHERE rn=1""")
def _(t):
    lines = t.px_lines.withColumn("kind", F.when(F.col("seg") == 0, "head").otherwise("tail"))
    return S.nearest_line(t.px_points, lines, "pid", "lid", 200.0, "kind").select("pid", "kind", "lid", F.round("dist", 6).alias("dist_m"))


TWO = f"""{SEGD}, m AS (SELECT pid, lid, min(d) AS d FROM sd WHERE d<=500.0 GROUP BY pid, lid),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, lid) AS rn FROM m),
two AS (SELECT pid, max(CASE WHEN rn=1 THEN lid END) AS lid, max(CASE WHEN rn=1 THEN d END) AS snap, max(CASE WHEN rn=2 THEN lid END) AS lid2,
 max(CASE WHEN rn=2 THEN d END) AS snap2 FROM r WHERE rn<=2 GROUP BY pid)"""


@query("nearest_two_distinct", f"WITH {TWO} SELECT pid, lid, round(snap,6) AS snap_m, lid2, round(snap2,6) AS snap2_m FROM two")
def _(t):
    two = S.nearest_two_lines(t.px_points, t.px_lines, "pid", "lid", 500.0)
    return two.select("pid", "lid", F.round("snap", 6).alias("snap_m"), "lid2", F.round("snap2", 6).alias("snap2_m"))


@query("point_in_polygon", f"WITH {INSIDE} SELECT p.pid, gid FROM px_points p LEFT JOIN ins USING (pid)")
def _(t):
    return S.tag_polygon(t.px_points, S.boxes_to_edges(t.px_polys, "gid"), "pid", "gid", 1000.0).select("pid", "gid")


@query("polygon_nearest_fallback", f"""WITH {EDGES}, {INSIDE}, {EDGED},
nr AS (SELECT pid, gid FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, gid) AS rn FROM ed) q WHERE rn=1)
SELECT p.pid, coalesce(ins.gid, nr.gid) AS gid FROM px_points p LEFT JOIN ins USING (pid) JOIN nr ON nr.pid=p.pid""")
def _(t):
    e = S.boxes_to_edges(t.px_polys, "gid")
    return S.tag_polygon(t.px_points, e, "pid", "gid", 1000.0, fallback=True).select("pid", "gid")


@query("distance_to_boundary", f"""WITH {EDGES}, {INSIDE}, {EDGED}, near AS (SELECT pid, min(d) AS d FROM ed GROUP BY pid),
h AS (SELECT pid, count(*) AS k FROM px_points JOIN px_polys ON x>=xmin AND x<xmax AND y>=ymin AND y<ymax GROUP BY pid)
SELECT count(CASE WHEN d<=150 THEN 1 END) AS n_near, round(avg(CASE WHEN d<=150 THEN 1.0 ELSE 0.0 END),6) AS share_near,
 count(CASE WHEN k>1 THEN 1 END) AS n_multi, count(CASE WHEN k IS NULL THEN 1 END) AS n_none FROM px_points LEFT JOIN near USING (pid) LEFT JOIN h USING (pid)""")
def _(t):
    r = S.boundary_report(t.px_points, S.boxes_to_edges(t.px_polys, "gid"), "pid", "gid", 1000.0, 150.0)
    return r.select("n_near", F.round("share_near", 6).alias("share_near"), "n_multi", "n_none")


CROSS = """ab AS (SELECT a.lid, a.seg, b.lid AS b_lid, b.seg AS b_seg, a.x1, a.y1, a.x2-a.x1 AS ax, a.y2-a.y1 AS ay, b.x2-b.x1 AS bx, b.y2-b.y1 AS by_,
 b.x1-a.x1 AS sx, b.y1-a.y1 AS sy FROM px_lines a JOIN px_lines b ON a.lid<b.lid),
tu AS (SELECT *, (sx*by_-sy*bx)/nullif(ax*by_-ay*bx,0.0) AS t, (sx*ay-sy*ax)/nullif(ax*by_-ay*bx,0.0) AS u FROM ab),
cs AS (SELECT lid, seg, b_lid, b_seg, x1+t*ax AS ix, y1+t*ay AS iy FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
cr AS (SELECT lid, b_lid, arg_min(ix, (seg, b_seg)) AS ix, arg_min(iy, (seg, b_seg)) AS iy FROM cs GROUP BY lid, b_lid)"""


def crossings(t):
    return S.crossing_points(t.px_lines, t.px_lines, "lid", 500.0, F.col("lid") < F.col("b_lid"), overlaps=False)


@query("line_intersections", f"WITH {CROSS} SELECT lid, b_lid, round(ix,6) AS ix, round(iy,6) AS iy FROM cr")
def _(t):
    return crossings(t).select("lid", "b_lid", F.round("ix", 6).alias("ix"), F.round("iy", 6).alias("iy"))


@query("distance_to_network", f"""WITH {CROSS}, d AS (SELECT pid, min(sqrt((x-ix)*(x-ix)+(y-iy)*(y-iy))) AS d FROM px_points, cr GROUP BY pid)
SELECT count(*) AS n, round(avg(CASE WHEN d<=300 THEN 1.0 ELSE 0.0 END),6) AS within_300, round(avg(CASE WHEN d<=1000 THEN 1.0 ELSE 0.0 END),6) AS within_1000,
 round(avg(d),4) AS mean_m FROM d""")
def _(t):
    d = S.nearest_crossing(t.px_points, t.px_lines, "pid", "lid", 500.0, overlaps=False)
    share = lambda m: F.round(F.avg((F.col("dist") <= m).cast("double")), 6)
    return d.agg(F.count("*").alias("n"), share(300).alias("within_300"), share(1000).alias("within_1000"), F.round(F.avg("dist"), 4).alias("mean_m"))


@query("crossing_skew", f"""WITH {TWO},
ms AS (SELECT *, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) OVER (PARTITION BY lid ORDER BY seg) AS m2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM px_lines),
lk AS (SELECT pid, 1 AS w, lid FROM two UNION ALL SELECT pid, 2, lid2 FROM two WHERE lid2 IS NOT NULL),
spot AS (SELECT * FROM (SELECT lk.pid, lk.w, lk.lid, m2-len+t*len AS m, row_number() OVER (PARTITION BY lk.pid, lk.w ORDER BY d, sd.seg) AS rn
  FROM lk JOIN sd ON sd.pid=lk.pid AND sd.lid=lk.lid JOIN ms ON ms.lid=sd.lid AND ms.seg=sd.seg) q WHERE rn=1),
en AS (SELECT pid, w, spot.lid, greatest(m-15.0,0.0) AS a, least(m+15.0, (SELECT max(m2) FROM ms WHERE ms.lid=spot.lid)) AS b FROM spot),
xy AS (SELECT pid, w, arg_min(CASE WHEN a BETWEEN m2-len AND m2 THEN x1+(a-(m2-len))/len*(x2-x1) END, CASE WHEN a BETWEEN m2-len AND m2 THEN seg END) AS ax,
 arg_min(CASE WHEN a BETWEEN m2-len AND m2 THEN y1+(a-(m2-len))/len*(y2-y1) END, CASE WHEN a BETWEEN m2-len AND m2 THEN seg END) AS ay,
 arg_min(CASE WHEN b BETWEEN m2-len AND m2 THEN x1+(b-(m2-len))/len*(x2-x1) END, CASE WHEN b BETWEEN m2-len AND m2 THEN seg END) AS bx,
 arg_min(CASE WHEN b BETWEEN m2-len AND m2 THEN y1+(b-(m2-len))/len*(y2-y1) END, CASE WHEN b BETWEEN m2-len AND m2 THEN seg END) AS by_ FROM en JOIN ms ON ms.lid=en.lid GROUP BY pid, w),
br AS (SELECT pid, w, ((degrees(atan2(bx-ax, by_-ay)) % 180) + 180) % 180 AS br FROM xy)
SELECT a.pid, round(90.0 - least(abs(a.br-b.br), 180-abs(a.br-b.br)), 4) AS skew_deg FROM br a JOIN br b ON a.pid=b.pid AND a.w=1 AND b.w=2""")
def _(t):
    two = S.nearest_two_lines(t.px_points, t.px_lines, "pid", "lid", 500.0)
    m = S.measure_segments(t.px_lines, "lid")
    road = S.line_bearing(t.px_points, two.select("pid", "lid"), m, "pid", "lid", 15.0).withColumnRenamed("bearing", "_a")
    water = S.line_bearing(t.px_points, two.select("pid", F.col("lid2").alias("lid")), m, "pid", "lid", 15.0).withColumnRenamed("bearing", "_b")
    return road.join(water, "pid").select("pid", F.round(S.skew(F.col("_a"), F.col("_b")), 4).alias("skew_deg"))


@query("vertex_to_segment", """WITH v AS (SELECT lid, seg AS pos, x1 AS x, y1 AS y FROM px_lines UNION ALL SELECT lid, seg+1, x2, y2 FROM px_lines WHERE seg=1),
s AS (SELECT lid, pos AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY lid ORDER BY pos))
SELECT lid, seg, x2, y2, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) OVER (PARTITION BY lid ORDER BY seg),6) AS upto_m FROM s WHERE x2 IS NOT NULL""")
def _(t):
    tail = t.px_lines.where("seg = 1").select("lid", (F.col("seg") + 1).alias("pos"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    v = t.px_lines.select("lid", F.col("seg").alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(tail)
    return S.vertices_to_segments(v, "lid", "pos").select("lid", "seg", "x2", "y2", F.round("m2", 6).alias("upto_m"))


@query("raster_lookup", """SELECT pid, CASE WHEN val<>0 THEN round(val/1000.0,6) END::DOUBLE AS value FROM px_points LEFT JOIN px_grid
ON col_i=CAST(floor(x/400.0) AS INT) AND row_i=CAST(floor((50*400.0-y)/400.0) AS INT)""")
def _(t):
    out = S.raster_lookup(t.px_points, t.px_grid, 0.0, 0.0, 400.0, 50, 0.0, 1000.0)
    return out.select("pid", F.round("value", 6).alias("value"))


@query("path_prev_next", """SELECT event_id, lag(score) OVER w AS prev, lead(score) OVER w AS next FROM px_path WINDOW w AS (PARTITION BY path ORDER BY pos, event_id)""")
def _(t):
    return PA.carry(t.px_path, "path", ["pos", "event_id"], F.col("score")).select("event_id", "prev", "next")


@query("asof_path_neighbours", """WITH r AS (SELECT * FROM px_path WHERE is_ref),
dn AS (SELECT a.event_id, arg_max(r.score, (r.pos, -r.event_id)) AS down_label, max(r.pos) AS down_pos FROM px_path a JOIN r ON r.path=a.path AND r.pos<a.pos GROUP BY 1),
up AS (SELECT a.event_id, arg_min(r.score, (r.pos, r.event_id)) AS up_label, min(r.pos) AS up_pos FROM px_path a JOIN r ON r.path=a.path AND r.pos>=a.pos AND r.event_id<>a.event_id GROUP BY 1),
m AS (SELECT a.event_id, avg(r.score) AS path_mean, count(*) AS path_n FROM px_path a JOIN r ON r.path=a.path AND r.event_id<>a.event_id GROUP BY 1)
SELECT a.event_id, down_label, down_pos, up_label, up_pos, round(path_mean,6) AS path_mean, coalesce(path_n,0) AS path_n
FROM px_path a LEFT JOIN dn USING (event_id) LEFT JOIN up USING (event_id) LEFT JOIN m USING (event_id)""")
def _(t):
    out = PA.asof_path(t.px_path, "path", "pos", "event_id", "score", "is_ref")
    return out.select("event_id", "down_label", "down_pos", "up_label", "up_pos", F.round("path_mean", 6).alias("path_mean"), "path_n")
