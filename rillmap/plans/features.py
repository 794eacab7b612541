"""Feature tables: chains of attachers over points, each a ``DataFrame -> DataFrame`` step in one plan."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.functions import geo as G
from rillmap.functions import text as X
from rillmap.functions.weights import log10_clipped
from rillmap.operators import clean as C
from rillmap.operators import joins as J
from rillmap.operators import points as P
from rillmap.operators import shapes as S
from rillmap.operators.ranking import one_of_each

Step = Callable[[DataFrame], DataFrame]

# Catchment measures, the feature each goes to; several measures of one feature are summed.
CATCHMENT = {
    "precip8110": "sc_precip_mm", "runoff": "sc_runoff_mm", "bfi": "sc_baseflow_idx", "rddens": "sc_road_density",
    "rdcrs": "sc_road_stream_crossing_density", "damdens": "sc_dam_density", "popden2010": "sc_pop_density", "rckdep": "sc_bedrock_depth_cm",
    "perm": "sc_soil_perm", "wetindex": "sc_wetness_index", "pctimp2019": "sc_pct_impervious", "pctdecid2019": "sc_pct_forest",
    "pctconif2019": "sc_pct_forest", "pctmxfst2019": "sc_pct_forest", "pctwdwet2019": "sc_pct_wetland", "pcthbwet2019": "sc_pct_wetland",
    "pctcrop2019": "sc_pct_agriculture", "pcthay2019": "sc_pct_agriculture",
}
LOCAL = ("rddens", "rdcrs", "rckdep", "perm", "wetindex", "pctimp2019", "pctdecid2019", "pctconif2019", "pctmxfst2019", "pctwdwet2019",
         "pcthbwet2019", "pctcrop2019", "pcthay2019")
DITCHES = ("ditch", "drain")
NOW = 2026


def catchment_features(df: DataFrame, key: str) -> DataFrame:
    """Catchment records (``*ws`` and ``*cat`` columns) to features; a summed feature is NULL only if all its parts are."""
    def group(measures: Sequence[str], end: str, tail: str) -> dict[str, Column]:
        parts: dict[str, list[Column]] = {}
        for m in measures:
            parts.setdefault(CATCHMENT[m] + tail, []).append(F.col(m + end) if m + end in df.columns else F.lit(None).cast("double"))
        return {name: C.sum_parts(cols) if len(cols) > 1 else cols[0] for name, cols in parts.items()}

    area = {n: F.col(c) for n, c in (("sc_watershed_area_km2", "wsareasqkm"), ("sc_local_catchment_area_km2", "catareasqkm")) if c in df.columns}
    cols = {**area, **group(list(CATCHMENT), "ws", ""), **group(LOCAL, "cat", "_local")}
    return df.select(key, *[c.alias(n) for n, c in cols.items()])


def flow_attributes(vaa: DataFrame) -> DataFrame:
    """Network attributes per reach: logs, sentinels as NULL, and the slope of the next reaches down and up."""
    one = J.union_distinct([vaa], "comid", ["hydroseq"])
    one = one.withColumn("slope", C.keep_when(F.col("slope"), F.col("slope") >= 0))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    linked = J.follow_pointers(one, "hydroseq", {"vaa_slope_down": "dnhydroseq", "vaa_slope_up": "uphydroseq"}, "slope")
    return linked.select(
        "comid", F.col("slope").alias("vaa_slope"), F.col("streamorde").alias("vaa_order"), F.log10(positive("totdasqkm")).alias("vaa_log_totda"),
        F.log10(positive("totma")).alias("vaa_log_flow"), positive("roughness").alias("vaa_roughness"), positive("pathtimema").alias("vaa_travel_time"),
        F.log10(positive("arbolatesu")).alias("vaa_log_arbolate"), F.coalesce(F.col("ftype").isin("CanalDitch", "ArtificialPath", "Connector"), F.lit(False)).cast("double").alias("vaa_canal"),
        "vaa_slope_down", "vaa_slope_up", (F.col("slope") - F.col("vaa_slope_down")).alias("vaa_slope_drop_down"), (F.col("vaa_slope_up") - F.col("slope")).alias("vaa_slope_drop_up"))


# ---- attachers

def attach_county(lookup: DataFrame, left: str, right: str) -> Step:
    return lambda df: J.join_name(df, lookup, left, right, " County")


def attach_lookup(table: DataFrame, key: str, order: Sequence[str] | None = None) -> Step:
    return lambda df: J.join_lookup(df, table, key, list(order or [c for c in table.columns if c != key][:1]))


def attach_drainage_log() -> Step:
    return lambda df: df.withColumn("log_drainage_area", log10_clipped(F.col("drainage_area_km2"), 1e-3))


def backfill_drainage() -> Step:
    """The catchment table's own area where the basin polygon failed; a value that exists is never replaced."""
    return lambda df: df.withColumn("drainage_area_km2", F.coalesce("drainage_area_km2", "sc_watershed_area_km2"))


def attach_road_class(ways: DataFrame, pid: str, wid: str, radius: float = 75.0, xy=("x", "y")) -> Step:
    """Class of the nearest way, 'unknown' where there is none."""
    def step(df: DataFrame) -> DataFrame:
        tags = one_of_each(ways, wid, ("highway", "railway", "surface", "service", "lanes"))
        near = S.nearest_line(df, ways, pid, wid, radius, xy=xy).join(tags, wid)
        cls = near.select(pid, X.classify_road(*[F.col(c) for c in ("highway", "railway", "surface", "service", "lanes")]).alias("road_class"))
        return df.join(cls, pid, "left").withColumn("road_class", F.coalesce("road_class", F.lit("unknown")))
    return step


def attach_traffic(segments: DataFrame, pid: str, sid: str, volume: str, radius: float = 200.0, xy=("x", "y")) -> Step:
    def step(df: DataFrame) -> DataFrame:
        volumes = segments.groupBy(sid).agg(F.max(volume).alias("aadt"))
        near = S.nearest_line(df, segments, pid, sid, radius, xy=xy).join(volumes, sid).select(pid, "aadt")
        return df.join(near, pid, "left").withColumn("log_aadt", log10_clipped(F.col("aadt"), 1.0))
    return step


def attach_ecoregion(edges: DataFrame, pid: str, gid: str, band: float, name: str = "ecoregion", xy=("x", "y")) -> Step:
    def step(df: DataFrame) -> DataFrame:
        tagged = S.point_in_polygon(df, edges, pid, gid, band, xy).withColumnRenamed(gid, name)
        return df.join(tagged, pid, "left").withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("unknown")))
    return step


def attach_structures(structs: DataFrame, pid: str, sid: str, radius: float = 100.0, xy=("x", "y"), txy=("sx", "sy")) -> Step:
    """Nearest bridge or large culvert: ages, sizes in metres, NULL for unmatched numbers and 'none' for categories."""
    def step(df: DataFrame) -> DataFrame:
        near = P.nearest(df, structs, pid, sid, radius, xy, txy).join(structs, sid)
        f = near.select(
            pid, (F.lit(NOW) - F.col("year_built")).alias("structure_age_yr"), F.when(F.col("condition") > 0, F.col("condition")).alias("structure_condition"),
            (F.col("length_ft") * F.lit(G.FT_TO_M)).alias("structure_length_m"), (F.col("width_ft") * F.lit(G.FT_TO_M)).alias("structure_opening_width_m"),
            F.when(F.col("is_bridge"), "bridge").otherwise("culvert").alias("structure_is_bridge"), X.strip_code_label(F.col("type")).alias("structure_type"))
        return df.join(f, pid, "left").withColumns({c: F.coalesce(c, F.lit("none")) for c in ("structure_is_bridge", "structure_type")})
    return step


def attach_constriction(region: str = "region_name") -> Step:
    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("bankfull_width_m", G.bankfull_width_m(F.col(region), F.col("drainage_area_km2")))
        return df.withColumn("constriction_ratio", G.constriction_ratio(F.col("structure_is_bridge"), F.col("structure_length_m"), F.col("structure_opening_width_m"), F.col("bankfull_width_m")))
    return step


def attach_precipitation(grids: dict[str, DataFrame], x0: float, y0: float, size: float, rows: int, nodata: float, xy=("x", "y")) -> Step:
    """Cell values in inches (from thousandths) of each grid, and the ratio of the first two."""
    def step(df: DataFrame) -> DataFrame:
        for name, cells in grids.items():
            df = S.raster_lookup(df, cells, x0, y0, size, rows, nodata, 1000.0, name, xy)
        names = list(grids)
        if len(names) >= 2:
            df = df.withColumn("precip_flashiness_ratio", F.col(names[0]) / F.when(F.col(names[1]) > 0, F.col(names[1])))
        return df
    return step


NEEDS = {"streamcat": {"drainage"}, "vaa": {"drainage"}, "constriction": {"structures", "drainage"}}


def build_predictor_table(df: DataFrame, steps: dict[str, Step], do: Sequence[str]) -> DataFrame:
    """Run the chosen steps in the given order; a step whose inputs are switched off is refused."""
    for name in do:
        lacking = NEEDS.get(name, set()) - set(do)
        if lacking:
            raise ValueError(f"{name} requires {', '.join(sorted(lacking))}")
    for name in [s for s in steps if s in do]:
        df = df.transform(steps[name])
    return df


def match_rates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Share of rows that each step found something for: (feature, share)."""
    wide = df.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in conditions.items()])
    return wide.unpivot([], list(conditions), "feature", "share")


# ---- several states

def match_ways(df: DataFrame, ways: DataFrame, pid: str, wid: str, radius: float = 25.0, xy=("x", "y")) -> DataFrame:
    """Distance to the nearest way of each structure kind, attributes of the nearest road bridge, and a flag per kind.

    ``ways`` is a segment table with ``kind`` and the tag columns of its way; all kinds share one join.
    """
    near = S.nearest_line(df, ways, pid, wid, radius, "kind", xy)
    kinds = ("road_bridge", "road_culvert", "stream_culvert")
    dist = near.groupBy(pid).agg(*[F.min(F.when(F.col("kind") == k, F.col("dist"))).alias(f"osm_{k}_dist_m") for k in kinds])
    tags = one_of_each(ways, wid, ("highway", "lanes", "maxspeed", "layer", "named", "bridge", "structure"))
    b = near.where(F.col("kind") == "road_bridge").join(tags, wid).select(
        pid, X.lookup(F.col("highway"), X.BRIDGE_ROAD_RANK).alias("osm_bridge_hw_rank"), X.extract_number(F.col("lanes")).alias("osm_bridge_lanes"),
        X.extract_number(F.col("maxspeed")).alias("osm_bridge_maxspeed"), X.try_double(F.col("layer")).alias("osm_bridge_layer"), F.col("named").alias("osm_bridge_is_named"),
        X.culvert_like(F.col("bridge"), F.col("structure")).alias("osm_bridge_is_culvertlike"))
    out = df.join(dist, pid, "left").join(b, pid, "left").withColumn("osm_bridge_is_culvertlike", F.coalesce("osm_bridge_is_culvertlike", F.lit(0.0)))
    flags = {"osm_bridge_flag": "road_bridge", "osm_road_culvert_flag": "road_culvert", "osm_stream_culvert_flag": "stream_culvert"}
    return out.withColumns({f: F.col(f"osm_{k}_dist_m").isNotNull().cast("double") for f, k in flags.items()})


def way_context(df: DataFrame, roads: DataFrame, water: DataFrame, pid: str, rid: str, wid: str, radius: float = 30.0, xy=("x", "y")) -> DataFrame:
    """Nearest road and waterway of each point with their tags, and the angle at which they meet."""
    r = S.nearest_line(df, roads, pid, rid, radius, xy=xy).drop("dist")
    w = S.nearest_line(df, water, pid, wid, radius, xy=xy).drop("dist")
    rt = one_of_each(roads, rid, ("highway", "surface", "lanes", "maxspeed", "oneway"))
    wt = one_of_each(water, wid, ("waterway", "intermittent", "named"))
    paved = F.when(F.col("surface").isin(*X.PAVED), 1.0).when(F.col("surface").isin(*X.UNPAVED), 0.0)
    rf = r.join(rt, rid).select(pid, F.lit(1.0).alias("osm_road_found"), X.lookup(F.col("highway"), X.ROAD_RANK).alias("osm_road_rank"), paved.alias("osm_road_paved"),
                                X.extract_number(F.col("lanes")).alias("osm_road_lanes"), X.extract_number(F.col("maxspeed")).alias("osm_road_maxspeed"),
                                F.coalesce(F.col("oneway").isin("yes", "1", "true"), F.lit(False)).cast("double").alias("osm_road_oneway"))
    wf = w.join(wt, wid).select(pid, F.lit(1.0).alias("osm_water_found"), X.lookup(F.col("waterway"), X.WATER_KIND).alias("osm_water_kind"),
                                F.coalesce(F.col("waterway").isin(*DITCHES), F.lit(False)).cast("double").alias("osm_water_ditchlike"),
                                (F.coalesce(F.col("intermittent"), F.lit("no")) == "yes").cast("double").alias("osm_water_intermittent"), F.col("named").alias("osm_water_named"))
    rb = S.line_bearing(df, r, S.measure_segments(roads, rid), pid, rid, 15.0, xy).withColumnRenamed("bearing", "_rb")
    wb = S.line_bearing(df, w, S.measure_segments(water, wid), pid, wid, 15.0, xy).withColumnRenamed("bearing", "_wb")
    angle = rb.join(wb, pid).select(pid, S.skew(F.col("_rb"), F.col("_wb")).alias("osm_skew_deg"))
    out = df.join(rf, pid, "left").join(wf, pid, "left").join(angle, pid, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("osm_road_found", "osm_water_found")})


def build_multi(df: DataFrame, pid: str, states: DataFrame, basins: DataFrame, structures: DataFrame, sid: str, radius: float, band: float,
                logs: Sequence[str] = (), ways: tuple[DataFrame, str, float] | None = None, xy=("x", "y"), txy=("sx", "sy")) -> DataFrame:
    """State and basin tags (a point outside all basins gets the nearest one), code prefixes, logs, inventory and way matches."""
    spots = df.select(pid, *xy)     # each search starts from the positions alone, not from the table built so far
    state = S.point_in_polygon(spots, states, pid, "state", band, xy)
    basin = S.tag_polygon(spots, basins, pid, "huc8", band, xy, fallback=True).drop(*xy)
    match = P.match_inventory(spots, structures, pid, sid, radius, True, xy, txy).drop(*xy)
    out = df.join(state, pid, "left").join(basin, pid, "left").join(match, pid, "left")
    out = out.withColumnsRenamed({"matched": "nbi_matched", "dist": "nbi_dist_m"})
    out = out.withColumns({"huc6": X.code_prefix(F.col("huc8"), 6), "huc4": X.code_prefix(F.col("huc8"), 4), **{f"log_{c}": log10_clipped(F.col(c), 1.0) for c in logs}})
    if ways:
        out = out.join(match_ways(spots, ways[0], pid, ways[1], ways[2], xy).drop(*xy), pid, "left")
    return out


def fold_safe_neighbours(df: DataFrame, pid: str, label: str, flag: str, group: str, fold: str, folds: Sequence[int], kmax: int = 80, ball: float = 5000.0, xy=("x", "y")) -> DataFrame:
    """Neighbour features per held-out fold: (held, pid, ...). Labels come from the other folds only; training rows do not
    see their own group, held-out rows see all training rows."""
    held = F.array(*[F.lit(k) for k in folds])
    q = df.withColumn("held", F.explode(held))
    ref = q.where(F.col(fold) != F.col("held")).select("held", F.col(pid).alias("_rid"), F.col(xy[0]).alias("_rx"), F.col(xy[1]).alias("_ry"))
    near = P.k_nearest(q, ref, pid, "_rid", kmax, xy, ("_rx", "_ry"), ["held"])      # all folds in one search
    r = df.select(F.col(pid).alias("_rid"), F.col(label).alias("_label"), F.col(flag).cast("double").alias("_flag"), F.col(group).alias("_rg"))
    own = df.select(pid, F.col(group).alias("_qg"), F.col(fold).alias("_fold"))
    near = near.join(r, "_rid").join(own, pid).where(F.col("dist") > 0.5).where((F.col("_fold") == F.col("held")) | (F.col("_rg") != F.col("_qg")))
    return P.summarise_neighbours(near, ["held", pid], ball)
