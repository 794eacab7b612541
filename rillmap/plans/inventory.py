"""The federal bridge inventory: state files to waterway structures, and the join with any list of points."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.functions.geo import albers
from rillmap.functions.text import dms_to_degrees, strip_quotes, try_double
from rillmap.operators.clean import SENTINELS, digit_code, keep_when
from rillmap.operators.joins import resolve_columns
from rillmap.operators.points import match_inventory, placed
from rillmap.operators.ranking import one_of_each
from rillmap.sources.readers import state_files

# Inventory fields and the names used here.
FIELDS = {
    "STRUCTURE_NUMBER_008": "nbi_id", "LAT_016": "lat_raw", "LONG_017": "lon_raw", "SERVICE_UND_042B": "service_under",
    "RECORD_TYPE_005A": "record_type", "STRUCTURE_KIND_043A": "nbi_kind", "STRUCTURE_TYPE_043B": "nbi_type",
    "YEAR_BUILT_027": "nbi_year_built", "YEAR_RECONSTRUCTED_106": "nbi_year_recon", "STRUCTURE_LEN_MT_049": "nbi_length_m",
    "MAX_SPAN_LEN_MT_048": "nbi_max_span_m", "MAIN_UNIT_SPANS_045": "nbi_main_spans", "DEGREES_SKEW_034": "nbi_skew_deg",
    "DECK_WIDTH_MT_052": "nbi_deck_width_m", "ROADWAY_WIDTH_MT_051": "nbi_roadway_width_m", "CHANNEL_COND_061": "nbi_channel_cond",
    "CULVERT_COND_062": "nbi_culvert_cond", "SUBSTRUCTURE_COND_060": "nbi_substructure_cond", "WATERWAY_EVAL_071": "nbi_waterway_eval",
    "SCOUR_CRITICAL_113": "nbi_scour_critical", "OWNER_022": "nbi_owner", "ADT_029": "nbi_adt", "FUNCTIONAL_CLASS_026": "nbi_func_class",
    "TRAFFIC_LANES_ON_028A": "nbi_lanes", "VERT_CLR_UND_054B": "nbi_vert_clr_under_m", "LAT_UND_MT_055B": "nbi_lat_clr_under_m",
    "IMP_LEN_MT_076": "nbi_impr_len_m",
}
WATERWAY = ("5", "6", "7", "8", "9")
DIGIT_CODES = ("nbi_channel_cond", "nbi_culvert_cond", "nbi_substructure_cond", "nbi_scour_critical")
YEARS = ("nbi_year_built", "nbi_year_recon")
LENGTHS = ("nbi_length_m", "nbi_max_span_m", "nbi_deck_width_m", "nbi_roadway_width_m")


def decode(raw: DataFrame) -> DataFrame:
    """Trim, decode positions, keep waterway structures in range, turn codes and sentinels into numbers or NULL."""
    text = [c for c in raw.columns if c != "src_state"]
    df = raw.withColumns({c: strip_quotes(F.col(c)) for c in text})
    df = df.withColumns({"lat": dms_to_degrees(F.col("lat_raw"), 2), "lon": -dms_to_degrees(F.col("lon_raw"), 3)})
    df = df.where(F.col("service_under").isin(*WATERWAY) & F.col("lat").between(36, 48) & F.col("lon").between(-84, -66))
    numbers = [c for c in text if c.startswith("nbi_") and c not in ("nbi_id", *DIGIT_CODES)]
    rules = {**{c: "year" for c in YEARS}, **{c: "not_positive" for c in LENGTHS}}
    as_number = {c: keep_when(try_double(F.col(c)), SENTINELS[rules[c]](try_double(F.col(c)))) if c in rules else try_double(F.col(c)) for c in numbers}
    return df.withColumn("nbi_is_culvert", F.coalesce(F.col("nbi_type") == "19", F.lit(False)).cast("double")).withColumns(
        {**as_number, **{c: digit_code(c) for c in DIGIT_CODES}})


def load_inventory(spark: SparkSession, folder: str, states: Sequence[str], year: int = 2025) -> DataFrame:
    return decode(state_files(spark, folder, states, year, FIELDS))


def join_inventory(points: DataFrame, structures: DataFrame, pid: str, radius: float = 60.0, lat: str = "lat_nad83", lon: str = "lon_nad83",
                   mutual_only: bool = True, keep_id: bool = False) -> DataFrame:
    """Every point with the nbi_* columns of its match within ``radius`` metres, ``nbi_matched`` and ``nbi_dist_m``."""
    resolve_columns(points.columns, {"pid": pid, "lat": lat, "lon": lon})
    px, py = albers(F.col(lon), F.col(lat))
    sx, sy = albers(F.col("lon"), F.col("lat"))
    keep = [c for c in structures.columns if c.startswith("nbi_") and c != "nbi_id"]
    # a structure number is unique inside a state only
    s = structures.select(F.concat_ws("|", F.coalesce("src_state", F.lit("")), "nbi_id").alias("_sid"), "nbi_id", *keep, sx.alias("_sx"), sy.alias("_sy"))
    s = one_of_each(s, "_sid", ["_sx", "_sy", *[c for c in s.columns if c not in ("_sid", "_sx", "_sy")]], placed("_sx", "_sy"))
    m = match_inventory(points.withColumns({"_x": px, "_y": py}), s, pid, "_sid", radius, mutual_only, ("_x", "_y"), ("_sx", "_sy"))
    out = m.withColumnsRenamed({"matched": "nbi_matched", "dist": "nbi_dist_m", "nbi_id": "nbi_structure_number"}).drop("_sid", "_x", "_y")
    return out if keep_id else out.drop("nbi_structure_number")
