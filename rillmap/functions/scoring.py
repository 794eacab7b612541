"""The published 2016 aquatic passability score as column expressions: component curves, category scores, weighted mean."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Component weights of the published scoring scheme.
WEIGHTS = {
    "outlet_drop": 0.161, "physical_barriers": 0.135, "constriction": 0.090, "inlet_grade": 0.088, "water_depth": 0.082,
    "water_velocity": 0.080, "scour_pool": 0.071, "substrate_match": 0.070, "substrate_coverage": 0.057, "openness": 0.052,
    "height": 0.045, "outlet_armoring": 0.037, "internal_structures": 0.032,
}

# Component, survey column, score of each category (None: no score), score of any other category.
CATEGORIES: dict[str, tuple[str, dict[str, float | None], float | None]] = {
    "constriction": ("Crossing_Span", {
        "severe": 0.0, "moderate": 0.5, "spans only bankfull/active channel": 0.9, "spans only bankfull": 0.9,
        "spans full channel & banks": 1.0, "spans full channel and banks": 1.0, "unknown": 0.5, "no data": None}, None),
    "inlet_grade": ("Inlet_Grade", {
        "at stream grade": 1.0, "inlet drop": 0.0, "perched": 0.0, "clogged/collapsed/submerged": 1.0, "clogged": 1.0, "unknown": 1.0}, 1.0),
    "internal_structures": ("Internal_Structure", {"none": 1.0, "baffles/weirs": 0.0, "supports": 0.8, "other": 1.0, "no data": 1.0}, 1.0),
    "outlet_armoring": ("Armoring", {"extensive": 0.0, "not extensive": 0.5, "none": 1.0}, 1.0),
    "physical_barriers": ("Barrier_Severity", {"none": 1.0, "minor": 0.8, "moderate": 0.5, "severe": 0.0}, 1.0),
    "scour_pool": ("Scour_Pool", {"large": 0.0, "small": 0.8, "none": 1.0, "unknown": 1.0, "no data": None}, 1.0),
    "substrate_coverage": ("Substrate_Continuous", {"none": 0.0, "25%": 0.3, "50%": 0.5, "75%": 0.7, "100%": 1.0, "unknown": None}, None),
    "substrate_match": ("Structure_Substrate_Matches_Stream", {
        "none": 0.0, "not appropriate": 0.25, "contrasting": 0.75, "comparable": 1.0, "unknown": None}, None),
    "water_depth": ("Water_Depth_Matches_Stream", {
        "yes": 1.0, "comparable": 1.0, "no-shallower": 0.0, "no-deeper": 0.5, "dry": 1.0, "unknown": None}, None),
    "water_velocity": ("Water_Velocity", {
        "yes": 1.0, "comparable": 1.0, "no-faster": 0.0, "no-slower": 0.5, "dry": 1.0, "unknown": None}, None),
}


def _at_least_zero(x: Column) -> Column:
    x = x.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def openness_score(feet: Column) -> Column:
    """(1 - e^(-k x (1-d)))^(1/(1-d)) with k = 15, d = 0.62."""
    return F.pow(1.0 - F.exp(-15.0 * _at_least_zero(feet) * (1.0 - 0.62)), F.lit(1.0 / (1.0 - 0.62)))


def height_score(feet: Column) -> Column:
    """min(a x^2 / (b^2 + x^2), 1) with a = 1.1, b = 2.2."""
    x = _at_least_zero(feet)
    s = 1.1 * x * x / (2.2 * 2.2 + x * x)
    return F.when(x.isNotNull(), F.least(s, F.lit(1.0)))


def outlet_drop_score(feet: Column) -> Column:
    """1 - a x^2 / (b^2 + x^2), clipped, with a = 1.029412, b = 0.51449575."""
    x = _at_least_zero(feet)
    s = 1.0 - 1.029412 * x * x / (0.51449575 * 0.51449575 + x * x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def category_score(text: Column, scores: dict[str, float | None], default: float | None, none_is_null: bool = False) -> Column:
    """Score of a category; NULL text stays NULL, unlisted text gets the default."""
    key = F.lower(F.trim(text))
    if none_is_null:
        key = F.nullif(key, F.lit("none"))
    known = F.create_map(*[F.lit(x).cast("double") if i % 2 else F.lit(x) for kv in scores.items() for i, x in enumerate(kv)])
    return F.when(key.isNull(), None).when(F.map_contains_key(known, key), F.try_element_at(known, key)).otherwise(F.lit(default).cast("double"))


def weighted_composite(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are present; 0 if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    return F.when(weight > 0, total / F.nullif(weight, F.lit(0.0))).otherwise(0.0)


def add_passability(df: DataFrame, none_is_null: bool = False) -> DataFrame:
    """Add one column per component, ``composite`` and ``final``.

    Openness and height use the outlet column if the table has it, else the inlet one; the drop to the stream bottom stands
    in row by row where the drop to the water surface is missing.
    """
    have = set(df.columns)
    pick = lambda a, b: F.col(a) if a in have else F.col(b)
    drop = F.col("Outlet_Drop_To_Water_Surface").try_cast("double")
    if "Outlet_Drop_To_Stream_Bottom" in have:
        drop = F.coalesce(drop, F.col("Outlet_Drop_To_Stream_Bottom").try_cast("double"))
    comp = {"openness": openness_score(pick("Outlet_Openness", "Inlet_Openness")), "height": height_score(pick("Outlet_Height", "Inlet_Height")),
            "outlet_drop": outlet_drop_score(drop)}
    comp |= {name: category_score(F.col(col), scores, default, none_is_null) for name, (col, scores, default) in CATEGORIES.items()}
    out = df.withColumns(comp).withColumn("composite", weighted_composite([(F.col(c), w) for c, w in WEIGHTS.items()]))
    final = F.least(F.col("composite"), F.coalesce(F.col("outlet_drop"), F.lit(1.0)))
    return out.withColumn("final", F.greatest(F.lit(0.0), F.least(F.lit(1.0), final)))
