"""Position and size expressions on longitude / latitude and metres."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillmap.functions.text import lookup

EARTH_KM = 6371.0088
# GRS80 Albers equal-area for the contiguous US (parallels 29.5 and 45.5, origin 23 / -96).
A, E2 = 6378137.0, 0.006694380022900787
N, C, RHO0 = 0.6029027690657601, 1.3491820315609704, 9928937.004248781
# Regional bankfull width regression, feet = a * square miles ^ b.
BANKFULL = {
    "Bankfull_Regions_1_and_2_SIR2009_5144": (21.5, 0.362), "Bankfull_Region_3_SIR2009_5144": (24.0, 0.292),
    "Bankfull_Region_4_SIR2009_5144": (17.1, 0.460), "Bankfull_Region_4a_SIR2009_5144": (9.1, 0.545),
    "Bankfull_Region_5_SIR2009_5144": (13.5, 0.449), "Bankfull_Region_6_SIR2009_5144": (16.9, 0.419),
    "Bankfull_Region_7_SIR2009_5144": (10.8, 0.458),
}
BANKFULL_STATEWIDE = (16.9, 0.401)
KM2_TO_MI2, FT_TO_M = 0.3861021585, 0.3048


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def offset(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Position moved by metres east and north; at a pole the longitude stays."""
    per_degree = 111320.0 * F.cos(F.radians(lat))
    move = F.when(F.abs(per_degree) > 1e-6, east / F.nullif(per_degree, F.lit(0.0))).otherwise(0.0)
    return lat + north / 111320.0, lon + move


def sample_ring(lat: Column, lon: Column, radii: list[float]) -> Column:
    """Centre and eight compass directions at each radius, as an array of (i, lon, lat)."""
    dirs = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    steps = [(0.0, 0.0)] + [(r * dx / (dx * dx + dy * dy) ** 0.5, r * dy / (dx * dx + dy * dy) ** 0.5) for r in radii for dx, dy in dirs]
    rows = []
    for i, (dx, dy) in enumerate(steps):
        la, lo = offset(lat, lon, F.lit(dx), F.lit(dy))
        rows.append(F.struct(F.lit(i).alias("i"), lo.alias("lon"), la.alias("lat")))
    return F.array(*rows)


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to equal-area metres."""
    e = E2**0.5
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = A * F.sqrt(C - N * q) / N
    theta = N * F.radians(lon + 96.0)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x = longitude, y = latitude) on a local projection at its mean latitude."""
    n = F.size(ring)
    lat0 = F.radians(F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["y"]) / n)
    k = EARTH_KM * EARTH_KM * F.cos(lat0)
    turn = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
                      lambda a, b: F.radians(a["x"]) * F.radians(b["y"]) - F.radians(b["x"]) * F.radians(a["y"]))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, t: a + t)) * k / 2


def bankfull_width_m(region: Column, area_km2: Column) -> Column:
    """Channel width expected from the drainage area; regions without an equation use the statewide one."""
    a = F.coalesce(lookup(region, {k: v[0] for k, v in BANKFULL.items()}), F.lit(BANKFULL_STATEWIDE[0]))
    b = F.coalesce(lookup(region, {k: v[1] for k, v in BANKFULL.items()}), F.lit(BANKFULL_STATEWIDE[1]))
    mi2 = area_km2 * KM2_TO_MI2
    return F.when(area_km2.isNotNull(), a * F.pow(F.greatest(mi2, F.lit(0.01)), b) * FT_TO_M)


def constriction_ratio(kind: Column, length_m: Column, opening_m: Column, bankfull_m: Column) -> Column:
    """Span over channel width: a bridge spans with its length, a culvert with its opening."""
    span = F.when(kind == "bridge", length_m).when(kind == "culvert", opening_m)
    return span / F.when(bankfull_m > 0, bankfull_m)


def log_size_ratio(size_m: Column, log_area: Column) -> Column:
    """log10 of a structure's size against the channel width expected from its catchment (area ^ 0.4)."""
    return F.when(size_m.isNotNull(), F.log10(F.greatest(size_m, F.lit(0.1))) - 0.4 * log_area)
