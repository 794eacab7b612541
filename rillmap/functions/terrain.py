"""Features of fixed-shape elevation arrays; a missing sample is NULL and is skipped."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADII = (3, 6, 10, 15, 25, 40)
WINDOWS = (90, 150, 210, 270, 330, 390, 450, 510, 570, 630)


def present(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def arr_mean(a: Column) -> Column:
    p = present(a)
    return arr_sum(p) / F.nullif(F.size(p), F.lit(0))


def arr_sd(a: Column) -> Column:
    """Population standard deviation."""
    p, m = present(a), arr_mean(a)
    return F.sqrt(arr_sum(F.transform(p, lambda v: (v - m) * (v - m))) / F.nullif(F.size(p), F.lit(0)))


def slope_over_windows(a: Column) -> Column:
    """Least-squares slope of ten values against 0..9."""
    return arr_sum(F.transform(a, lambda v, i: (i - 4.5) * v)) / 82.5


def argmax_window(a: Column, windows: Sequence[int] = WINDOWS) -> Column:
    at = F.array_position(a, F.array_max(a)).cast("int")
    return F.try_element_at(F.array(*[F.lit(w) for w in windows]), F.nullif(at, F.lit(0)))


def add_window_features(df: DataFrame, arr: str, prefix: str, eps: float = 1e-3) -> DataFrame:
    """Mean, maximum, window of the maximum, slope over the windows and two ratios of a ten-window predictor."""
    a = F.col(arr)
    full = F.size(present(a)) == len(WINDOWS)
    return df.withColumns({
        f"{prefix}_mean": F.when(full, arr_mean(a)), f"{prefix}_max": F.when(full, F.array_max(a)),
        f"{prefix}_argmax": F.when(full, argmax_window(a)), f"{prefix}_slope": F.when(full, slope_over_windows(a)),
        f"{prefix}_ratio_90_630": F.get(a, F.lit(0)) / (F.abs(F.get(a, F.lit(9))) + eps),
        f"{prefix}_ratio_270_630": F.get(a, F.lit(3)) / (F.abs(F.get(a, F.lit(9))) + eps)})


def stream_power(log_area: Column, gradient: Column, eps: float = 1e-3) -> Column:
    return F.when(gradient.isNotNull(), log_area + F.log10(F.greatest(gradient, F.lit(0.0)) + eps))


def ring_slope(n: Column, s: Column, e: Column, w: Column, radius: float) -> Column:
    """Slope from opposite samples: both axes together, or the one that exists."""
    ns, ew = F.abs(n - s) / (2 * radius), F.abs(e - w) / (2 * radius)
    return F.coalesce(F.sqrt(ns * ns + ew * ew), ns, ew)


def ring_roughness(*samples: Column) -> Column:
    a = F.array(*samples)
    return F.when(F.size(present(a)) >= 2, arr_sd(a))


def add_profile_features(df: DataFrame, z: str) -> DataFrame:
    """Features of 49 samples: the centre and six rings of eight directions.

    The stream axis is the opposite pair of directions that is lowest on average at 10 to 25 m; its higher end is upstream.
    Everything is NULL without a centre sample.
    """
    ring = lambda i: F.slice(F.col(z), 2 + 8 * i, 8)
    at = lambda i, d: F.get(F.col(z), 1 + 8 * i + d)
    z0 = F.get(F.col(z), F.lit(0))
    pair_mean = lambda j: arr_mean(F.array(*[at(i, F.lit(d)) for d in (j, j + 4) for i in (2, 3, 4)]))
    df = df.withColumn("_pm", F.array(*[pair_mean(j) for j in range(4)]))
    lowest = F.array_position(F.col("_pm"), F.array_min("_pm"))
    df = df.withColumn("_ax", F.when(F.size(present(F.col("_pm"))) > 0, lowest.cast("int") - 1).otherwise(0))
    end_a = lambda i: at(i, F.col("_ax"))
    end_b = lambda i: at(i, F.col("_ax") + 4)
    high = F.coalesce(end_a(5), F.lit(-1e9)) >= F.coalesce(end_b(5), F.lit(-1e9))
    df = df.withColumns({"_up": F.array(*[F.when(high, end_a(i)).otherwise(end_b(i)) for i in range(6)]),
                         "_dn": F.array(*[F.when(high, end_b(i)).otherwise(end_a(i)) for i in range(6)]),
                         "_rd": (F.col("_ax") + 2) % 4})
    up, dn = (lambda i: F.get("_up", F.lit(i))), (lambda i: F.get("_dn", F.lit(i)))
    f: dict[str, Column] = {}
    for i, r in enumerate(RADII):
        f[f"fd_ring_mean_{r}"], f[f"fd_ring_sd_{r}"] = arr_mean(ring(i)) - z0, arr_sd(ring(i))
        f[f"fd_ring_min_{r}"], f[f"fd_ring_max_{r}"] = F.array_min(ring(i)) - z0, F.array_max(ring(i)) - z0
        f[f"fd_up_{r}"], f[f"fd_dn_{r}"] = up(i) - z0, dn(i) - z0
        f[f"fd_roadax_{r}"] = arr_mean(F.array(at(i, F.col("_rd")), at(i, F.col("_rd") + 4))) - z0
        f[f"fd_embank_{r}"] = z0 - arr_mean(F.array(end_a(i), end_b(i)))
    slope = lambda i: (up(i) - dn(i)) / (2.0 * RADII[i])
    f |= {"fd_slope_local": slope(2), "fd_slope_mid": slope(4), "fd_slope_far": slope(5),
          "fd_slope_ratio_local_far": slope(2) / (F.abs(slope(5)) + 1e-3), "fd_step_dn_3_10": dn(0) - dn(2), "fd_step_dn_10_25": dn(2) - dn(4),
          "fd_step_up_3_10": up(2) - up(0), "fd_axis_idx": F.col("_ax").cast("double"), "fd_sd_all": arr_sd(F.col(z)),
          "fd_distinct": F.size(F.array_distinct(F.transform(present(F.col(z)), lambda v: F.round(v, 2)))).cast("double")}
    return df.withColumns({k: F.when(z0.isNotNull(), v) for k, v in f.items()}).drop("_pm", "_ax", "_up", "_dn", "_rd")
