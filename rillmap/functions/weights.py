"""Flags, sample weights, seeded noise and scenario copies."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.operators.ranking import seeded_uniform


def log10_clipped(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.log10(F.greatest(x.cast("double"), F.lit(float(low)))))


def threshold_flag(x: Column, limit: float) -> Column:
    """1 above the limit, 0 otherwise, NULL stays NULL."""
    return F.when(x.isNotNull(), (x > limit).cast("double"))


def three_classes(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.when(x <= low, 0).when(x <= high, 1).otherwise(2))


def recency_weight(year: Column, now: int = 2026, scale: float = 8.0) -> Column:
    return F.exp((year - now) / scale)


def density_ratio(df: DataFrame, p: str, n_source: Column, n_target: Column, name: str = "weight") -> DataFrame:
    """p / (1 - p) * source rows / target rows, clipped to [0.05, 20], then divided by its mean."""
    q = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col(p)))
    raw = df.withColumn("_w", F.greatest(F.lit(0.05), F.least(F.lit(20.0), q / (1 - q) * n_source / n_target)))
    return raw.withColumn(name, F.col("_w") / raw.agg(F.avg("_w")).scalar()).drop("_w")


def noisy_answer(flag: Column, rid: str, seed: int, rate: float, kind: str = "symmetric") -> Column:
    """Flip a 0/1 answer with probability ``rate``; kind 'miss' misses a yes with ``rate`` and invents one with rate / 6."""
    u = seeded_uniform(seed, rid)
    if kind == "symmetric":
        wrong = u < rate
    elif kind == "miss":
        wrong = F.when(flag == 1, u <= rate).otherwise(u < rate / 6)
    else:
        raise ValueError(kind)
    return F.when(flag.isNotNull(), F.when(wrong, 1 - flag).otherwise(flag))


def link_verified(area_a: Column, area_b: Column) -> Column:
    """Two drainage areas agree within a factor of two."""
    ok = (area_a > 0) & (area_b > 0)
    return ok & (F.abs(F.log10(F.when(ok, area_a / F.nullif(area_b, F.lit(0.0))))) < math.log10(2))


def ambiguity_scenarios(df: DataFrame, flag: Column, unclear: Column, name: str = "flag") -> DataFrame:
    """Four labelled copies of each row: an unclear flag as it is, as no, as yes, and left out."""
    unclear = F.coalesce(unclear, F.lit(False))
    copies = F.array(*[F.struct(F.lit(label).alias("scenario"), F.when(unclear, v).otherwise(flag).alias(name)) for label, v in (
        ("mid", flag), ("no", F.lit(0.0)), ("yes", F.lit(1.0)), ("left_out", F.lit(None).cast("double")))])
    return df.select("*", F.inline(copies))
