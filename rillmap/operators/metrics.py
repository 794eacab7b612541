"""Evaluation as aggregations: error metrics, rank statistics, bins, calibration, capture, agreement, invariants.

Quantiles and rank statistics run on counts of distinct values that are cumulated by range partition; no statistic gathers
a column in one buffer.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.operators.ranking import null_safe_join, running_sums, value_ranks, with_rank
from rillmap.session import cut


# ---- bins and quantiles

def with_bin(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Add ``lo`` and ``hi`` of the right-closed bin that holds ``value``; rows outside all bins (the lowest edge too) go."""
    v = F.col(value)
    pick = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        here = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        test = (v > lo) & (v <= hi)
        pick = F.when(test, here) if pick is None else pick.when(test, here)
    return df.withColumn("_bin", pick).where(F.col("_bin").isNotNull()).select(*df.columns, "_bin.lo", "_bin.hi")


def bin_counts(df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return with_bin(df, value, edges).groupBy(*by, "lo", "hi").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles. Only the order statistics asked for come to the driver."""
    ranks = cut(value_ranks(df.select(F.col(value).cast("double").alias(value)), value))
    total = ranks.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(qs)
    at = sorted({i for q in qs for i in (math.floor((total - 1) * q), math.ceil((total - 1) * q))})
    hit = reduce(lambda a, b: a | b, [(F.col("below") <= i) & (F.col("below") + F.col("n") > i) for i in at])
    rows = ranks.where(hit).select(value, "below", "n").collect()   # at most two rows per quantile

    def stat(i: int) -> float:
        return next(r[0] for r in rows if r[1] <= i < r[1] + r[2])

    out = []
    for q in qs:
        h = (total - 1) * q
        lo, hi = stat(math.floor(h)), stat(math.ceil(h))
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def quantiles_by(df: DataFrame, value: str, group: Sequence[str], q: float, name: str = "q") -> DataFrame:
    """Linearly interpolated quantile per group, by cumulative counts; no group is gathered."""
    group = list(group)
    ranks = value_ranks(df.select(*group, F.col(value).cast("double").alias(value)), value, group)
    at = ranks.groupBy(*group).agg(((F.sum("n") - 1) * F.lit(float(q))).alias("_h"))
    upto = F.col("below") + F.col("n")
    two = null_safe_join(ranks, at, group).groupBy(*group, "_h").agg(F.min(F.when(upto > F.floor("_h"), F.col(value))).alias("_a"),
                                                         F.min(F.when(upto > F.ceil("_h"), F.col(value))).alias("_b"))
    return two.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias(name))


def bin_by_edges(value: str | Column, edges: Sequence[float]) -> Column:
    """Number of edges below the value."""
    value = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, b: a + b, [(F.lit(float(e)) < value).cast("int") for e in edges], F.lit(0))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Add the quantile bin of ``value`` (right-closed, lowest included, repeated edges dropped)."""
    edges = exact_quantiles(df, value, [i / bins for i in range(bins)])
    inner = sorted({e for e in edges[1:] if e is not None and e > edges[0]})
    return df.withColumn(name, bin_by_edges(value, inner))


def calibration_table(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Per prediction bin: rows, mean prediction, mean truth and their gap."""
    out = quantile_bins(df, p, bins).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("pred_mean"), F.avg(y).alias("obs_mean"))
    return out.withColumn("gap", F.col("obs_mean") - F.col("pred_mean"))


# ---- regression

def finite(*cols: str) -> Column:
    """Present, not NaN and not infinite in all columns."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in cols])


def regression_by(df: DataFrame, y: str, p: str, by: Sequence[str] = (), min_n: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """n, mae, rmse, r2, bias and pred_sd_ratio over rows where both are present; r2 is NULL without variance."""
    e = F.col(p) - F.col(y)
    spread = F.var_pop(y) * F.count("*")
    out = df.where(finite(y, p)).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(e * e) / F.when(spread > 0, spread)).alias("r2"), F.avg(e).alias("bias"),
        F.when(F.stddev_pop(y) > 0, F.stddev_pop(p) / F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("pred_sd_ratio"), *extra)
    return out.where(F.col("n") >= min_n) if min_n else out


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row with the rank correlation (mid-ranks on ties), NULL if one side is constant.

    Rows collapse to distinct (y, p) pairs with counts, so the two rank joins never see repeated rows.
    """
    pairs = cut(df.where(finite(y, p)).groupBy(F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("_c")))
    total = float(pairs.agg(F.sum("_c")).first()[0] or 1)
    by = lambda c: pairs.groupBy(c).agg(F.sum("_c").alias("_n"))

    def ranks(c: str, name: str) -> DataFrame:
        r = running_sums(by(c), [c], {"_n": "_upto"})
        return r.select(c, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))

    joined = pairs.join(ranks("_y", "_ry"), "_y").join(ranks("_p", "_rp"), "_p")
    a, b = ((F.col(c) - (total + 1) / 2) / total for c in ("_ry", "_rp"))     # centred and scaled, so sums stay exact enough
    s = joined.agg(F.sum(F.col("_c") * a * b).alias("ab"), F.sum(F.col("_c") * a * a).alias("aa"), F.sum(F.col("_c") * b * b).alias("bb"),
                   F.sum("_c").alias("n"))
    tiny = (F.col("aa") > 1e-15) & (F.col("bb") > 1e-15)
    return s.select("n", F.when(tiny, F.col("ab") / F.sqrt(F.nullif(F.col("aa") * F.col("bb"), F.lit(0.0)))).alias("spearman"))


def tail_mae(df: DataFrame, y: str, p: str, q: float = 0.15) -> DataFrame:
    """Mean absolute error where the truth is in its lowest and in its highest share ``q``."""
    df = df.where(finite(y, p))
    lo, hi = exact_quantiles(df, y, [q, 1 - q])
    e = F.abs(F.col(p) - F.col(y))
    return df.agg(F.avg(F.when(F.col(y) <= lo, e)).alias("mae_low_tail"), F.avg(F.when(F.col(y) >= hi, e)).alias("mae_high_tail"))


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
                               F.avg(F.col(hi) - F.col(lo)).alias("mean_width"))


def calibration_slope(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.regr_slope(y, p).alias("slope"), F.count("*").alias("n"))


def within_tolerance(df: DataFrame, y: str, p: str, steps: Sequence[float] = (0.05, 0.10, 0.20)) -> DataFrame:
    e = F.abs(F.col(p) - F.col(y))
    return df.where(finite(y, p)).agg(F.count("*").alias("n"), *[
        F.avg((e <= s + 1e-9).cast("double")).alias(f"within_{int(round(s * 100)):03d}") for s in steps])


# ---- ranking quality

def threshold_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, highest first: rows and positives at the score and at or above it."""
    t = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return running_sums(t, [F.col("score").desc()], {"n": "n_upto", "pos": "pos_upto"})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; a tie of a positive and a negative counts one half."""
    t = threshold_table(df, label, score)
    neg, before = F.col("n") - F.col("pos"), F.col("pos_upto") - F.col("pos")
    s = t.agg(F.sum(neg * (before + F.col("pos") / 2.0)).alias("won"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    return s.select((F.col("won") / F.nullif(F.col("p").cast("double") * F.col("q"), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum over distinct thresholds of the recall step times the precision."""
    t = threshold_table(df, label, score)
    s = t.agg(F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto")).alias("a"), F.sum("pos").alias("p"))
    return s.select((F.col("a") / F.nullif(F.col("p").cast("double"), F.lit(0.0))).alias("ap"))


def capture_at(df: DataFrame, label: str, risk: str, rid: str, shares: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Share of the positives among the rows with the highest risk."""
    r = with_rank(df.select(rid, label, risk), [F.col(risk).desc(), rid], total="_total")
    got = [F.sum(F.when(F.col("rn") <= F.round(F.col("_total") * s), F.col(label))) / F.greatest(F.sum(label), F.lit(1)) for s in shares]
    return r.agg(*[g.alias(f"caught_{int(round(s * 100))}") for g, s in zip(got, shares)])


def priority_overlap(df: DataFrame, a: str, b: str, rid: str, share: float = 0.2) -> DataFrame:
    """How far the two lists of the lowest ``share`` agree: k, Jaccard index, number of changed entries, rank correlation."""
    rows = df.where(finite(a, b)).select(rid, a, b)
    ra = with_rank(rows, [a, rid], name="_ra", total="_total")
    rb = with_rank(ra, [b, rid], name="_rb")
    k = F.greatest(F.lit(1), F.floor(F.col("_total") * share))
    both = (F.col("_ra") <= k) & (F.col("_rb") <= k)
    either = (F.col("_ra") <= k) | (F.col("_rb") <= k)
    s = rb.agg(F.max(k).cast("bigint").alias("k"), F.count_if(both).alias("_both"), F.count_if(either).alias("_either"))
    out = s.select("k", (F.col("_both") / F.col("_either")).alias("jaccard"), (F.col("k") - F.col("_both")).alias("changed"))
    return out.withColumn("spearman", spearman(rows, a, b).select("spearman").scalar())


def worst_captured(df: DataFrame, y: str, p: str, rid: str, share: float = 0.2) -> DataFrame:
    """Share of the truly lowest rows that are also among the lowest predictions."""
    return priority_overlap(df, y, p, rid, share).select("k", ((F.col("k") - F.col("changed")) / F.col("k")).alias("captured"))


# ---- descriptions and comparisons

def feature_label_corr(df: DataFrame, features: Sequence[str], y: str, top: int = 5) -> DataFrame:
    """The features with the highest absolute correlation with the target (a leak screen)."""
    wide = df.agg(*[F.abs(F.corr(c, y)).alias(c) for c in features])
    long = wide.unpivot([], list(features), "feature", "abs_corr")
    return long.orderBy(F.col("abs_corr").desc_nulls_last(), "feature").limit(top)


def summarise_runs(df: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Mean, population sd and sample sd of a metric over repeats; non-finite values are left out."""
    ok = df.where(finite(metric))
    return ok.groupBy(*by).agg(F.count("*").alias("n_runs"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd_pop"),
                               F.stddev_samp(metric).alias("sd_samp"))


def paired_gain(df: DataFrame, run: str, variant: str, metric: str, base: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-run difference of two variants, per group if asked for: mean, sample sd and number of wins."""
    wide = df.groupBy(*by, run).agg(F.max(F.when(F.col(variant) == base, F.col(metric))).alias("_a"),
                                    F.max(F.when(F.col(variant) == other, F.col(metric))).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    d = F.col("_b") - F.col("_a")
    return wide.groupBy(*by).agg(F.count("*").alias("n_runs"), F.avg(d).alias("mean_gain"), F.stddev_samp(d).alias("sd_gain"), F.count_if(d > 0).alias("wins"))


def crosstab_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """How far two assignments are the same up to renaming: sum of row maxima over all rows."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = c.groupBy(a).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return rows.agg((F.sum("top") / F.sum("all")).alias("overlap"), F.sum("all").alias("n"))


def invariant_report(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """PASS / FAIL rows: each check is (name, one-row table, condition over it)."""
    parts = [t.select(F.lit(name).alias("check"), F.when(cond, "PASS").otherwise("FAIL").alias("result")) for name, t, cond in checks]
    return reduce(DataFrame.unionByName, parts)


def source_agreement(a: DataFrame, b: DataFrame, key: str, flag: str, kind: str | None = None) -> DataFrame:
    """Share of a flag in each of two sources, how often they agree where both speak, and rows per side."""
    left = a.select(key, F.col(flag).alias("_a"), *([kind] if kind else []))
    both = left.join(b.select(key, F.col(flag).alias("_b")), key, "full")
    return both.groupBy(*([kind] if kind else [])).agg(
        F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.avg(F.col("_a").cast("double")).alias("share_a"),
        F.avg(F.col("_b").cast("double")).alias("share_b"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agree"))
