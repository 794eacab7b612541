"""Folds, held-out sets, samples and cluster resampling. Rows never leave Spark; only counts per group reach the driver."""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.operators.ranking import first_k, null_safe_join, quantile_higher, running_sums, seeded_key, with_rank
from rillmap.session import small, stored


MOST_GROUPS = 1_000_000      # groups whose counts may come to the driver; no data row ever does


def group_order(seed: int, group: object) -> int:
    """The number ``seeded_key`` gives a group, for loops over group counts."""
    return int(hashlib.md5(f"{seed}:{group}".encode()).hexdigest()[:8], 16)


# ---- folds

def random_kfold(df: DataFrame, rid: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Balanced random folds of single rows."""
    keyed = df.withColumn("_key", seeded_key(seed, rid))
    ranked = with_rank(keyed, ["_key", rid], name="_rn")
    return ranked.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_key", "_rn")


def stratified_kfold(df: DataFrame, rid: str, label: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    keyed = df.withColumn("_key", seeded_key(seed, rid))
    ranked = with_rank(keyed, ["_key", rid], [label], "_rn")
    return ranked.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_key", "_rn")


def _lightest_first(sizes: list[tuple[object, int]], k: int) -> dict[object, int]:
    load = [0] * k
    fold = {}
    for g, n in sizes:
        f = load.index(min(load))
        fold[g] = f
        load[f] += n
    return fold


def assign_groups(counts: Sequence[tuple[object, int]], k: int, seed: int, largest_first: bool = False) -> dict[object, int]:
    """Fold per group: groups in seeded order (or largest first, seeded order on ties), each to the lightest fold so far.

    Largest-first gives nearly the same folds for every seed; the seeded order does not, and is the default.
    """
    seeded = sorted(counts, key=lambda c: (group_order(seed, c[0]), str(c[0])))
    if largest_first:
        seeded.sort(key=lambda c: -c[1])
    return _lightest_first(seeded, min(k, len(seeded)) or 1)


def group_counts(df: DataFrame, group: str) -> list[tuple[object, int]]:
    """Rows per group: what the greedy assignment needs, a row per group and no data row. NULL is a group of its own.

    More than ``MOST_GROUPS`` groups raise an error, since the assignment runs on the driver.
    """
    counts = df.groupBy(group).count().limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return [(r[0], r[1]) for r in counts]


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 0, largest_first: bool = False, name: str = "fold",
                counts: Sequence[tuple[object, int]] | None = None) -> DataFrame:
    """Whole groups held out; adds the fold of each row's group."""
    folds = assign_groups(counts or group_counts(df, group), k, seed, largest_first)
    return null_safe_join(df, fold_table(df, group, folds, name), [group])


def fold_table(df: DataFrame, group: str, folds: dict[object, int], name: str = "fold") -> DataFrame:
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(name, T.IntegerType())])
    return small(df.sparkSession, list(folds.items()), schema)


def repeated_group_kfold(df: DataFrame, group: str, k: int, repeats: int, seed: int = 0, largest_first: bool = True) -> DataFrame:
    """(repeat, group, fold) for several seeds, from one count of the groups."""
    from pyspark.sql import types as T
    counts = group_counts(df, group)
    rows = [(r, g, f) for r in range(repeats) for g, f in assign_groups(counts, k, seed + r, largest_first).items()]
    schema = T.StructType([T.StructField("repeat", T.IntegerType()), T.StructField(group, df.schema[group].dataType), T.StructField("fold", T.IntegerType())])
    return small(df.sparkSession, rows, schema)


def leave_one_out_groups(df: DataFrame, group: str, minimum: int) -> DataFrame:
    """Groups large enough to be a test set of their own, with their size and the size of the rest."""
    c = df.groupBy(group).agg(F.count("*").alias("n_test"))
    return c.withColumn("n_train", c.agg(F.sum("n_test")).scalar() - F.col("n_test")).where(F.col("n_test") >= minimum)


def locked_groups(df: DataFrame, group: str, region: str, seed: int, share: float = 0.15, below: float = 0.02, above: float = 0.04,
                  min_group: int = 250, min_regions: int = 4, tries: int = 1000) -> list[object]:
    """Whole groups for a test set of about ``share`` of the rows, from several regions; the next seed if a draw is not valid."""
    rows = df.groupBy(group, region).agg(F.count("*").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    total = sum(r["n"] for r in rows)
    size, regions = {}, {}
    for g, where, n in rows:
        if g is not None:
            size[g] = size.get(g, 0) + n
            regions.setdefault(g, set()).update([where] if where is not None else [])
    eligible = [g for g in size if size[g] >= min_group]
    for t in range(tries):
        chosen, n = [], 0
        for g in sorted(eligible, key=lambda g: (group_order(seed + t, g), str(g))):
            if n >= share * total:
                break
            if n + size[g] <= (share + above) * total:
                chosen.append(g)
                n += size[g]
        seen = set().union(*[regions[g] for g in chosen]) if chosen else set()
        if share - below <= n / total <= share + above and len(seen) >= min_regions:
            return chosen
    raise ValueError("no held-out set meets the limits")


def locked_holdout(df: DataFrame, group: str, region: str, seed: int, name: str = "locked", **limits) -> DataFrame:
    """Add whether a row's group is held out; a row without a group is not."""
    chosen = fold_table(df, group, dict.fromkeys(locked_groups(df, group, region, seed, **limits), 1), "_held")
    return df.join(chosen, group, "left").select(*df.columns, F.col("_held").isNotNull().alias(name))


# ---- samples

def sample_n(df: DataFrame, rid: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the same ones for the same seed."""
    return first_k(df.withColumn("_key", seeded_key(seed, rid)), n, ["_key", rid]).drop("_key")


def calibration_split(df: DataFrame, rid: str, n: int, seed: int) -> DataFrame:
    """Mark ``n`` random rows as 'calibration' and the others as 'train'."""
    picked = sample_n(df.select(rid), rid, n, seed).withColumn("part", F.lit("calibration"))
    return df.join(picked, rid, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def stratified_prefix(df: DataFrame, group: str, rid: str, per_group: int, seed: int) -> DataFrame:
    """Up to ``per_group`` random rows of each group; fewer per group give a strict subset."""
    return first_k(df.withColumn("_key", seeded_key(seed, rid)), per_group, ["_key", rid], [group]).drop("_key")


def thin_training(df: DataFrame, rid: str, fold: str, k: int, fractions: Sequence[float], seed: int) -> DataFrame:
    """Training rows of each held-out fold with the smallest fraction that includes them (nested fractions).

    Rows are sorted once; the rank without a fold is the rank among all rows less the rows of that fold before it.
    """
    one = df.withColumn("_key", seeded_key(seed, rid)).withColumns({f"_in{i}": (F.col(fold) == i).cast("bigint") for i in range(k)}).withColumn("_one", F.lit(1).cast("bigint"))
    run = running_sums(one, ["_key", rid], {"_one": "_rank", **{f"_in{i}": f"_upto{i}" for i in range(k)}})
    totals = df.agg(F.count("*").alias("_total"), *[F.count_if(F.col(fold) == i).alias(f"_size{i}") for i in range(k)]).first()
    each = F.array(*[F.struct(F.lit(i).alias("held"), (F.col("_rank") - F.coalesce(F.col(f"_upto{i}"), F.lit(0))).alias("rn"),
                              F.lit(totals["_total"] - totals[f"_size{i}"]).alias("n")) for i in range(k)])
    rows = run.withColumn("_e", F.explode(each)).where(F.col(fold) != F.col("_e.held"))
    least = F.coalesce(*[F.when(F.col("_e.rn") <= F.floor(F.col("_e.n") * f), F.lit(float(f))) for f in sorted(fractions)])
    return rows.select(*df.columns, F.col("_e.held").alias("held"), least.alias("fraction")).where(F.col("fraction").isNotNull())


def group_size_weight(df: DataFrame, group: str, power: float, name: str = "weight", counts: Sequence[tuple[object, int]] | None = None) -> DataFrame:
    """1 / n^power with n the rows of the group; ``counts`` are those of ``group_counts``, where they are known."""
    if counts is not None:
        from pyspark.sql import types as T
        own = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(name, T.DoubleType())])
        return null_safe_join(df, small(df.sparkSession, [(g, 1.0 / float(n) ** power) for g, n in counts], own), [group])
    n = stored(df.groupBy(group).agg((1.0 / F.pow(F.count("*").cast("double"), F.lit(power))).alias(name)))      # of known size, so that few groups do not shuffle the rows
    return null_safe_join(df, n, [group])


# ---- cluster bootstrap

def bootstrap_r2(df: DataFrame, group: str, y: str, models: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(rep, one r2 column per model): R2 of resamples of whole groups.

    R2 of a resample depends on sums per group only, so the rows are summed once and the draws join group sums.
    """
    res = lambda p: (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    sums = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(y).alias("_sy"), F.sum(F.col(y) * F.col(y)).alias("_syy"),
                                 *[F.sum(res(p)).alias(f"_r_{p}") for p in models])
    stats = with_rank(sums, [group], name="_g")
    size = stats.count()
    draws = df.sparkSession.range(reps * size).select(
        F.floor(F.col("id") / size).cast("int").alias("rep"), (F.col("id") % size).alias("slot"))
    draws = draws.withColumn("_g", seeded_key(seed, "rep", "slot") % size + 1)
    total = draws.join(stats, "_g").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("_n", "_sy", "_syy", *[f"_r_{p}" for p in models])])
    spread = F.nullif(F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_n"), F.lit(0.0))
    return total.select("rep", *[(1 - F.col(f"_r_{p}") / spread).alias(p) for p in models])


def bootstrap_ci(boot: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean and 95% percentile interval per model; the input has one row per replicate."""
    parts = [boot.agg(F.lit(m).alias("model"), F.avg(m).alias("mean"), F.percentile(m, F.lit(0.025)).alias("lo"),
                      F.percentile(m, F.lit(0.975)).alias("hi")) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paired_delta(boot: DataFrame, a: str, b: str) -> DataFrame:
    """b minus a on the same draws: mean, interval, and share of draws above 0."""
    d = boot.select((F.col(b) - F.col(a)).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"),
                 F.avg((F.col("d") > 0).cast("double")).alias("p_gt0"))


# ---- conformal intervals

def conformal_rank(n: int, alpha: float) -> int:
    """Rank of the residual that is the half-width: one above the textbook rank, at most n."""
    k0 = -((-(n + 1) * round((1 - alpha) * 1_000_000)) // 1_000_000)
    return min(n, k0 + 1)


def conformal_half_width(calibration: DataFrame, y: str, p: str, alpha: float = 0.1) -> DataFrame:
    """One row with the half-width ``q`` from calibration residuals."""
    res = calibration.select(F.abs(F.col(y) - F.col(p)).alias("_res")).where(F.col("_res").isNotNull())
    return quantile_higher(res, "_res", conformal_rank(res.count(), alpha))


def with_interval(df: DataFrame, p: str, half: Column, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Add ``lower`` and ``upper`` clipped to [lo, hi]."""
    cut = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return df.withColumns({"half_width": half, "lower": cut(F.col(p) - half), "upper": cut(F.col(p) + half)})


def conformal_by_bin(dev: DataFrame, test: DataFrame, y: str, p: str, bins: int = 5, q: float = 0.9) -> DataFrame:
    """Intervals whose half-width is the q-quantile of the residuals in the same prediction bin; edges come from ``dev``."""
    from rillmap.operators.metrics import bin_by_edges, exact_quantiles, quantiles_by
    # a value on an edge belongs to the bin above it
    edges = exact_quantiles(dev, p, [i / bins for i in range(1, bins)])
    place = lambda c: F.lit(bins - 1) - bin_by_edges(-F.col(c), [-e for e in edges])
    res = dev.select(place(p).alias("pbin"), F.abs(F.col(y) - F.col(p)).alias("_res"))
    width = quantiles_by(res, "_res", ["pbin"], q, "_half")
    return with_interval(test.withColumn("pbin", place(p)).join(width, "pbin"), p, F.col("_half")).drop("_half")
