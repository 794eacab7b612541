"""Ranks, order statistics and seeded orders that never put one group or one tie into one task.

A window over a whole group is a single task however large the group is, so everything here ranks by range partition, at every size of table: the
rows are sorted by (group, keys) into range partitions, numbered there and frozen as Parquet, and shifted by the number of rows the same group has in
earlier partitions. Only (partition, group) counts are joined back, NULL groups included.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.session import cut, stored


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys where NULL meets NULL; the columns of ``left``, then the others of ``right``."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(c for c in right.columns if c not in keys)])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)])
    others = [c for c in right.columns if c not in keys]
    joined = left.join(named, on, how)
    return joined.select(*[left[c] for c in left.columns], *([F.col(f"_v{i}").alias(c) for i, c in enumerate(others)] if how not in ("left_semi", "left_anti") else []))


def seeded_key(seed: int, *ids: str | Column) -> Column:
    """A reproducible 32-bit number per (seed, id): the order or coin used by every sampling operator."""
    parts = [F.lit(str(seed))] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed: int, *ids: str | Column) -> Column:
    """A reproducible number in [0, 1) per (seed, id)."""
    return seeded_key(seed, *ids) / F.lit(4294967296.0)


def ordered(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys`` with ``_part`` and ``_pos`` (position inside the partition), frozen."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    numbered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return stored(numbered).select(
        *df.columns,
        F.shiftright("_mid", 33).cast("int").alias("_part"),
        F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_pos"),
    )


def with_rank(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "rn",
              total: str | None = None) -> DataFrame:
    """Add the 1-based row number of ``order`` inside ``group``; ``order`` must be unique inside a group.

    ``total`` names an extra column with the group's row count.
    """
    group = list(group)
    rows = ordered(df, [*group, *order])
    counts = cut(rows.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n")))
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    shift = counts.select(*group, "_part", "_first", F.sum("_n").over(earlier).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    out = null_safe_join(rows, shift, [*group, "_part"])
    return out.select(*df.columns, (F.col("_pos") - F.col("_first") + 1 + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name),
                      *([F.col("_all").cast("bigint").alias(total)] if total else []))


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value): ``n`` rows with it, ``below`` rows under it and ``mid_rank``, the average rank of the tie.

    Ties collapse before the shuffle, so a value held by a third of all rows is one row here.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return running_sums(counts, [value], {"n": "upto"}, group).select(
        *group, value, "n", (F.col("upto") - F.col("n")).alias("below"),
        (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("mid_rank"),
    )


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums along ``order`` inside ``group`` by range partition: {column: output name}."""
    group = list(group)
    rows = ordered(df, [*group, *order])
    inner = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inner).alias(f"_run_{o}") for c, o in sums.items()])
    totals = rows.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_sum_{o}") for c, o in sums.items()])
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*group, "_part", *[F.sum(f"_sum_{o}").over(earlier).alias(f"_bef_{o}") for o in sums.values()])
    return null_safe_join(local, shift, [*group, "_part"]).select(
        *df.columns, *[(F.col(f"_run_{o}") + F.coalesce(F.col(f"_bef_{o}"), F.lit(0))).alias(o) for o in sums.values()])


def average_rank(df: DataFrame, value: str, name: str = "mid_rank", group: Sequence[str] = ()) -> DataFrame:
    """Add the mid-rank of ``value`` (ties share the average rank) inside ``group``."""
    group = list(group)
    ranks = value_ranks(df, value, group).select(*group, value, F.col("mid_rank").alias(name))
    return null_safe_join(df, ranks, [*group, value], "left")


def quantile_higher(df: DataFrame, value: str, rank: Column | int, name: str = "q") -> DataFrame:
    """The ``rank``-th smallest value (1-based) as one row, by cumulative counts of distinct values."""
    ranks = value_ranks(df, value)
    target = F.lit(rank) if isinstance(rank, int) else rank
    return ranks.where(F.col("below") + F.col("n") >= target).agg(F.min(value).alias(name))


def first_k(df: DataFrame, k: int, order: Sequence[str | Column], group: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows of each group in ``order``; a smaller ``k`` gives a strict subset."""
    return with_rank(df, order, group, "_rn").where(F.col("_rn") <= k).drop("_rn")


def keep_best(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in ``order``. A grouped minimum, so hot keys collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def one_of_each(df: DataFrame, key: str, columns: Sequence[str], better: Column | None = None) -> DataFrame:
    """(key, *columns) of the smallest whole row of each key, of those that are ``better`` if there are any; values of several rows are never mixed."""
    first = [] if better is None else [(~better).alias("_worse")]
    best = df.groupBy(key).agg(F.min(F.struct(*first, *columns)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def permute(df: DataFrame, value: str, ids: Sequence[str], seed: int, group: Sequence[str] = (),
            name: str | None = None) -> DataFrame:
    """Shuffle ``value`` over the rows (inside ``group``): the i-th row by id receives the value of the i-th row by seed."""
    group = list(group)
    target = with_rank(df, list(ids), group, "_rn")
    source = with_rank(df.select(*group, *ids, F.col(value).alias("_moved"), seeded_key(seed, *ids).alias("_key")),
                       ["_key", *ids], group, "_rn").select(*group, "_rn", "_moved")
    name = name or value
    out = null_safe_join(target.drop("_moved"), source, [*group, "_rn"])
    return out.select(*[c for c in df.columns if c != name], F.col("_moved").alias(name))
