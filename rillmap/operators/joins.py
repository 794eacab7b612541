"""Record linkage and lookups: id joins with checks, multi-pass matching, pointers, guards, source comparisons."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.functions.text import column_key, normalise_name
from rillmap.operators.points import cell, block
from rillmap.operators.ranking import keep_best


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres."""
    dy = (lat1 - lat2) * 110540.0
    dx = (lon1 - lon2) * 111320.0 * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def join_name(df: DataFrame, lookup: DataFrame, left: str, right: str, suffix: str | None = None) -> DataFrame:
    """Left join on a normalised name. The lookup is reduced to one row per name first."""
    one = keep_best(lookup.withColumn("_key", normalise_name(F.col(right))), ["_key"], [c for c in lookup.columns])
    return df.withColumn("_key", normalise_name(F.col(left), suffix)).join(one, "_key", "left").drop("_key")


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left lookup by id with at most one row per id; unmatched stay NULL."""
    return df.join(keep_best(lookup, [key], order), key, "left")


def join_first_wins(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Full join of two measurement sources; the first one's value wins."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full")
    return j.select(*key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "a").otherwise("b").alias("source"))


def unused(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def follow_pointers(df: DataFrame, seq: str, pointers: dict[str, str], value: str) -> DataFrame:
    """Add per pointer {name: pointer column} the ``value`` of the row it points to; a pointer column holds a ``seq``."""
    out = df
    target = df.groupBy(F.col(seq).alias("_seq")).agg(F.min(value).alias("_val"))
    for name, pointer in pointers.items():
        out = out.join(target.select(F.col("_seq").alias(pointer), F.col("_val").alias(name)), pointer, "left")
    return out


def verified_pairs(left: DataFrame, right: DataFrame, key: str, distance: Column, gap: Column, max_m: float = 30.0, tol: float = 0.02) -> DataFrame:
    """Id matches that also agree in place and score; the sides' other columns must have different names."""
    return left.join(right, key).withColumn("match_m", distance).withColumn("gap", gap).where((F.col("match_m") <= max_m) & (F.col("gap") < tol))


def match_multipass(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, lxy: tuple[str, str], rxy: tuple[str, str], lscore: str,
                    rscore: str, value: str, fallback: DataFrame | None = None, max_m: float = 30.0, tol: float = 0.02, ambig: float = 0.05) -> DataFrame:
    """Greedy linkage in passes, each right row serving one left row at most.

    1: same id, within ``max_m`` and ``tol`` of the score. 2: place and score among the rows not yet used; a left row that
    loses its closest candidate is not offered another. 3: a fallback table by left id. The left row takes the lowest value
    of its accepted rows and is ambiguous where these differ by more than ``ambig``.
    """
    dx, dy = F.col(lxy[0]) - F.col(rxy[0]), F.col(lxy[1]) - F.col(rxy[1])
    dist, gap = F.sqrt(dx * dx + dy * dy), F.abs(F.col(lscore) - F.col(rscore))
    spread = (F.coalesce(F.max("_top") - F.min(value), F.lit(0.0)) > ambig).alias("ambiguous")
    best = F.min(F.struct("match_m", rid, "gap")).alias("_b")

    def closest(pairs: DataFrame, number: int) -> DataFrame:
        g = pairs.groupBy(lid).agg(best, F.min(value).alias(value), spread)
        return g.select(lid, f"_b.{rid}", value, F.lit(number).alias("pass"), "_b.match_m", "_b.gap", "ambiguous")

    lcols, rcols = left.select(lid, key, *lxy, lscore), right.select(rid, key, *rxy, rscore, value)
    one = closest(verified_pairs(lcols, rcols.withColumn("_top", F.col(value)), key, dist, gap, max_m, tol), 1)
    rest_l, rest_r = unused(lcols, one, lid).drop(key), unused(rcols, one, rid).drop(key)
    # copies of a right row at one place with one score: only the smallest id can be chosen, the values count together
    rest_r = rest_r.groupBy(*rxy, rscore).agg(F.min(rid).alias(rid), F.min(value).alias(value), F.max(value).alias("_top"))
    around = rest_r.withColumn("_o", F.explode(block())).select(
        *rest_r.columns, (cell(rxy[0], max_m) + F.col("_o.i")).alias("_cx"), (cell(rxy[1], max_m) + F.col("_o.j")).alias("_cy"))
    near = (rest_l.withColumn("_cx", cell(lxy[0], max_m)).withColumn("_cy", cell(lxy[1], max_m)).join(around, ["_cx", "_cy"])
            .withColumn("match_m", dist).withColumn("gap", gap).where((F.col("match_m") <= max_m) & (F.col("gap") < tol)))
    two = keep_best(closest(near, 2), [rid], ["match_m", lid])
    linked = keep_best(keep_best(one.unionByName(two), [rid], ["match_m", lid]), [lid], ["match_m", rid])
    out = left.select(lid).join(linked, lid, "left")
    if fallback is not None:
        out = out.join(fallback.select(lid, F.col(value).alias("_old")), lid, "left")
        fill = F.col(value).isNull() & F.col("_old").isNotNull()
        out = out.withColumn("pass", F.when(fill, 3).otherwise(F.col("pass"))).withColumn(value, F.coalesce(value, "_old")).drop("_old")
    return out.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def join_guarded(left: DataFrame, right: DataFrame, key: str, a: str, b: str, tol: float = 0.002) -> DataFrame:
    """Id join that fails the job at the first row whose redundant columns disagree."""
    bad = F.abs(F.col(a) - F.col(b)) > tol
    return left.join(right, key).withColumn(a, F.when(bad, F.raise_error(F.lit(f"{a} and {b} disagree"))).otherwise(F.col(a)))


def diff_sources(a: DataFrame, b: DataFrame, key: str, score: str, day: str) -> DataFrame:
    """One row that classifies the differences of two sources per key; the second may hold several rows per key."""
    lows = b.groupBy(key).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.min(day).alias("_day"), F.count("*").alias("_n"))
    j = a.select(key, F.col(score).alias("_s"), F.col(day).alias("_d")).join(lows, key).where(F.col("_lo") >= 0)
    d = F.abs(F.col("_s") - F.col("_hi"))
    return j.agg(F.count("*").alias("n_shared"), F.avg((d < 0.001).cast("double")).alias("share_same"), F.count_if(d >= 0.001).alias("n_differ"),
                 F.count_if(d > 0.05).alias("n_over_05"), F.count_if(d > 0.2).alias("n_over_20"),
                 F.count_if((d > 0.05) & (F.col("_d") == F.col("_day"))).alias("n_same_day"),
                 F.count_if((d > 0.05) & (F.col("_s") < F.col("_hi"))).alias("n_lower"),
                 F.count_if(F.col("_hi") - F.col("_lo") > 0.001).alias("n_inner"))


def not_in_ledger(wanted: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Requested entries that were not scored before."""
    return wanted.join(ledger.select(key), key, "left_anti")


def stack_sources(a: DataFrame, b: DataFrame, tags: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two sources on their common columns, with the source as a tag."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common, F.lit(tags[0]).alias("source")).unionByName(b.select(*common, F.lit(tags[1]).alias("source")))


def resolve_columns(columns: Sequence[str], needed: dict[str, str], optional: dict[str, str] | None = None) -> dict[str, str]:
    """{actual column: new name} with names compared without case and blanks; raises if a needed one is missing."""
    actual = {column_key(c): c for c in columns}
    missing = [n for n in needed.values() if column_key(n) not in actual]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(columns)}")
    both = {**needed, **{k: v for k, v in (optional or {}).items() if column_key(v) in actual}}
    return {actual[column_key(v)]: k for k, v in both.items()}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by name; columns missing on one side are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Overlapping sources with one row per id."""
    return keep_best(union_all(frames), [key], order)


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only in the first, only in the second, and whether the sets are equal."""
    k = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return k.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_only_a"),
                 F.count_if(F.col("_a").isNull()).alias("n_only_b"), F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("equal"))
