"""Cleaning of survey tables: filters with NULL rules, reports, collapses and descriptions."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.operators.metrics import exact_quantiles


# ---- predicates and values

def not_text(col: str | Column, value: str) -> Column:
    """Trimmed lower-case text differs from ``value``; NULL fails, as in SQL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(c)) != value


def not_in_text(col: str, values: Sequence[str]) -> Column:
    """Trimmed lower-case text is none of ``values``; NULL passes."""
    return ~F.coalesce(F.lower(F.trim(F.col(col))).isin(*values), F.lit(False))


def in_text(col: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.trim(F.col(col)).isin(*values), F.lit(False))


def any_present(*cols: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()


def digit_code(col: str | Column) -> Column:
    """A single-digit condition code as a number, anything else NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike("^[0-9]$"), c.try_cast("double"))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to a range; NULL stays NULL (greatest and least alone would skip it)."""
    out = c if lo is None else F.greatest(c, F.lit(lo))
    out = out if hi is None else F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def keep_when(c: Column, ok: Column) -> Column:
    return F.when(ok, c)


Rule = Callable[[Column], Column]
# Sentinel rules by name; a value for which the rule is false or unknown becomes NULL.
SENTINELS: dict[str, Rule] = {
    "minus_one": lambda c: c != -1,
    "negative": lambda c: c >= 0,
    "not_positive": lambda c: c > 0,
    "year": lambda c: c.between(1700, 2026),
    "forty_years": lambda c: (c >= 0) & (c < 40),
}


def sentinels_to_null(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Apply {column: rule name} in one projection."""
    return df.withColumns({c: keep_when(F.col(c), SENTINELS[r](F.col(c))) for c, r in rules.items()})


def mask_beyond(df: DataFrame, distance: str, limit: float, columns: Sequence[str]) -> DataFrame:
    """NULL a group of columns where the link is longer than ``limit``."""
    return df.withColumns({c: F.when(F.col(distance) <= limit, F.col(c)) for c in columns})


def unmatched_defaults(df: DataFrame, matched: Column, text: dict[str, str], flag: str = "matched") -> DataFrame:
    """Text columns of unmatched rows get a default, numbers stay NULL, a 0/1 flag is added."""
    return df.withColumns({**{c: F.coalesce(F.col(c), F.lit(d)) for c, d in text.items()}, flag: matched.cast("double")})


def feature_groups(columns: Sequence[str], prefixes: dict[str, Sequence[str]], drop_suffixes: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column lists by prefix; a column may be in one group only."""
    groups = {g: [c for c in columns if c.startswith(tuple(ps)) and not c.endswith(tuple(drop_suffixes) or ("\0",))] for g, ps in prefixes.items()}
    taken = [c for g in groups.values() for c in g]
    if len(taken) != len(set(taken)):
        raise ValueError("feature groups overlap")
    return groups


def assemble(df: DataFrame, keep: Sequence[str], rename: dict[str, str] | None = None, derive: dict[str, Column] | None = None) -> DataFrame:
    """Ordered keep-list without repeats and without missing columns, then renames, then derived columns."""
    cols = [c for c in dict.fromkeys(keep) if c in df.columns]
    out = df.select(*cols).withColumnsRenamed(rename or {})
    return out.withColumns(derive or {})


def audit_flags(df: DataFrame, flags: dict[str, Column], predictors: Sequence[str]) -> DataFrame:
    """Boolean quality flags per row, one of them 'any predictor missing'; nothing is dropped."""
    missing = F.exists(F.array(*[F.col(c).isNull() for c in predictors]), lambda b: b)
    return df.withColumns({**{k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}, "any_predictor_missing": missing})


def category_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """0-based integer codes by order of value; the distinct values are few and are numbered once, NULL is -1."""
    values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    listed = values.agg(F.array_sort(F.collect_list(col)).alias("_all"))
    codes = listed.select(F.posexplode("_all").alias(name, col))
    return df.join(codes, col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def dummies(df: DataFrame, key: Sequence[str], col: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.select("*", *[(F.col(col) == v).cast("double").alias(f"{prefix}{v}") for v in values])


# ---- reports

def cleaning_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, label, before, after, dropped) of successive filters, counted in one pass over the table."""
    passed = []
    for _, cond in steps:
        passed.append(F.coalesce(cond, F.lit(False)) if not passed else passed[-1] & F.coalesce(cond, F.lit(False)))
    counts = df.agg(F.count("*").alias("n0"), *[F.count_if(p).alias(f"n{i + 1}") for i, p in enumerate(passed)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("before"), F.col(f"n{i + 1}").alias("after"))
                     for i, (label, _) in enumerate(steps)])
    return counts.select(F.inline(rows)).withColumn("dropped", F.col("before") - F.col("after"))


def apply_steps(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [c for _, c in steps]))


# ---- collapses

def collapse_first(df: DataFrame, key: Sequence[str], order: Sequence[str], mode: str = "column", last: bool = False) -> DataFrame:
    """One row per key. ``mode="column"`` takes per column the first (last) non-NULL value in ``order``, so a row may mix
    source rows; ``mode="row"`` takes the first (last) row whole. NULL keys form a group, NULL order values come last."""
    rest = [c for c in df.columns if c not in key]
    ranked = df.withColumn("_o", F.struct(*[x for o in order for x in (F.col(o).isNull().alias(f"_null_{o}"), F.col(o))]))
    pick = F.max_by if last else F.min_by
    if mode == "row":
        out = ranked.groupBy(*key).agg(pick(F.struct(*rest), "_o").alias("_r"))
        return out.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
    out = ranked.groupBy(*key).agg(*[pick(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in rest])
    return out.select(*df.columns)


def collapse_min_spread(df: DataFrame, key: Sequence[str], value: str, attributes: Sequence[str], tie: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Lowest value per key, its spread (0 if nothing was measured), row count, attributes of the lowest row, disagreement flag."""
    order = F.when(F.col(value).isNotNull(), F.struct(value, *tie))
    spread = F.coalesce(F.max(value) - F.min(value), F.lit(0.0))
    return df.groupBy(*key).agg(F.min(value).alias(value), spread.alias("spread"), F.count("*").alias("n_rows"),
                                *[F.min_by(a, order).alias(a) for a in attributes], (spread > limit).alias("ambiguous"))


def eligible_groups(df: DataFrame, group: str, value: str, whole: Column, share: float = 0.10) -> DataFrame:
    """Groups whose share of zeros is at least ``share`` and whose values are all whole."""
    rec = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.avg((F.col(value) == 0).cast("double")).alias("zero_share"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole"))
    return rec.withColumn("usable", (F.col("zero_share") >= share) & F.col("whole"))


# ---- descriptions

def audit_summary(df: DataFrame, key: str, sub: str, value: str) -> DataFrame:
    """Totals, distinct keys, valid and unscored rows, keys with more than one record, the largest one; over per-key counts."""
    v = F.col(value)
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v.between(0, 1)).alias("valid"), F.count_if(v == -1).alias("unscored"),
                              F.max(sub).alias("top"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(key).alias("n_keys"), F.sum("valid").alias("n_valid"),
                   F.sum("unscored").alias("n_unscored"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.max("n").alias("max_rows"),
                   F.max("top").alias("max_sub"))


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
                               F.stddev_samp(value).alias("sd"))


def value_counts(df: DataFrame, by: str) -> DataFrame:
    """Counts and shares; the total is a second aggregate over the counts."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / c.agg(F.sum("n")).scalar())


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "pct_missing")


def describe(df: DataFrame, value: str, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, sample sd, share at 0 and at 1, and linear quantiles of one column."""
    v = F.col(value)
    quantiles = exact_quantiles(df, value, qs)
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                  F.avg((v == 0).cast("double")).alias("share_0"), F.avg((v == 1).cast("double")).alias("share_1"),
                  *[F.lit(x).cast("double").alias(f"q{int(round(q * 100)):02d}") for q, x in zip(qs, quantiles)])


def share_by(df: DataFrame, by: Sequence[str], cond: Column, name: str = "share") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(cond).alias("n_true"),
                               F.avg(F.coalesce(cond, F.lit(False)).cast("double")).alias(name))


def sum_parts(parts: Sequence[Column]) -> Column:
    """Sum in which a missing part counts 0; NULL only if every part is missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)
