"""Ordered paths: previous and next rows, and summaries of labelled rows on the same path, without one task per path.

A path is sorted into range partitions. Inside a partition a window finds the neighbours; what lies beyond its edges comes
from one small row per (path, partition).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.operators.ranking import ordered


def carry(df: DataFrame, path: str, order: list[str], value: Column, when: Column | None = None, before: str | None = "prev",
          after: str | None = "next") -> DataFrame:
    """Add the ``value`` of the last earlier and first later row of the path (only rows where ``when`` holds)."""
    rows = ordered(df.withColumn("_v", value if when is None else F.when(when, value)), [path, *order])
    inner = Window.partitionBy(path, "_part").orderBy("_pos")
    back, ahead = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(1, Window.unboundedFollowing)
    local = rows.withColumn("_lp", F.last("_v", ignorenulls=True).over(back)).withColumn("_ln", F.first("_v", ignorenulls=True).over(ahead))
    edge = rows.where(F.col("_v").isNotNull()).groupBy(path, "_part").agg(
        F.max_by("_v", "_pos").alias("_last"), F.min_by("_v", "_pos").alias("_first"))
    parts = rows.select(path, "_part").distinct().join(edge, [path, "_part"], "left")
    chain = Window.partitionBy(path).orderBy("_part")     # one row per partition the path touches
    parts = parts.select(path, "_part",
                         F.last("_last", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("_pp"),
                         F.first("_first", ignorenulls=True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("_pn"))
    out = local.join(parts, [path, "_part"], "left")
    add = ([F.coalesce("_lp", "_pp").alias(before)] if before else []) + ([F.coalesce("_ln", "_pn").alias(after)] if after else [])
    return out.select(*df.columns, *add)


def asof_path(df: DataFrame, path: str, pos: str, rid: str, label: str, is_ref: str) -> DataFrame:
    """Per row of a path: label and position of the next reference row below and above it, and the leave-one-out mean and
    count of the path's reference rows. A row is never its own neighbour; of rows at the same position the other ones count
    as above (the one with the smallest id first).
    """
    ref = F.struct(F.col(label).alias("label"), F.col(pos).alias("pos"))
    # Rows at the same position: the neighbour above is the smallest other id there, else the first row further up.
    same = df.where(is_ref).groupBy(path, pos).agg(
        F.min(F.struct(rid, label)).alias("_m1"), F.count("*").alias("_k"))
    second = (df.where(is_ref).join(same.where("_k > 1").select(path, pos, F.col(f"_m1.{rid}").alias("_first_id")), [path, pos])
              .where(F.col(rid) != F.col("_first_id")).groupBy(path, pos).agg(F.min(F.struct(rid, label)).alias("_m2")))
    places = df.select(path, pos).distinct().join(same, [path, pos], "left")
    label_here = F.col(f"_m1.{label}")
    places = carry(places, path, [pos], F.struct(label_here.alias("label"), F.col(pos).alias("pos")), F.col("_m1").isNotNull(), "_below", "_above")
    totals = df.groupBy(path).agg(F.sum(F.when(F.col(is_ref), F.col(label))).alias("_sum"), F.count_if(F.col(is_ref)).alias("_n"))
    j = df.join(places, [path, pos]).join(second, [path, pos], "left").join(totals, path)
    peer = F.when(F.col("_m1").isNotNull() & (F.col(f"_m1.{rid}") != F.col(rid)), F.struct(label_here.alias("label"), F.col(pos).alias("pos"))) \
        .when(F.col("_m2").isNotNull(), F.struct(F.col(f"_m2.{label}").alias("label"), F.col(pos).alias("pos")))
    up = F.coalesce(peer, F.col("_above"))
    own = F.col(is_ref).cast("int")
    n = F.col("_n") - own
    return j.select(*df.columns, F.col("_below.label").alias("down_label"), F.col("_below.pos").alias("down_pos"),
                    up["label"].alias("up_label"), up["pos"].alias("up_pos"),
                    ((F.col("_sum") - F.when(F.col(is_ref), F.col(label)).otherwise(0)) / F.nullif(n, F.lit(0))).alias("path_mean"), n.alias("path_n"))
