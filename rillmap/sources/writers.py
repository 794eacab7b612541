"""Sinks and materialised tables."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, csv: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Parquet, and a CSV twin on request."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}.csv")


def append_chunk(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("append").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Nested metrics as one JSON record per model; a report, so one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as e:  # the file system decides what a missing path looks like
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def materialise_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], not_null: Sequence[str] = ()) -> DataFrame:
    """Reuse a derived table or build and write it; the tag columns must not hold NULL."""
    if not exists(spark, path):
        df = build()
        for c in not_null:
            df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is NULL")).cast(df.schema[c].dataType)))
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
