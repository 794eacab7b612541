"""Appends with a commit record: a run that is repeated, or was killed half way, counts once.

A table is a folder with ``rows/run=<id>`` (Parquet) and ``commits/run=<id>`` (one JSON record: the run, its files, its number of rows and the runs it takes the
place of). Rows are written first and the record last, so readers, who follow the records only, see all rows of a run or none. A run that has its record is
never written again. Compaction writes a new run that takes the place of several; the old files stay until ``clean``, so running readers keep their files.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "run string, files array<string>, n_rows bigint, replaces array<string>"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The records that count: those whose run no other record takes the place of."""
    try:
        every = spark.read.schema(RECORD).option("recursiveFileLookup", True).json(f"{path}/commits")
    except Exception as e:  # the file system decides what a missing path looks like
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)
    return every.join(every.select(F.explode("replaces").alias("run")), "run", "left_anti").select("run", "files", "n_rows", "replaces")


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    """Whether a run has its record, replaced or not."""
    try:
        return not spark.read.schema(RECORD).json(f"{path}/commits/run={run}").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def append_run(df: DataFrame, path: str, run: str, replaces: Sequence[str] = ()) -> bool:
    """Add the rows of ``df`` under the name ``run``; False, and nothing written, if this run is there already.

    Rows of an attempt that did not reach its record are overwritten. A table without rows gives a run of no rows. Run names are letters, digits and ``-_.``.
    """
    spark = df.sparkSession
    if not run or any(not (c.isalnum() or c in "-_.") for c in run):
        raise ValueError(f"run name {run!r}")
    if is_committed(spark, path, run):
        return False
    target, seen = f"{path}/rows/run={run}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(target)
    files = spark.read.parquet(target).inputFiles()
    record = spark.createDataFrame([(run, sorted(files), seen.get["n"], list(replaces))], RECORD)
    record.coalesce(1).write.mode("overwrite").json(f"{path}/commits/run={run}")
    return True


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all runs that count. A run whose files are not all there is an error; a table without runs too. Columns that only later runs have are null in
    the earlier ones."""
    runs = commits(spark, path).select("run", "files").collect()                # a record a run; compaction keeps them few
    files = sorted(f for r in runs for f in r["files"])
    if not files:
        raise ValueError(f"no committed run in {path}")
    return spark.read.option("mergeSchema", True).option("ignoreMissingFiles", False).parquet(*files)


def compact(spark: SparkSession, path: str, run: str, least: int = 2, rows_per_file: int = 5_000_000) -> bool:
    """Write all runs that count as one new run, if there are at least ``least`` of them. Killed before its record, it has changed nothing for readers."""
    now = commits(spark, path).agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows"), F.sort_array(F.collect_list("run")).alias("runs")).first()
    if now["n"] < least:
        return False
    parts = max(1, -(-now["rows"] // rows_per_file))
    return append_run(read_committed(spark, path).repartition(parts), path, run, now["runs"])


def clean(spark: SparkSession, path: str) -> int:
    """Delete the rows of runs that a compaction took the place of; their records stay, so a repeat of such a run still counts as done."""
    old = commits(spark, path).select(F.explode("replaces").alias("run")).distinct().collect()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(bool(system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/run={r[0]}"), True)) for r in old)
