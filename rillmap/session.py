"""Session settings and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rillmap")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on a local master, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table."""
    return f"{shared_dir(spark)}/rillmap/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Freeze a table with a reliable checkpoint, so that later reads see the same rows after executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Freeze a wide table as compressed Parquet in the shared folder; readers load only the columns they use. Types that Parquet lacks go to ``cut``."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(t in df.schema.simpleString() for t in ("void", "interval", "variant")):
        return cut(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows that the driver holds as a local table. Spark knows its size when it plans a join, so a large table that meets it is not shuffled first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = spark.createDataFrame([], schema).schema
    if not rows or any(t in fields.simpleString() for t in ("time", "interval", "void", "variant", "map<")):
        return spark.createDataFrame(list(rows), fields)
    kinds = to_arrow_schema(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds), fields)
