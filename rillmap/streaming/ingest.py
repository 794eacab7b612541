"""Incremental landing with Structured Streaming: every file once, every key once."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillmap.operators.ranking import keep_best
from rillmap.sources import commits as CO
from rillmap.sources.writers import exists


def ingest_new_files(spark: SparkSession, landing: str, schema: StructType, sink: str, checkpoint: str, fmt: str = "parquet", per_trigger: int = 1000) -> None:
    """Append what has landed since the last run; finished files are known from the checkpoint and are skipped."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(landing)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_distinct(spark: SparkSession, landing: str, schema: StructType, sink: str, checkpoint: str, key: str, order: list[str], fmt: str = "parquet",
                    per_trigger: int = 1000, buckets: int = 64) -> None:
    """As above, keeping each key once over all batches.

    A batch is written under its own number and compared with the other batches only, so a batch that is run again after a
    failure replaces its own output. The known keys live in the sink and not in stream state, which would grow without end; the
    sink is partitioned by a hash of the key, and a batch reads the key column of the buckets that its own keys fall in.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = keep_best(batch, [key], order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if exists(spark, sink):
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]        # at most ``buckets`` numbers
            known = spark.read.parquet(sink).where((F.col("batch") != number) & F.col("bucket").isin(touched)).select("bucket", key)
            fresh = fresh.join(known, ["bucket", key], "left_anti")
        fresh.write.partitionBy("bucket").mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(landing)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_within(spark: SparkSession, landing: str, schema: StructType, sink: str, checkpoint: str, key: str, time: str, delay: str, fmt: str = "parquet",
                  per_trigger: int = 1000, most_runs: int = 64) -> list[dict]:
    """Each key once among rows whose ``time`` lies within ``delay`` of the latest one seen, known from keyed state that the watermark empties.

    State holds the keys of the last ``delay`` only, however long the stream runs, and no batch reads the sink. What comes later than the watermark is not
    taken, repeat or not; where such rows must be kept whole use ``ingest_distinct``. A row without a key is compared with other such rows; a row without a time
    stops the stream with an error. Of repeats in one batch any one stays. Every batch is a run with a commit record (``commits.append_run``), so a batch
    that is run again changes nothing; more than ``most_runs`` runs are compacted into one after the stream has caught up. Read the sink by ``commits.read_committed``.
    Gives the progress records of the batches.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(landing)
    timed = F.coalesce(F.col(time), F.raise_error(F.lit(f"{time} is NULL")).cast(schema[time].dataType))
    once = stream.withColumn(time, timed).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    name = lambda number: f"batch-{number:012d}"
    running = (once.writeStream.foreachBatch(lambda batch, number: CO.append_run(batch, sink, name(number)) and None)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    running.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in running.recentProgress]
    last = CO.commits(spark, sink).agg(F.max("run")).first()[0]
    if last is not None:
        CO.compact(spark, sink, f"{last}-all" if not last.endswith("-all") else last, most_runs + 1)
    return progress
