"""Removal of repeated line runs with a suffix array over line ids, built by distributed prefix doubling.

Every line is a symbol; the corpus is the sequence of lines of all documents and a suffix never leaves its document. Rank 1 orders suffixes by their first line,
and a doubling round orders them by the pair (rank here, rank ``depth`` lines further on), so ranks always sort suffixes by their first ``depth`` lines.
A suffix that shares its prefix with no other can start no repeated run and leaves the table, as does each whose second half has left. New ranks
are row numbers of the sorted distinct pairs, spread over range partitions: a pair held by a third of all lines is one row there. After doubling to
``min_lines`` the rows of one rank are exactly the suffixes of one longest-common-prefix interval of that depth or more. The first of them in
(doc_id, line) order stays; the others start later copies, and the lines these cover, joined where they touch, are the maximal repeated runs to delete.
With ``min_words`` one line of so many words (separated by ASCII white space) counts as a run too: the groups of such lines are intervals of depth 1. The
first of them always stays, as no longer run could start or hold it earlier.

A null text has no lines; an empty text is one empty line. Rows without ``doc_id`` are returned unchanged and take no part. Rows that repeat a ``doc_id`` and
text are one document and get the same result; rows that share only the ``doc_id`` are ordered by a hash of their texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.session import cut

MIN_LINES = 2
MIN_WORDS = 50


def _ranked(keys: DataFrame, names: list[str], rank: str) -> DataFrame:
    """Distinct keys with a number that grows in their order."""
    return cut(keys.repartitionByRange(*names).sortWithinPartitions(*names).withColumn(rank, F.monotonically_increasing_id()))


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """(doc_id, h, pos, r) of the suffixes of ``lines`` (doc_id, h, pos, key) that share their first ``depth`` lines with another; r sorts them."""
    shared = lines.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows = lines.join(_ranked(shared, ["key"], "r"), "key").drop("key")
    reached = 1
    while reached < depth:
        step = min(reached, depth - reached)
        ahead = Window.partitionBy("doc_id", "h").orderBy("pos").rangeBetween(step, step)
        rows = cut(rows.withColumn("r2", F.max("r").over(ahead)).where(F.col("r2").isNotNull()))
        pairs = rows.groupBy("r", "r2").agg(F.count("*").alias("c")).where("c > 1").select("r", "r2")
        rows = rows.join(_ranked(pairs, ["r", "r2"], "new"), ["r", "r2"]).select("doc_id", "h", "pos", F.col("new").alias("r"))
        reached += step
    return rows


def _later(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, h, pos) of ``rows`` that have the value ``name`` of another row before them."""
    place = F.struct("doc_id", "h", "pos")
    first = rows.groupBy(name).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first").drop("last")
    return rows.join(first, name).where(place > F.col("first")).select("doc_id", "h", "pos")


def later_copies(docs: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(doc_id, h, starts): where in each document a run starts that also starts earlier, as (pos, n): ``min_lines`` lines, or one of ``min_words`` words."""
    text = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    split = text.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.unhex(F.md5("line")).alias("key")
    lines = split.select("doc_id", "h", "pos", key)
    copies = _later(suffix_ranks(lines.dropDuplicates(["doc_id", "h", "pos"]), min_lines), "r").withColumn("n", F.lit(min_lines))
    if min_words is not None:
        long = (F.length("line") >= 2 * min_words - 1) & (F.regexp_count("line", F.lit("[^ \\x09-\\x0D]+")) >= min_words)
        copies = copies.unionByName(_later(split.where(long).select("doc_id", "h", "pos", key), "key").withColumn("n", F.lit(1)))
    return copies.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("starts"))


def _covered() -> Column:
    """Line numbers that the copies cover, in order."""
    spread = F.flatten(F.transform("starts", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    return F.array_distinct(F.coalesce(spread, F.expr("CAST(array() AS array<int>)")))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``kept_text``, ``n_lines``, ``n_removed`` and ``n_runs`` (maximal deleted runs)."""
    docs = docs.drop("kept_text", "n_lines", "n_removed", "n_runs")
    copies = later_copies(docs.select("doc_id", "text"), min_lines, min_words).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "starts")
    joined = docs.join(copies, (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left")
    lines = F.split("text", "\n", -1)
    every = F.when(F.col("text").isNull(), F.expr("CAST(array() AS array<int>)")).otherwise(F.sequence(F.lit(0), F.size(lines) - 1))
    known = joined.withColumns({"_cover": _covered(), "_lines": lines})
    kept = F.array_join(F.transform(F.array_except(every, F.col("_cover")), lambda i: F.get("_lines", i)), "\n")
    return known.select(*docs.columns, F.when(F.size("_cover") > 0, kept).otherwise(F.col("text")).alias("kept_text"),
                        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), F.size("_cover").cast("long").alias("n_removed"),
                        F.size(F.array_except("_cover", F.transform("_cover", lambda c: c + 1))).cast("long").alias("n_runs"))
