"""From raw documents to packed training sequences. Each stage works on what its predecessor kept and was written as Parquet.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the packed pieces. Rows without ``doc_id`` are kept wherever a
stage does not reject their text; null texts have no language and leave in the first stage; an empty table stays empty. Own columns keep their values whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.llm.decontamination import contaminated, find_contamination
from rillmap.llm.language import UNKNOWN, identify_language
from rillmap.llm.line_dedup import MIN_LINES, MIN_WORDS, dedup_lines
from rillmap.llm.near_duplicates import near_duplicates
from rillmap.llm.packing import best_fit_packing
from rillmap.llm.queries import table, vocabulary
from rillmap.session import scratch_path

ORACLE_SQL = None       # the language model and the packing have no SQL form; tests compare with a brute-force version


def whole(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and each row as one column, so that no operator's column takes the place of an own one."""
    return docs.select(*[c for c in ("doc_id", "text", "lang") if c in docs.columns], F.struct(*docs.columns).alias("whole_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language leave."""
    return identify_language(whole(docs)).where(F.col("lang_pred") != UNKNOWN).select("whole_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs and of single long lines are deleted; a document with nothing left leaves."""
    found = dedup_lines(whole(docs), MIN_LINES, MIN_WORDS).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"whole_row.`{c}`")).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of the smallest id stays, once; of several texts with this id the one of the smallest hash.

    Rows are told apart by id and text, so two texts that share an id are two documents and rows that repeat both are one. Texts without words and rows without id stay.
    """
    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_hash"), F.struct(*docs.columns).alias("whole_row"))
    found = near_duplicates(rows, keep=("text_hash",))
    stays = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*").distinct()
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = rows.join(stays, ["doc_id", "text_hash"], "left_semi").unionByName(rows.where(F.col("doc_id").isNotNull() & wordless))
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("whole_row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark leave."""
    return find_contamination(whole(docs), table(spark, sf_dir, "benchmark"), ["whole_row"]).where(~contaminated()).select("whole_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return best_fit_packing(docs.select("doc_id", "text"), vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
