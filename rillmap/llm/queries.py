"""One query per operator, over its whole table, and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.llm.decontamination import contaminated, find_contamination, n_hit
from rillmap.llm.language import held_out, identify_language
from rillmap.llm.line_dedup import dedup_lines
from rillmap.llm.metric_tree import exact_top_k
from rillmap.llm.near_duplicates import near_duplicates
from rillmap.llm.packing import best_fit_packing
from rillmap.llm.personal_data import KINDS, find_personal_data
from rillmap.llm.substring_dedup import dedup_substrings
from rillmap.llm.suffix_dedup import dedup_suffixes
from rillmap.llm.token_files import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents").select("doc_id", "text"), vocabulary())


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(table(spark, folder, "documents").select("doc_id", "text"), vocabulary())


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_exact_top_k", """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


@query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, folder, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@query("op7_personal_data")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM l),
c AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS later FROM w WHERE following IS NOT NULL),
g AS (SELECT doc_id, pos FROM c WHERE later UNION SELECT doc_id, pos + 1 FROM c WHERE later),
m AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS opens FROM m)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE opens) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM r GROUP BY doc_id""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_suffixes(table(spark, folder, "documents").select("doc_id", "text"))
