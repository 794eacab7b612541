"""Registry of queries: a Spark plan and, where SQL can say it, the same query in ANSI SQL over the same tables."""
from __future__ import annotations

import re
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Derived tables over the given ones; the same text runs in both engines.
VIEWS: dict[str, str] = {
    "px_points": """
SELECT c_custkey AS pid, CAST((c_custkey*7919)%20011 AS DOUBLE) AS x, CAST((c_custkey*104729)%20011 AS DOUBLE) AS y,
       c_nationkey AS grp, n_regionkey AS region, c_acctbal AS v, c_mktsegment AS seg_name
  FROM customer JOIN nation ON c_nationkey=n_nationkey""",
    "px_structs": """
SELECT p_partkey AS sid, CAST((p_partkey*6151+37)%20011 AS DOUBLE) AS sx, CAST((p_partkey*92821+11)%20011 AS DOUBLE) AS sy,
       p_size AS size_m, p_type AS kind, p_name AS sname
  FROM part""",
    "px_lines": """
SELECT s_suppkey AS lid, CAST(seg AS INT) AS seg, CAST((s_suppkey*3571)%20011+seg*300 AS DOUBLE) AS x1,
       CAST((s_suppkey*15485)%20011+CASE WHEN seg=1 THEN (s_suppkey%7)*50 ELSE 0 END AS DOUBLE) AS y1,
       CAST((s_suppkey*3571)%20011+(seg+1)*300 AS DOUBLE) AS x2,
       CAST((s_suppkey*15485)%20011+CASE WHEN seg=0 THEN (s_suppkey%7)*50 ELSE 0 END AS DOUBLE) AS y2
  FROM (SELECT s_suppkey, 0 AS seg FROM supplier UNION ALL SELECT s_suppkey, 1 AS seg FROM supplier) u""",
    "px_polys": """
SELECT n_nationkey AS gid, CAST((n_nationkey%5)*4000 AS DOUBLE) AS xmin, CAST((n_nationkey%5)*4000+4000 AS DOUBLE) AS xmax,
       CAST(CAST(floor(n_nationkey/5.0) AS INT)*4000 AS DOUBLE) AS ymin,
       CAST(CAST(floor(n_nationkey/5.0) AS INT)*4000+4000 AS DOUBLE) AS ymax
  FROM nation WHERE n_nationkey%6<>5""",
    "px_grid": """
SELECT row_i, col_i, CAST((row_i*31+col_i*17)%97 AS DOUBLE) AS val
  FROM (SELECT DISTINCT CAST(CAST(floor(o_orderkey/50.0) AS BIGINT)%50 AS INT) AS row_i, CAST(o_orderkey%50 AS INT) AS col_i FROM orders) q""",
    "px_surveys": """
SELECT l_orderkey AS code, l_linenumber AS pipe, CAST(l_shipdate AS DATE) AS observed,
       CAST(CASE WHEN l_quantity=1 THEN -1.0 ELSE CAST(l_discount AS DECIMAL(4,2))*10 END AS DOUBLE) AS score,
       CASE WHEN l_quantity=2 THEN NULL WHEN l_returnflag='R' THEN ' Yes ' ELSE 'No' END AS tidal,
       CASE WHEN l_tax=0 THEN NULL ELSE l_linestatus END AS status,
       CAST(CASE WHEN l_quantity<4 THEN -1.0 ELSE l_quantity/10.0 END AS DOUBLE) AS drop_ft, l_partkey, l_suppkey
  FROM lineitem""",
    "px_preds": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_discount AS DECIMAL(4,2))*10 AS DOUBLE) AS y,
       CAST(CAST(0.3 AS DECIMAL(4,2))+CAST(l_discount AS DECIMAL(4,2))*4
            +(CAST(l_tax AS DECIMAL(4,2))-CAST(0.04 AS DECIMAL(4,2)))*2 AS DOUBLE) AS p,
       CAST(CAST(0.5 AS DECIMAL(4,2))+(CAST(l_tax AS DECIMAL(4,2))-CAST(0.04 AS DECIMAL(4,2))) AS DOUBLE) AS p0,
       CAST(l_suppkey%40 AS INT) AS huc, CAST(l_suppkey%13 AS INT) AS st,
       ((l_orderkey*8+l_linenumber)*64+CAST(l_quantity AS BIGINT))*1048576+l_partkey AS rid
  FROM lineitem""",
    "px_path": """
SELECT user_id AS path, ts AS pos, event_id, value AS score, event_type='purchase' AS is_ref
  FROM events""",
}
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TABLE = re.compile(r"(?<=\bFROM )[a-z_]+|(?<=\bJOIN )[a-z_]+")


def view_text(name: str) -> str:
    return VIEWS[name].strip()


def used_views(sql: str) -> list[str]:
    """Derived tables named in a text, each after the ones it needs."""
    found: list[str] = []
    for word in _WORD.findall(sql):
        if word in VIEWS and word not in found:
            for inner in used_views(VIEWS[word]):
                if inner not in found:
                    found.append(inner)
            found.append(word)
    return found


def oracle_text(sql: str) -> str:
    """Prefix a query with the derived tables it names."""
    sql = textwrap.dedent(sql).strip()
    views = used_views(sql)
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({view_text(v)})" for v in views)
    for head in ("WITH RECURSIVE", "WITH"):
        if sql.upper().startswith(head):
            return f"{head} {ctes},\n{sql[len(head):].lstrip()}"
    return f"WITH {ctes}\n{sql}"


class Tables:
    """The given tables of one folder and the derived ones, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        names = {w for w in _TABLE.findall(text) if w in TABLES or w in VIEWS}
        marked = _TABLE.sub(lambda m: "{%s}" % m.group() if m.group() in names else m.group(), text)
        return self.spark.sql(marked, **{n: getattr(self, n) for n in names})


def query(key: str, oracle: str | None = None):
    """Register a plan ``f(tables) -> DataFrame`` under a key, with its SQL twin."""

    def add(build: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            ORACLES[key] = oracle_text(oracle)
        return build

    return add
