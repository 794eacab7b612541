"""Queries of the operators on words, conversations and sketches, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.llm.prefix_trie import rebuild, trie, turn_ids
from rillmap.llm.queries import query, table
from rillmap.llm.sketch_join import sketch_components
from rillmap.llm.spelling import occurrences, runs, shortened, spelling_variants

_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
#: As many ASCII signs other than a-z as there are letters beyond them: DuckDB's ``levenshtein`` counts bytes, so each letter becomes one.
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "!#$%&()*+,-./:;<=>?@[]^_{|}~"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in DuckDB: eight shifts a byte, the byte joins at the first."""
    byte = f"list_transform(range(0, 8 * octet_length(encode({text}))), lambda i: CASE WHEN i % 8 = 0 THEN CAST('0x' || substr(hex(encode({text})), i // 4 + 1, 2) AS BIGINT) ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"


@query("op12_spelling_variants", f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM o GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM c),
s AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_LETTERS}', '{_BYTES}') AS b FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
p AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM w x JOIN w y ON length(y.b) BETWEEN length(x.b) - 1 AND length(x.b) + 1 AND levenshtein(x.b, y.b) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS i, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * w.n THEN r.other END AS form, CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n
        FROM w LEFT JOIN r ON w.word = r.word AND r.i = 1),
t AS (SELECT word, word AS root, form AS following FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.following = f.word)
SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN t ON f.word = t.word AND t.following IS NULL""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = runs(table(spark, folder, "documents").select("doc_id", "text"))
    return spelling_variants(occurrences(found.select(shortened(F.col("doc_id"), F.col("run")).alias("word"))))


@query("op11_prefix_trie", f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, {{'r': role, 't': text}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS pos FROM o),
c AS (SELECT conv_id, count(*) AS n, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h, conv_id - conv_id % 100 AS source FROM n GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(s.n, 0)) AS lent FROM c LEFT JOIN c s ON c.source = s.conv_id),
b AS (SELECT k.conv_id, n.pos, n.x FROM k JOIN n ON n.conv_id = k.source AND n.pos < k.h
      UNION ALL SELECT k.conv_id, n.pos - k.h + k.lent, n.x FROM k JOIN n ON n.conv_id = k.conv_id AND n.pos >= k.h),
l AS (SELECT k.conv_id, coalesce(list(b.x ORDER BY b.pos) FILTER (WHERE b.pos IS NOT NULL), []) AS xs FROM k LEFT JOIN b ON k.conv_id = b.conv_id GROUP BY k.conv_id),
e AS (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS depth FROM l),
g AS (SELECT depth, xs[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(xs) = depth) AS ends
        FROM e GROUP BY depth, xs[1:depth]),
p AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
q AS (SELECT g.*, coalesce(p.n_children, 0) AS n_children, a.conv_id AS parent_conv_id, CASE WHEN g.depth = 0 THEN 0 ELSE (g.n_convs - 1) * length(g.path[g.depth].t) END AS w
        FROM g LEFT JOIN p ON g.depth = p.depth AND g.path = p.path LEFT JOIN g a ON a.depth = g.depth - 1 AND a.path = g.path[1:g.depth - 1]),
u AS (SELECT path[1:up] AS path, up AS depth, w, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM q)),
z AS (SELECT depth, path, sum(w) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM u GROUP BY ALL)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, q.parent_conv_id, CAST(q.n_convs AS BIGINT) AS n_convs, CAST(q.n_children AS BIGINT) AS n_children,
       CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, sha256(coalesce(q.ends, '')) AS ends_sha256
  FROM q JOIN z ON q.depth = z.depth AND q.path = z.path""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie(rebuild(turn_ids(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))).drop("tid")


@query("op13_sketch_components", """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS shingle FROM w),
n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x.a, x.b FROM x JOIN n p ON x.a = p.doc_id JOIN n q ON x.b = q.doc_id WHERE 100 * x.shared >= 80 * (p.n + q.n - x.shared)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT l.b, r.reached FROM r JOIN l ON r.doc_id = l.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return sketch_components(table(spark, folder, "documents").select("doc_id", "text"))
