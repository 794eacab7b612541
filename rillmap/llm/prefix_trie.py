"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn is named by a digest of its role and text and its length in code points (``tid``), so no text is moved twice. A conversation becomes rows of
``WIDTH`` positional columns t1 ... t8, one row per block of eight turns; a block carries the key of the node at which the block before it ended: the sum of
two 63-bit hashes over (place, turn) of all turns before, about 126 bits, which a running sum by range partition gives to all blocks at once, however
long a conversation is. One ``GROUP BY block, key, ROLLUP (t1, ..., t8)`` then aggregates all prefixes of all conversations together; the grouping id tells the
depth. A prefix that a third of all conversations share is combined before the shuffle. Groups of shorter conversations (a null at their own
depth) are dropped.

A node is known by its smallest member and its depth. What a node saves is filed under that member, summed from the end of the member's path, and a second
ROLLUP adds these sums up over the members: this is the sum over the subtree. Childless nodes are counted the same way.
Hashes over the members that end at a node are made from runs of ids that range partitions join in parallel and one stream per node hashes in order, with
constant memory.

Turns are ordered by ``turn`` (null first), ties by the digest, so repeated rows are turns of their own. Null roles and texts are empty. Rows
without ``conv_id`` take no part. An empty table has no nodes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.operators.ranking import running_sums, with_rank
from rillmap.session import cut

WIDTH = 8
MOST_BORROWED = 5
RUN_IDS = 4096                          # ids joined to one text before they are hashed
SLOTS = [f"t{k}" for k in range(1, WIDTH + 1)]
_KEY = "decimal(38,0)"


def _named() -> tuple[Column, Column, Column]:
    """The name, role and text of a turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.unhex(F.substring(digest, 1, 32)), F.encode(F.length(text).cast("string"), "UTF-8")), role, text


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, tid) of ``conversations`` (conv_id, turn, role, text): places from 0 and a name for (role, text) that ends with the text's length."""
    tid, _, _ = _named()
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", tid.alias("tid"))
    return with_rank(turns, ["turn", "tid"], ["conv_id"], "rn").select("conv_id", (F.col("rn") - 1).alias("pos"), "tid")


def turn_length(tid: Column) -> Column:
    return F.substring(tid, 17, 20).cast("string").cast("long")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its id as text, modulo 6."""
    return F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % (MOST_BORROWED + 1)


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, tid) of conversations that start with the first h turns of conversation ``c - c % 100`` and go on with their own turns after the
    first h. One that is left without turns is one row of null ``pos``."""
    heads = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = heads.select("conv_id", borrowed_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("source"))
    known = cut(asked.join(heads.select(F.col("conv_id").alias("source"), "n"), "source", "left").select(
        "conv_id", "source", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("lent")))
    own = turns.join(known, "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "tid")
    firsts = turns.where(F.col("pos") < MOST_BORROWED).select(F.col("conv_id").alias("source"), "pos", "tid")
    lent = known.join(firsts, "source").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "tid")
    none = known.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"))
    return own.unionByName(lent).unionByName(none)


def _marks(block: Column, slot: int) -> tuple[Column, Column]:
    """Two hashes of a turn at its place; nothing for an empty slot."""
    place, t = block * WIDTH + slot, F.col(SLOTS[slot])
    return tuple(F.when(t.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(h, 1)).cast(_KEY) for h in (F.xxhash64(place, t), F.xxhash64(F.lit("second"), t, place)))


def _sums(block: Column) -> tuple[Column, Column]:
    marks = [_marks(block, k) for k in range(WIDTH)]
    return tuple(sum((m[i] for m in marks[1:]), marks[0][i]).cast(_KEY) for i in (0, 1))


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per block of turns: (conv_id, block, t1 ... t8, k1, k2: the key of the node before it, r1, r2: that of the node at its end)."""
    block = F.coalesce(F.floor(F.col("pos") / WIDTH), F.lit(0)).cast("long")
    slots = [F.max(F.when(F.col("pos") % WIDTH == k, F.col("tid"))).alias(s) for k, s in enumerate(SLOTS)]
    rows = turns.withColumn("block", block).groupBy("conv_id", "block").agg(*slots)
    s1, s2 = _sums(F.col("block"))
    summed = running_sums(rows.withColumns({"s1": s1, "s2": s2}), ["block"], {"s1": "r1", "s2": "r2"}, ["conv_id"])
    key = lambda c: c.cast(_KEY)
    return cut(summed.select("conv_id", "block", *SLOTS, key(F.col("r1") - F.col("s1")).alias("k1"), key(F.col("r2") - F.col("s2")).alias("k2"),
                             key(F.col("r1")).alias("r1"), key(F.col("r2")).alias("r2")))


def _rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes at once: the grouping columns, ``level`` (turns of the block that count) and the aggregates."""
    slots = ", ".join(SLOTS)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {slots}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({slots})", blocks=blocks)
    last = F.element_at(F.array(*SLOTS), F.greatest("level", F.lit(1)))
    return rolled.withColumn("tid", F.when(F.col("level") > 0, last)).where(F.col("tid").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))


def _hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): the hash over the ids of each node in ascending order, joined by commas."""
    runs_ddl, out_ddl = "node string, first long, ids string", "node string, ends_sha256 string"
    runs_schema, out_schema = arrow_schema(runs_ddl), arrow_schema(out_ddl)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = []
            for node, group in groupby(rows, lambda r: r[0]):
                ids = [i for _, i in group]
                found += [(node, ids[a], ",".join(map(str, ids[a:a + RUN_IDS]))) for a in range(0, len(ids), RUN_IDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), runs_schema.types)], schema=runs_schema) if found else None

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], schema=out_schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=out_schema)

    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id").mapInArrow(join_ids, runs_ddl)
    return cut(runs).repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digest, out_ddl)


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of ``turns`` (conv_id, pos, tid): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 and ``tid``, the name of its last turn."""
    blocks = blocks_of(turns)
    p1, p2 = _sums(F.col("block"))
    marks = [_marks(F.col("block"), k) for k in range(WIDTH)]
    last = [F.coalesce(*[F.when(F.col("level") == k + 1, m[i]) for k, m in enumerate(marks)], F.lit(0).cast(_KEY)) for i in (0, 1)]
    depth = F.col("block") * WIDTH + F.col("level")
    rolled = _rolled(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs").withColumns({
        "depth": depth, "p1": (F.col("k1") + p1).cast(_KEY), "p2": (F.col("k2") + p2).cast(_KEY), "m1": last[0], "m2": last[1]})
    nodes = cut(rolled.select(
        "conv_id", "depth", "tid", "n_convs", _name(F.col("depth"), F.col("p1"), F.col("p2")).alias("node"),
        F.when(F.col("depth") > 0, _name(F.col("depth") - 1, F.col("p1") - F.col("m1"), F.col("p2") - F.col("m2"))).alias("parent")))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(above, "parent", "left"))

    # what each node adds, at its place on the path of its smallest member
    place = F.greatest(F.col("depth") - 1, F.lit(0))
    saved = (F.col("n_convs") - 1) * F.coalesce(turn_length(F.col("tid")), F.lit(0))
    own = known.select("conv_id", F.floor(place / WIDTH).cast("long").alias("block"), (place % WIDTH).alias("slot"), saved.alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    own = own.groupBy("conv_id", "block").agg(*[F.sum(F.when(F.col("slot") == k, F.col("w")).otherwise(0)).alias(f"w{k}") for k in range(WIDTH)], F.sum("leaf").alias("leaf"))
    weights = [F.coalesce(f"w{k}", F.lit(0)) for k in range(WIDTH)]
    paths = blocks.select("conv_id", "block", "k1", "k2", *SLOTS).join(own, ["conv_id", "block"], "left").select(
        "conv_id", "block", "k1", "k2", *SLOTS, *[w.alias(f"w{k}") for k, w in enumerate(weights)], F.coalesce("leaf", F.lit(0)).alias("leaf"),
        sum(weights[1:], weights[0]).alias("total"), (-F.col("block")).alias("back"))
    paths = running_sums(paths, ["back"], {"total": "after", "leaf": "leaves"}, ["conv_id"])
    rest = [F.col("after") - sum((F.col(f"w{j}") for j in range(k)), F.lit(0)) for k in range(WIDTH)]
    paths = paths.select("conv_id", "block", "k1", "k2", *SLOTS, "leaves", "after", *[r.alias(f"s{k + 1}") for k, r in enumerate(rest)])
    adds = ", ".join(["min(conv_id) AS conv_id", "sum(leaves) AS n_leaves", "sum(after) AS s0", *[f"sum(s{k}) AS s{k}" for k in range(1, WIDTH + 1)]])
    below = _rolled(paths, adds).select("conv_id", depth.alias("depth"), "n_leaves",
                                        F.element_at(F.array(*[f"s{k}" for k in range(WIDTH + 1)]), F.col("level").cast("int") + 1).alias("saved_tokens"))

    length = sum((F.col(s).isNotNull().cast("long") for s in SLOTS[1:]), F.col(SLOTS[0]).isNotNull().cast("long"))
    at_end = blocks.groupBy("conv_id").agg(F.max(F.struct("block", length.alias("n"), "r1", "r2")).alias("e"))
    ends = at_end.select("conv_id", _name(F.col("e.block") * WIDTH + F.col("e.n"), F.col("e.r1"), F.col("e.r2")).alias("node"))
    return (known.join(below, ["conv_id", "depth"]).join(_hashes(cut(ends)), "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "tid"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are; the last turn of a node is its ``tid``, to be joined with ``turn_texts``."""
    return trie(turn_ids(conversations))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(tid, role, text) of every distinct turn, nulls as empty texts."""
    tid, role, text = _named()
    return conversations.select(tid.alias("tid"), role.alias("role"), text.alias("text")).dropDuplicates(["tid"])
