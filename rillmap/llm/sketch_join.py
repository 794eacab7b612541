"""Near-duplicate components by bottom-k sketches.

A document is the set of its distinct two-word shingles (A-Z lower-cased; words are runs between ASCII blanks; a shorter text that has words is one shingle).
Words are named by BLAKE2b of their bytes and shingles by mixing two names, so no choice of words makes two sets look alike. Documents of equal sets are
one class from the start. A class keeps the ``K`` smallest values of one hash function over its set, all of them if it has fewer.

Inverted lists hold the classes by what they retained. A single value can be retained by a third of all documents, so a list belongs to ``RUN``
consecutive retained values: unrelated documents do not share those, however common each value is. Two sets of similarity 0.8 that both fit
into their sketches always share such a run, since at most a fifth of their union separates the shared values (two values for sets of at most five);
of larger ones about 1 pair in 10^10 does not (``percent`` below 80 finds less). The members of a list are first compared with its smallest member only, so a list of any length costs
one row a member. The overlap of two sketches among the ``K`` smallest values of their union estimates the similarity; pairs ``MARGIN`` below the threshold
go, the others are verified on their full sets. Lists whose members are not yet in one component after that are open. Open lists of at most ``SHORT`` members
carry the sketches of their members into one task, where one product estimates all their overlaps; the promising pairs of different components and sizes that fit
are verified alike. Longer ones come from a passage that many texts hold. Two near sets share ``COVER`` lists or more (all but 1 pair in 10^8, and by count where
both fit into their sketches and one has more than eight shingles), so a class that stands in fewer long open lists meets each of its near sets in another list.
The remaining classes, and all of at most ``TINY`` shingles in long open lists, are compared with each other, inside groups that long lists connect, by size
(each with its own and the next band of sizes) and in blocks of ``BLOCK``; a block gives a spanning forest of its links. The components of all verified links name the documents.

Texts without words and null texts have an empty set and stay alone. Rows without ``doc_id`` come back with a null component and are kept. Rows that share
a ``doc_id`` are judged each by its own text. An empty table has no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.components import components
from rillmap.llm.hashing import mix, ragged
from rillmap.session import cut

SHINGLE = 2
PERCENT = 80                    # shared shingles of a link, in hundredths of the union
K, RUN = 64, 3
MARGIN = 0.25                   # five standard deviations of the estimate at 0.8
BLOCK, STAR = 512, 64           # members of two blocks, members compared with one centre in a task
SHORT, COVER = 64, 3            # members of a short list, lists that two near sets share at least
TINY = 12                       # sets of up to this size may share fewer lists
BAND = 1.25                     # sizes of near sets differ by no more than this factor
WORDS = 1 << 20                 # known words of a task
BATCH_BYTES = 8 << 20           # sets that leave a task at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Names(dict):
    """64-bit names of words; emptied when it holds ``WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        name = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return name


def shingle_set(text: str | None, names: _Names, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()           # of bytes: only A-Z, only ASCII blanks
    named = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    if not len(named):
        return named
    have = max(1, len(named) - size + 1)
    held = np.full(have, min(size, len(named)), np.uint64)
    for k in range(min(size, len(named))):
        held = mix(held * _GOLD + named[k:k + have])
    return np.unique(held)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, f1, f2, sketch): size and fingerprint of each set and its ``K`` smallest values as unsigned 64-bit numbers."""
    ddl = "doc_id long, n long, f1 long, f2 long, sketch binary"
    schema = arrow_schema(ddl)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            count, low, prints = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), names, size)
                count.append(len(own))
                low.append(own[:K].tobytes())
                prints.append((int(mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ _GOLD).sum(dtype=np.uint64).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)), pa.array(low, pa.binary())],
                                             schema=schema)

    return docs.select("doc_id", "text").mapInArrow(sign, ddl)


def posting_keys(sketch: np.ndarray) -> np.ndarray:
    """The keys of the lists a sketch stands in: one for each run of consecutive values. Sets of four and five meet in runs of two, larger ones in runs
    of three, sets of five in both; a set of three or fewer equals every set it is near to."""
    found = [np.zeros(0, np.uint64)]
    for run in [2] * (4 <= len(sketch) <= 5) + [RUN] * (len(sketch) >= 5):
        held = np.full(len(sketch) - run + 1, run, np.uint64)
        for k in range(run):
            held = mix(held * _GOLD + sketch[k:k + len(held)])
        found.append(held)
    return np.concatenate(found)


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, n) of every class."""
    ddl = "key long, node long, n long"
    schema = arrow_schema(ddl)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [posting_keys(np.frombuffer(s, np.uint64)) for s in batch.column(1).to_pylist()]
            node, n = (np.repeat(batch.column(i).to_numpy(), [len(k) for k in keys]) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(n)], schema=schema)

    return classes.where("n > 3").select("node", "sketch", "n").mapInArrow(post, ddl)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by the smallest values of the union of their sketches; exact where both sets fit."""
    union = np.union1d(a, b)
    if len(a) == K or len(b) == K:                                                  # beyond a full sketch's last value the other is blind
        limit = min(s[-1] for s in (a, b) if len(s) == K)
        union = union[union <= limit][:K]
    return float((np.isin(union, a) & np.isin(union, b)).sum() / max(1, len(union)))


def promising(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, sketch_a, sketch_b) whose estimated similarity is at least ``least``."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()]) for c in (2, 3))
            keep = pa.array([estimate(x, y) >= least for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], schema=schema)

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(sift, ddl)


def estimates(sketch: list[np.ndarray]) -> np.ndarray:
    """The estimated similarity of each two sets, by all values of both sketches up to the end of the shorter reach; exact where both sets fit."""
    held = np.array([len(s) for s in sketch], np.int64)
    reach = np.array([s[-1] if len(s) == K else np.iinfo(np.uint64).max for s in sketch], np.uint64)
    value, place = np.unique(np.concatenate(sketch), return_inverse=True)
    part = np.zeros((len(sketch), len(value)), np.float32)
    part[np.repeat(np.arange(len(sketch)), held), place] = 1
    within = np.stack([np.searchsorted(s, reach, side="right") for s in sketch], axis=1)            # [i, j]: values of j within the reach of i
    first = reach[:, None] <= reach[None, :]
    shared = part @ part.T
    return shared / np.maximum(1, np.where(first, held[:, None] + within, held[None, :] + within.T) - shared)


def meet(members: DataFrame, least: float, percent: int) -> DataFrame:
    """The distinct (a, b), a > b, that some list of ``members`` (key, node, n, part, sketch) holds, of different parts, sizes that fit and an estimate of at
    least ``least``. A list is at most ``SHORT`` members and lies in one task, where it is read in the order of keys."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def pairs(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
            key, node, n, part = (table.column(i).to_numpy() for i in range(4))
            sketch = [np.frombuffer(s, np.uint64) for s in table.column(4).to_pylist()]
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            done, found = len(edge) - 1 - (not whole), set()
            for u, v in zip(edge[:done], edge[1:done + 1]):
                near = (part[u:v, None] != part[None, u:v]) & (node[u:v, None] > node[None, u:v])
                near &= 100 * np.minimum(n[u:v, None], n[None, u:v]) >= percent * np.maximum(n[u:v, None], n[None, u:v])
                if near.any():
                    x, y = np.nonzero(near & (estimates(sketch[u:v]) >= least))
                    found.update(zip(node[u + x].tolist(), node[u + y].tolist()))
            out = pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=schema)
            return out, table.slice(edge[done])

        for batch in batches:
            if batch.num_rows:
                out, left = pairs(pa.Table.from_batches([*rest, batch]), False)
                rest = left.to_batches()
                yield out
        if rest:
            yield pairs(pa.Table.from_batches(rest), True)[0]

    rows = members.select("key", "node", "n", "part", "sketch").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(sift, ddl).distinct()


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which two of the sets share ``percent`` hundredths of their union."""
    size = np.array([len(s) for s in sets], np.int64)
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    opens = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    held = np.diff(np.append(opens, len(value)))
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, len(opens), 1 << 12):
        begin, count = opens[a:a + (1 << 12)], held[a:a + (1 << 12)]
        several = count > 1
        at = ragged(begin[several], count[several])
        part = np.zeros((len(sets), int(several.sum())), np.float32)
        part[owner[at], np.repeat(np.arange(part.shape[1]), count[several])] = 1
        shared += (part @ part.T).astype(np.int64)
    return 100 * shared >= percent * (size[:, None] + size[None, :] - shared)


def _forest(nodes: list[int], near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block."""
    out, left = [], set(range(len(nodes)))
    while left:
        reach = [left.pop()]
        while reach:
            x = reach.pop()
            for y in [y for y in np.flatnonzero(near[x]).tolist() if y in left]:
                left.discard(y)
                reach.append(y)
                out.append((nodes[x], nodes[y]))
    return out


def verified(groups: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): a forest of the true links in each group of ``groups`` (group columns g1, g2, g3; node, part), by the full sets of the members. ``part`` of two
    members must differ for their link to count."""
    ddl = "g1 long, g2 long, g3 long, node long, part long, shingles binary"
    schema, out = arrow_schema(ddl), "a long, b long"
    out_schema = arrow_schema(out)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            rows, held, seats = [], 0, batch.column(3).to_pylist()
            for node, print_, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), seats):
                values = shingle_set(text, names, size)
                if int(mix(values + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) == print_:           # a doc_id may have several texts
                    for s in own:
                        rows.append((s["g1"], s["g2"], s["g3"], node, s["part"], values.tobytes()))
                        held += values.nbytes
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def check(key: tuple, rows: pa.Table) -> pa.Table:
        found: dict[int, tuple[int, bytes]] = {}
        for node, part, own in zip(rows["node"].to_pylist(), rows["part"].to_pylist(), rows["shingles"].to_pylist()):
            found.setdefault(node, (part, own))
        nodes = sorted(found)
        part = np.array([found[x][0] for x in nodes])
        near = linked([np.frombuffer(found[x][1], np.uint64) for x in nodes], percent) & (part[:, None] != part[None, :])
        edges = _forest(nodes, near)
        return pa.table([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], schema=out_schema)

    seats = groups.groupBy("node").agg(F.collect_list(F.struct("g1", "g2", "g3", "part")).alias("seats"))
    texts = seats.join(classes.select("node", "rep", "f1"), "node").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("node", "f1", "text", "seats")
    return texts.mapInArrow(fetch, ddl).groupBy("g1", "g2", "g3").applyInArrow(check, out)


def _stars(pairs: DataFrame) -> DataFrame:
    """Groups for ``verified``: the classes ``a`` that are to be compared with one centre ``b``, dealt to tables of about ``STAR`` with the centre at each."""
    pairs = cut(pairs)
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("tables"))
    dealt = cut(pairs.join(crowd, "b").withColumn("g2", F.pmod(F.xxhash64("a"), F.col("tables"))))
    none = F.lit(0).cast("long")
    guests = dealt.select(F.col("b").alias("g1"), "g2", none.alias("g3"), F.col("a").alias("node"), F.col("a").alias("part"))
    return guests.unionByName(dealt.select(F.col("b").alias("g1"), "g2", none.alias("g3"), F.col("b").alias("node"), F.col("b").alias("part")).distinct())


def sketch_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of all ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(sketches(docs, size))
    known = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = cut(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                  .withColumn("node", F.monotonically_increasing_id()))
    sketch = lambda name: classes.select(F.col("node").alias(name), F.col("sketch").alias(f"sketch_{name}"))

    # first every member of a list against its smallest member
    lists = postings(classes)
    heads = lists.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("m")).where("m > 1").select(
        "key", "m", F.col("head.node").alias("b"), F.col("head.n").alias("n_b"))
    lists = cut(lists.join(heads, "key"))
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731 (sizes of near sets)
    pairs = cut(lists.where((F.col("node") > F.col("b")) & fits(F.col("n"), F.col("n_b"))).select(F.col("node").alias("a"), "b").distinct())
    weigh = lambda rows: promising(rows.join(sketch("a"), "a").join(sketch("b"), "b"), percent / 100 - MARGIN)
    links = cut(verified(_stars(weigh(pairs)), classes, docs, percent, size))
    names = components(links)

    # then the short lists that still hold several components
    named = lists.join(names, "node", "left").select("key", "node", "n", "m", F.coalesce("component", "node").alias("component"))
    is_open = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    named = cut(named.where("m > 2").join(is_open, "key"))
    short = named.where(F.col("m") <= SHORT).select("key", "node", "n", F.col("component").alias("part"))
    met = meet(short.join(classes.select("node", "sketch"), "node"), percent / 100 - MARGIN, percent).join(pairs, ["a", "b"], "left_anti")
    more = cut(verified(_stars(met), classes, docs, percent, size))

    # and the classes that long ones might keep from meeting
    long = named.where(F.col("m") > SHORT)
    exposed = long.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).where((F.col("k") >= COVER) | (F.col("n") <= TINY)).select("node")
    held = cut(long.join(exposed, "node"))
    first = held.groupBy("key").agg(F.min("node").alias("b"))
    groups = components(held.join(first, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("long")
    member = groups.join(classes.select("node", band.alias("band")), "node").join(held.select("node", F.col("component").alias("part")).distinct(), "node")
    member = cut(member.select("component", "node", "part", F.explode(F.array("band", F.col("band") + 1)).alias("g1")))
    parts = member.groupBy("component", "g1").agg(F.ceil(2 * F.count("*") / BLOCK).alias("parts"), F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
    dealt = member.join(parts, ["component", "g1"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    seats = dealt.select(F.xxhash64("component", "g1").alias("g1"), F.least("own", "other").alias("g2"), F.greatest("own", "other").alias("g3"), "node", "part")
    last = cut(verified(seats, classes, docs, percent, size))
    names = components(links.unionByName(more).unionByName(last))

    joined = classes.select("node", "f1", "f2", "rep").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_doc = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = joined.join(least_doc, "component").select("f1", "f2", "component_id")
    alone = signed.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = known.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(by_set, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
