"""The prefix trie against a trie built with dictionaries."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rillmap.llm import prefix_trie as module
from rillmap.llm.prefix_trie import prefix_trie, turn_texts
from rillmap.llm.registry import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, pos long, tid string, block long"


def by_turn(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += node not in children
            below[node[:d]][1] += (len(own) - 1) * len(node[-1][1]) if node else 0
    ends = defaultdict(list)
    for c, turns in paths.items():
        ends[tuple(turns)].append(c)
    return {(min(own), len(node)): (min(members[node[:-1]]) if node else None, len(own), children[node], *below[node],
                                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, own in members.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, -1, "clash", -1) for r in rows], SCHEMA).repartition(3)


def found(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


def talks():
    """Shared beginnings, copies of a whole talk, a talk of many turns and copies of it, null turns, roles and texts, rows without id."""
    rng, rows = random.Random(3), []
    for c in range(90):
        rows += [(c * 7, t, "user" if t % 2 == 0 else "bot", rng.choice(["hi", "yes", "", "né", None])) for t in range(rng.randint(1, 6))]
    long = [("user", f"turn {i} " + "x" * (i % 5)) for i in range(75)]
    for c, n in ((1000, 75), (1001, 75), (1002, 70), (1003, 64), (1004, 8), (1005, 9), (1100, 16), (2001, 1), (2002, 2)):
        rows += [(c, i, *long[i]) for i in range(n)]
    rows += [(c, 0, "user", "same") for c in range(3000, 3040)]
    rows += [(1200, None, "user", "first"), (1200, 5, None, None), (1200, 7, "", ""), (1201, 1, "user", "twice"), (1201, 1, "user", "twice"), (None, 1, "user", "lost"), (-5, 0, "user", "below")]
    return rows


@pytest.mark.parametrize("run", [4096, 3])
def test_trie(spark, monkeypatch, run):
    monkeypatch.setattr(module, "RUN_IDS", run)
    rows = talks()
    assert found(prefix_trie(table(spark, rows))) == brute(by_turn(rows))


def test_query(spark, tmp_path):
    rows = [r for r in talks() if r[0] != -5] + [(101, 0, "user", "only turn"), (3100, 0, "user", "a"), (3100, 1, "bot", "b")]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = found(QUERIES["op11_prefix_trie"](spark, str(tmp_path))), brute(rebuilt(by_turn(rows)))
    assert got == want and any(not turns for turns in rebuilt(by_turn(rows)).values())


def test_texts_and_nothing(spark):
    rows = [(1, 0, "user", "hello"), (2, 0, "user", "hello"), (2, 1, None, "é")]
    talk = table(spark, rows)
    named = prefix_trie(talk).where("depth > 0").join(turn_texts(talk), "tid").select("conv_id", "depth", "role", "text").collect()
    assert sorted(map(tuple, named)) == [(1, 1, "user", "hello"), (2, 2, "", "é")]
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
