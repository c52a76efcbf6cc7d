"""Tries against dictionaries of prefixes: shared heads, copies, long conversations, odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import prefix_trie


def rebuilt(rows, most=5):
    """conv_id to its turns after heads are shared; rows are (conv_id, turn, role, text)."""
    own: dict[int, list] = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % (most + 1)
        head = own.get(conv - int(math.fmod(conv, 100)), [])
        made[conv] = head[:h] + turns[h:]
    return made


def brute(rows):
    members: dict[tuple, list[int]] = {}
    turns = rebuilt(rows)
    for conv in sorted(turns):
        for depth in range(len(turns[conv]) + 1):
            members.setdefault(tuple(turns[conv][:depth]), []).append(conv)
    children = {path: [p for p in members if len(p) == len(path) + 1 and p[:-1] == path] for path in members}
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = own + sum(saved[p] for p in children[path])
    found = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(turns[c]) == len(path))
        found.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(children[path]), leaves[path],
                      saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def answer(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.select("*", F.lit("x"), F.lit(1), F.lit(2)).toDF(*table.columns, "TEXT", "key_a", "n")
    return sorted(map(tuple, prefix_trie.conversation_trie(table.repartition(3), **more).collect()), key=repr)


def talk(conv, *said):
    return [(conv, at, "user" if at % 2 == 0 else "assistant", text) for at, text in enumerate(said)]


ROWS = [
    *talk(100, "a", "b", "c", "d", "e", "f", "g"), *talk(101, "x", "y", "z"), *talk(102, "a", "b"), *talk(103, "a", "b", "c", "q"),
    *talk(150, "a"), *talk(151, "a"), *talk(199, *"abcdefg"), *talk(204, "a", "b"), *talk(205, "a", "ü€"), *talk(-7, "n"), *talk(0, "m", "o"),
    (301, None, "user", "first"), (301, 5, None, None), (301, 7, "user", ""), (None, 1, "user", "lost"), *talk(302, ""),
    (303, 1, "user", "twice"), (303, 1, "user", "twice"),
]


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_nodes(spark, segment):
    want = brute(ROWS)
    assert any(row[3] > 1 and row[1] > 2 for row in want) and any(row[1] == 0 and row[4] > 1 for row in want)
    assert answer(spark, ROWS, segment=segment) == want


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [row for conv in rng.sample(range(1000), 150) for row in talk(conv, *rng.choices("abc", k=rng.randint(1, 9)))]
    assert answer(spark, rows) == brute(rows)


def test_copies_and_a_long_conversation(spark):
    """A group of copies with most rows, one conversation over several segments, ids in several blocks."""
    rows = [row for conv in range(1000, 13_000) for row in talk(conv, "hello")] + talk(5, *map(str, range(3000)))
    got = answer(spark, rows)
    turns = rebuilt(rows)
    convs = sorted(c for c in range(1000, 13_000) if turns[c] == [("user", "hello")])
    assert len(convs) > 2 * prefix_trie.BLOCK
    ends = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
    assert [row[:6] for row in got if row[7] == ends] == [(1000, 1, 5, len(convs), 0, 1)]
    deepest = max(got, key=lambda row: row[1])
    assert deepest[:2] == (5, len(turns[5])) and sum(row[0] == 5 and row[1] > 0 for row in got) == len(turns[5])


def test_turnless(spark):
    """Conversations whose heads are cut away and not replaced are members of the root alone."""
    convs = [c for c in range(400, 500) if zlib.crc32(str(c).encode()) % 6 == 5 and c % 100][:3]
    rows = [row for conv in convs for row in talk(conv, "gone")]
    ends = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
    assert answer(spark, rows) == brute(rows) == [(convs[0], 0, None, 3, 0, 1, 0, ends)]


def test_empty(spark):
    assert answer(spark, []) == [] and answer(spark, [(None, 1, "user", "x")]) == []


def test_paths_tell_the_turns_of_a_node(spark):
    """The first turns of a node's conversation are the node: the general form without shared heads."""
    rows = talk(1, "a", "b") + talk(2, "a", "c")
    table = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    convs = table.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    trie = prefix_trie.build(table, convs)
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children) for r in trie.nodes.collect()) == [
        (1, 0, 2, 1), (1, 1, 2, 2), (1, 2, 1, 0), (2, 2, 1, 0)]
    assert sorted(r.conv_id for r in trie.ends.collect()) == [1, 2]
