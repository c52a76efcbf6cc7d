"""Word ids, plans against lower bounds, and packed documents."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tablegauge.llm import packing
from tablegauge.llm.shared import word_vocabulary
from tablegauge.llm.word_ids import WordIds

ODD = ["", "  ", "á é. Ä ö, <|endoftext|>. <|startoftext|>x don't I'll. 'S. ..., a.b,c..  b c. \x1c\x85d 日本. 1234,5. %. ΣΑΣ. ﬁ\x00x",
       "İstanbul. ǅ, ́x ß. ẞ,", "<|EndOfText|> Word. word, WORD", "Ⅻ. ²,", "word " * 3000, "a" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


def test_word_ids(tokenizer):
    for text, ids in zip(ODD, WordIds.of(word_vocabulary()).encode([t.encode() for t in ODD])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def positions(plan):
    """Every piece as (sequence, offset, length)."""
    return [(first + i // each, offset + i % each * size, size) for size, _, n, first, offset, each in plan.runs for i in range(n)]


def check(counts, capacity):
    plan = packing.Plan(dict(counts), capacity)
    placed = positions(plan)
    assert Counter(size for *_, size in placed) == Counter({s: n for s, n in counts.items() if n})
    ends: dict[int, int] = {}
    for sequence, offset, size in sorted(placed):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + size
    assert len(ends) == plan.sequences and all(end <= capacity for end in ends.values())
    for size in counts:
        ranks = sorted((first, n) for s, first, n, *_ in plan.runs if s == size)
        assert all(a + n == b for (a, n), (b, _) in zip(ranks, ranks[1:]))
    return plan


@settings(max_examples=150, deadline=None)
@given(some.dictionaries(some.integers(1, 30), some.integers(0, 6), max_size=12))
def test_plans_hold(counts):
    check(counts, 30)


def fewest(sizes, capacity):
    """Exact number of sequences for a few pieces."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for at in range(len(rooms)):
            if rooms[at] >= sizes[i] and rooms[at] not in rooms[:at]:
                place(i + 1, rooms[:at] + [rooms[at] - sizes[i]] + rooms[at + 1:])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(some.lists(some.integers(1, 20), min_size=1, max_size=9))
def test_fixed_sets_cost_nothing(sizes):
    """What dominance fixes is part of a best packing: fixed plus best for the rest is best for all."""
    plan = packing.Plan(Counter(sizes), 20)
    fixed = Counter(size for sequence, _, size in positions(plan) if sequence < plan.fixed_sequences)
    rest = sorted((Counter(sizes) - fixed).elements(), reverse=True)
    assert plan.fixed_sequences + (fewest(rest, 20) if rest else 0) == fewest(sorted(sizes, reverse=True), 20)


def test_close_to_the_bound():
    rng = np.random.default_rng(2)
    counts = Counter(np.clip(rng.lognormal(6, 1, 20_000), 1, 4096).astype(int).tolist())
    plan = check(counts, 4096)
    assert plan.sequences <= sum(s * n for s, n in counts.items()) / 4096 + 2


def test_documents(spark, tokenizer):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(100, None), (101, "word " * 4095), (102, "word " * 4096), (None, "x"), (3, "again")] \
        + [(200 + i, "hot length") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "IDS": F.lit(1)}).repartition(5)
    packed = packing.pack_documents(docs, word_vocabulary())
    got = packed.collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        if doc == 3:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(i // 4096, i, min(4096, len(ids) - i)) for i in range(0, len(ids), 4096)]
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes()
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(r.length for r in got)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {s: len(ids) // 4 for s, ids in whole.items()} == ends
    crc = {(r.doc_id, r.piece): r.c for r in packed.select("doc_id", "piece", F.crc32("ids").alias("c")).collect() if r.doc_id == 6}
    assert all(crc[r.doc_id, r.piece] == zlib.crc32(r.ids) for r in by_doc[6])


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), word_vocabulary()).count() == 0
