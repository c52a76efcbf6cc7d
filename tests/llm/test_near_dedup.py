"""Sketches, links against all pairs, chains of components and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablegauge.llm import near_dedup as nd

SETTINGS = nd.Settings(words=2)


def brute(rows, words=2, percent=80):
    """doc_id to (set size, component) by comparing all pairs; for unique doc_ids."""
    sets = {}
    for doc, text in rows:
        tokens = (text or "").encode().lower().split()
        span = min(words, len(tokens))
        sets[doc] = {tuple(tokens[i:i + span]) for i in range(len(tokens) - span + 1)} if tokens else set()
    label = {doc: doc for doc in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return {doc: (len(sets[doc]), label[doc]) for doc in sets}


def corpus():
    rng, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += ["one", "ONE", "one two", "", "  \n", None, "a b", "A\tb", "É b", "é b", "long " * 20_000, "long text " * 9_000]
    # A chain: neighbours are near, ends are not.
    chain = [f"c{i}" for i in range(60)]
    for step in range(8):
        rows.append(" ".join(chain[step * 4:step * 4 + 45]))
    return list(enumerate(rows))


def found(spark, rows, settings=SETTINGS):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.link(docs, settings).collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_links(spark, words):
    rows = corpus()
    want = brute(rows, words)
    assert found(spark, rows, nd.Settings(words=words)) == {doc: (n, low, doc == low) for doc, (n, low) in want.items()}


def test_what_hubs_miss_is_found(spark, monkeypatch):
    """With no pair taken from hubs, the filter alone must bring every link."""
    seen = []
    real = nd.overlapping
    monkeypatch.setattr(nd, "overlapping", lambda *a: seen.append(1) or real(*a))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), 4):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    assert {k: v[:2] for k, v in found(spark, rows).items()} == brute(rows)
    assert seen


def test_large_groups_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Near copies of one text, some of them only near to some others, and a passage that many other texts share."""
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(100)]
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 4, 5])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"{passage} " + " ".join(f"y{i}_{k}" for k in range(rng.randint(20, 60)))) for i in range(200)]
    compared, real = [], nd.confirmed

    def counted(pairs, *more):
        compared.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(nd, "confirmed", counted)
    assert {k: v[:2] for k, v in found(spark, rows).items()} == brute(rows)
    assert max(compared) <= 6 * len(rows) and sum(compared) < len(rows) ** 2 / 10


def test_rows_of_one_id_are_told_by_their_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, a, "x"), (5, a + " ", "y"), (5, b, "z"), (7, b, "q"), (8, "alone here", "r"), (None, a, "s"), (None, "no id at all", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3)
    kept = sorted((tuple(r) for r in nd.keep_one(docs, SETTINGS).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)


def test_odd_tables(spark):
    assert found(spark, []) == {}
    docs = spark.createDataFrame([(1, "a b c", 1, "x"), (1, "a b c", 1, "x"), (None, "a b c", 2, "y"), (None, None, 3, "z"), (2, "q", 1, "x")],
                                 "doc_id long, text string, KEPT int, label string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.link(docs, SETTINGS).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 1, 2, True)], key=repr)
    assert nd.keep_one(docs, SETTINGS).columns == docs.columns


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    m = SETTINGS.multipliers()
    sketch = lambda items: nd.sketch(np.unique(items), SETTINGS, m)
    assert (nd.merged(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all()
    near, far = np.concatenate([a[:2700], b[:300]]), np.concatenate([a[:1000], b[:2000]])
    sizes = np.array([3000])
    assert nd.may_reach(sketch(a)[None], sketch(near)[None], sizes, sizes, SETTINGS).all()
    assert not nd.may_reach(sketch(a)[None], sketch(far)[None], sizes, sizes, SETTINGS).any()


def alike_texts(n=60):
    """Texts of 150 words of which any two share about 72 %, and after every tenth one that differs from it in five words."""
    rng, rows = random.Random(8), []
    base = [f"b{i}" for i in range(150)]
    for i in range(n):
        words = [f"own{i}x{j}" if j < 13 else word for j, word in enumerate(rng.sample(base, len(base)))]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([f"new{i}x{j}" for j in range(5)] + words[5:])))
    return rows


def prepared(spark, rows, settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = nd.sketched(docs, settings)
    nodes = made.selectExpr("doc_id as node", "doc_id", "digest", "n_shingles as n", "registers", "doc_id as label")
    return nodes, nd.full_sets(docs, nodes, settings)


def test_last_step_makes_hardly_more_pairs_than_links(spark):
    """In a group whose members are all somewhat alike, pairs below the threshold do not become rows, and no link is lost."""
    rows, settings = alike_texts(), nd.Settings(words=1)
    nodes, sets = prepared(spark, rows, settings)
    words = {i: set(text.split()) for i, text in rows}
    links = {(a, b) for a in words for b in words if a < b and 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])}
    found = [tuple(sorted(pair)) for pair in nd.overlapping(nodes.select("node", "n", "label"), sets, settings).collect()]
    assert 6 <= len(links) <= 20 and links <= set(found)
    assert len(set(found)) <= len(links) + 20


def test_parities():
    rng = np.random.default_rng(4)
    for size, more in ((0, 3), (5, 0), (150, 40), (5000, 900)):
        a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (size, more))
        bits = [np.unpackbits(nd.parities(x).view(np.uint8)) for x in (a, np.union1d(a, b))]
        assert len(bits[0]) == nd.BITS and (bits[0] != bits[1]).sum() <= len(b)
        assert more > 100 or (bits[0] != bits[1]).sum() >= 0.8 * len(b)


def test_sets_of_pairs_are_not_gathered_in_batches(spark):
    """Confirming pairs sends registers to Python workers, never sets, whose batches would have no bound; the links are the same."""
    rows, settings = alike_texts(20), nd.Settings(words=1)
    nodes, sets = prepared(spark, rows, settings)
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "a long, b long")
    links = nd.confirmed(pairs, nodes.select("node", "n", "registers"), sets, settings)
    plan = links._sc._jvm.PythonSQLUtils.explainString(links._jdf.queryExecution(), "simple")
    assert not [line for line in plan.splitlines() if "MapInArrow" in line and "sa#" in line]
    words = {i: set(text.split()) for i, text in rows}
    assert {tuple(pair) for pair in links.collect()} == {
        (a, b) for a in words for b in words if a < b and 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])}
