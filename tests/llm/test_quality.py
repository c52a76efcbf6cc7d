"""Rule statistics and votes, and the rule ensemble on held-out rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablegauge.llm import quality_classifier, quality_rules

ODD = ["", " \n ", "one", "a b c d e " * 3, "x\nx\n\nx \nx", "#*$ %&|<> é#", "a b c d e f a b c d e", "É\x1cß\x85 word", "w " * 20_000,
       "p q r s t u v w x y z\n" * 2, None]


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, marked, seen, doubled = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            marked.update(range(i, i + 5))
    for line in (text or "").encode().split(b"\n"):
        if line.split():
            doubled += line in seen
            seen.add(line)
    joined = b"".join(words).decode()
    return len(words), len(joined), sum(joined.count(c) for c in "#*$%&|<>"), doubled, len(marked)


def prose(rng, words=60):
    return " ".join("".join(rng.choice("abdeghilmnorstuw") for _ in range(rng.randint(3, 8))) for _ in range(words)) + "."


def junk(rng):
    base = prose(rng)
    return rng.choice([" | ".join(base.split()), base.upper().replace(" ", "!! "), " ".join(w + "###" for w in base.split()), "spam spam " * 30])


def corpus(n=600):
    rng = random.Random(1)
    return [(i, junk(rng) if i % 6 == 0 else prose(rng), int(i % 6 != 0)) for i in range(n)]


def test_statistics():
    for text in [*ODD, *(text for _, text, _ in corpus(100))]:
        got = dict(zip([x.split()[0] for x in quality_rules.STATISTICS.split(", ")], quality_rules.statistics((text or "").encode())))
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == brute(text)


def test_votes_part_good_from_bad(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in corpus()], "doc_id long, text string, KEPT string, n_words int").repartition(4)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert all(kept[i] == bool(label) for i, _, label in corpus())
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_odd_tables(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "same"), (None, "same")], "doc_id long, text string")
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_clean_texts_alone_are_kept(spark):
    docs = spark.createDataFrame([(i, t) for i, t, label in corpus() if label], "doc_id long, text string")
    assert quality_rules.judge(docs).where("not kept").count() == 0


def test_likelihood_grows():
    rng = np.random.default_rng(4)
    patterns = rng.integers(-1, 2, (60, len(quality_rules.RULES)))
    counts = rng.integers(1, 50, 60).astype(float)

    def likelihood(model):
        bad, good = patterns == -1, patterns == 1
        on_good, on_bad = np.array(model.bad_on_good), np.array(model.bad_on_bad)
        sides = [p * np.prod(np.where(bad, r, np.where(good, 1 - r, 1)), axis=1)
                 for p, r in ((model.prior, on_good), (1 - model.prior, on_bad))]
        return float((counts * np.log(sides[0] + sides[1])).sum())

    assert likelihood(quality_rules.fit(patterns, counts, iterations=40)) >= likelihood(quality_rules.fit(patterns, counts, iterations=1))


def test_rules_are_read_from_trees():
    text = ("DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 0.25)\n    Predict: 0.0\n   Else (feature 1 > 0.25)\n    Predict: 1.0\n"
            "  Else (feature 0 > 1.5)\n   If (feature 0 <= 3.0)\n    Predict: 0.0\n   Else (feature 0 > 3.0)\n    Predict: 1.0\n")
    low, high = ("a", False, 1.5), ("a", True, 1.5)
    want = [(low,), (low, ("b", False, 0.25)), (low, ("b", True, 0.25)), (high,), (("a", False, 3.0), high), (("a", True, 3.0),)]
    assert {r.conditions for r in quality_classifier.paths(text, ["a", "b"])} == set(want)


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, label) for i, _, label in rows] + [(None, 1), (99999, 0), (1, None)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality_classifier.score(docs, labels).collect()}
    held = [(scored[i].predicted, label) for i, _, label in rows if scored[i].held_out]
    assert len(held) > 200 and sum(p == label for p, label in held) / len(held) > 0.97
    # Labels of held-out rows are never read: turning them over changes nothing.
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality_classifier.score(docs, turned).collect()} == {i: r.score for i, r in scored.items()}


def test_without_labels(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), none).count() == 0
