"""Phrases, their cuts, what a longer phrase hides, filters and odd tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from tablegauge.llm import collocations
from tablegauge.llm.collocations import BitFilter, Settings, mine

SMALL = Settings(least=3, first=50, filter_bits=16)
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, first):
    """(lang, text) to the answer, by counting every phrase of every length."""
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            found.update((lang, tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    kept = {(lang, phrase): a for (lang, phrase), a in found.items() if a >= least}
    ranked: dict[str, list] = {}
    for (lang, phrase), a in kept.items():
        if len(phrase) < 2 or any(b == a and len(other) > len(phrase) and lang == l2 and any(
                other[i:i + len(phrase)] == phrase for i in range(len(other))) for (l2, other), b in kept.items()):
            continue
        n = totals[lang]
        score, _, left, right = min((1000 * a * n // (kept[lang, phrase[:k]] * kept[lang, phrase[k:]]), k,
                                     kept[lang, phrase[:k]], kept[lang, phrase[k:]]) for k in range(1, len(phrase)))
        ranked.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right, n))
    return sorted((lang, rank, phrase.decode(), -a, left, right, n, -score) for lang, some_ in ranked.items()
                  for rank, (score, a, phrase, left, right, n) in enumerate(sorted(some_)[:first], 1))


def answer(spark, rows, given=SMALL):
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "a string, b string, c string, d long")
    return sorted(map(tuple, mine(docs.repartition(3).toDF("lang", "text", "LANG", "n"), given).collect()))


ROWS = [
    ("en", "New York City is big. New York city, new york CITY! new york"), ("en", "the the the the the the"),
    ("en", "a b c d e f g " * 4), ("en", "a b. c d\ne f\ta b? c\vd"), ("de", "New York"), ("de", None), (None, "x y " * 5),
    (None, ""), ("en", " . , \n"), ("fr", "été À été À été À ÉTÉ à"), ("", "p q. p q. p q"), ("en", "a b c d e f g " * 4),
    ("en", "x\x1cy z x\x1cy z\x85 x\x1cy z"), ("es", "uno"),
]


def test_against_counting_every_phrase(spark):
    want = brute(ROWS, 3, 50)
    assert len({row[0] for row in want}) == 4
    assert answer(spark, ROWS) == want


def test_ties_and_limit(spark):
    rows = [("en", f"b{i} c{i}. " * 4) for i in range(30)]
    assert answer(spark, rows, Settings(least=3, first=7, filter_bits=16)) == brute(rows, 3, 7)


def test_long_text(spark):
    rows = [("en", "one two three. four five " * 60_000), ("en", "six seven " * 3)]
    assert answer(spark, rows) == brute(rows, 3, 50)


def test_empty_table(spark):
    assert answer(spark, []) == [] and answer(spark, [("en", "too rare")]) == []


def test_no_word_hash_is_trusted(spark, monkeypatch):
    """Words that share a hash lead to other hashes, not to sums of two words."""
    docs = spark.createDataFrame([("en", "a b c " * 3)], "lang string, text string")
    once, attempts = collocations.with_keys, []

    def colliding(words, attempt):
        attempts.append(attempt)
        made = once(words, attempt)
        return made.withColumn("key", made.n) if attempt == 0 else made

    monkeypatch.setattr(collocations, "with_keys", colliding)
    assert [r.phrase for r in mine(docs, SMALL).collect()] == ["a b c"]
    assert attempts == [0, 1]


def test_products_beyond_64_bits(spark):
    a, n, left, right = 2**41 + 1, 2**44 - 3, 2**41 + 77, 2**42 + 5
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations._score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (left * right)


@pytest.mark.parametrize("power", [15, 16])
def test_filter_finds_all(spark, power):
    """Whatever was put in is found, in the same number of bytes whatever the number of keys."""
    keys = np.random.default_rng(3).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    table = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    made = BitFilter.gathered(table, power)
    assert collocations.word_keys("en", [b"a"], 0)[0] < 2**48 <= collocations.word_keys("en", [b"a"], 2)[0]
    assert made.found(keys).all() and len(made.bits) == 2**power // 8
    others = np.random.default_rng(4).integers(0, 2**63, 3000, dtype=np.uint64)
    assert made.found(others).mean() < 0.2
    assert not BitFilter.gathered(table.limit(0), power).found(keys).any()


@settings(max_examples=60, deadline=None)
@given(some.lists(some.sampled_from(["a", "b", "c", "."]), max_size=40))
def test_windows(words):
    """Windows of one list of words against slices of it."""
    everything = BitFilter(np.full(2**15 // 8, 255, np.uint8))
    said = [w.encode() for w in words]
    keys = collocations.word_keys("en", said, 0)
    end = collocations.word_keys("en", [b"."], 0)
    rows, n = collocations.windows(keys, keys != end, everything, everything)
    names = dict(zip(keys.tolist(), words))
    got = Counter({tuple(names[k] for k in row.tolist() if k): int(times) for row, times in zip(rows, n)})
    pieces = " ".join(words).split(".")
    assert got == Counter(tuple(p.split()[i:i + 5]) for p in pieces for i in range(len(p.split())))
