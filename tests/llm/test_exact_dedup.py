"""Golomb coding, copies, clashes of digests and odd tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tablegauge.llm import exact_dedup


@settings(max_examples=60, deadline=None)
@given(some.sets(some.integers(0, 2**40 - 1), min_size=1, max_size=300))
def test_golomb_round_trip(values):
    sent = np.array(sorted(values), np.uint64)
    k, unary, rest = exact_dedup.golomb_encode(sent)
    assert exact_dedup.golomb_decode(len(sent), k, unary, rest).tolist() == sent.tolist()


def test_golomb_is_small():
    sent = np.unique(np.random.default_rng(1).integers(0, 2**28, 2**18, dtype=np.uint64))
    _, unary, rest = exact_dedup.golomb_encode(sent)
    assert 8 * (len(unary) + len(rest)) / len(sent) < 13


def brute(rows):
    """(doc_id, text) to (doc_id, keep_id, group_size, kept), kept once for repeated rows."""
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(doc)
    smallest = {norm: min(ids, key=lambda i: (i is not None, i)) for norm, ids in groups.items()}
    found, given_out = [], set()
    for doc, text in rows:
        norm = re.sub(r"[\x20\x09-\x0d]+", " ", text or "")
        kept = doc == smallest[norm] and norm not in given_out
        if kept:
            given_out.add(norm)
        found.append((doc, smallest[norm], len(groups[norm]), kept))
    return sorted(found, key=repr)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "x"), (8, "y z"), (10, "y z"), (6, "Straße"),
        (11, "word " * 50_000), (12, "word " * 50_000), (7, "x"), (7, "other"), (None, "null id"), (13, "null id"), (9, "a b")]


def answer(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=repr)


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text, 256), 1, 1), lambda text: F.lit("same")])
def test_copies(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"KEPT": F.lit(1), "keep_id": F.lit("x")}).repartition(3)
    assert answer(exact_dedup.find_copies(docs, digest)) == brute(ROWS)


def test_empty(spark):
    assert exact_dedup.find_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dropped_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in ROWS], "doc_id long, text string, kept string")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r[0] for r in brute(ROWS) if r[3]), key=repr)


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), "id")).alias("text")).repartition(8)
    found = exact_dedup.find_copies(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    assert {r.group_size: (r.n, r.kept) for r in found.collect()} == {1000: (1000, 1), 1: (2000, 2000)}
