"""License notices: base phrases against a scan of all places, templates with edits, odd tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import licenses

UPPER = {i: i + 32 for i in range(65, 91)}
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def brute(text):
    """Number of words, and every (place, label) of a phrase."""
    words = words_of(text)
    return len(words), sorted((i, label) for phrase, label in BASE.items() for i in range(len(words))
                              if words[i:i + len(phrase.split())] == phrase.split())


MIT = next(t.text for t in licenses.NOTICES if t.label == "MIT-text")
TEXTS = [
    "Released under the MIT License.", "released under the mit  LICENSE and the Mit-license", "MIT-Lizenz mit License", None, "", " .,- ",
    "GNU General Public License, version 3; GNU General Public License, version 2.", "gnu general public", "general public license gnu",
    "ccby cc.by CC BY-NC 4.0 cc by", "Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "été mit licenseé",
    "mit " * 5000 + "license " * 5000, "cc by " * 3000, "x" * 100_000, MIT, "Copyright (c) 2020 A B\n\n" + MIT.upper().replace(" ", "\n * "),
    MIT.replace("free of charge", "at a price"), " ".join(MIT.split()[:12]), "x " * 40 + MIT.replace("merge, publish", "merge, or publish") + " y" * 40,
    "software rights copy person granted permission charge obtaining",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string")
    docs = docs.select("*", F.lit("mit license"), F.lit(1)).toDF("doc_id", "text", "Text", "n_words")
    return {r.doc_id: r for r in licenses.scan(docs.repartition(3)).collect()}


def test_base_phrases(found):
    for i, text in enumerate([*TEXTS, *TEXTS]):
        assert (found[i].n_words, sorted((p.start, p.label) for p in found[i].found if p.exact)) == brute(text)


def labels(found, text):
    return {p.label for p in found[TEXTS.index(text)].found if not p.exact}


def test_notices(found):
    assert labels(found, TEXTS[6]) == {"GPL-2.0", "GPL-3.0"}
    assert labels(found, TEXTS[9]) == {"CC-BY-NC-4.0"}
    assert labels(found, TEXTS[11]) == {"Apache-2.0"} and labels(found, TEXTS[10]) == set()
    whole, upper, edited = TEXTS.index(MIT), 17, 20
    assert [labels(found, TEXTS[i]) for i in (whole, upper, edited)] == [{"MIT-text"}] * 3
    place, = [p for p in found[whole].found if not p.exact]
    assert (place.start, place.length >= len(words_of(MIT)), place.share) == (0, True, 1.0)
    assert all(0 <= p.share <= 1 for r in found.values() for p in r.found)


def test_mandatory_phrases_decide(found):
    assert labels(found, TEXTS[18]) == labels(found, TEXTS[19]) == labels(found, TEXTS[21]) == set()


def test_every_template_finds_itself(spark):
    docs = spark.createDataFrame([(i, f"before {t.text} after") for i, t in enumerate(licenses.NOTICES)], "doc_id long, text string")
    got = {r.doc_id: {p.label for p in r.found} for r in licenses.scan(docs).collect()}
    assert all(t.label in got[i] for i, t in enumerate(licenses.NOTICES))


def test_rarest_words_of_the_corpus_are_looked_up(spark):
    """Which words serve depends on the documents, what is found does not."""
    common = [(i, "gnu license apache") for i in range(50)]
    docs = spark.createDataFrame([*common, (99, "the GNU General Public License")], "doc_id long, text string")
    n, frequencies = licenses.document_frequencies(docs, licenses.vocabulary(licenses.PHRASES))
    index = licenses.Index.of(licenses.PHRASES, n, frequencies)
    assert n == 51 and frequencies["gnu"] == 51 and b"gnu" not in index.postings and b"general" in index.postings
    assert [(p.label, p.start) for p in licenses.scan(docs).where("doc_id = 99").first().found] == [("gpl", 1)]


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_phrase_outside_its_template():
    with pytest.raises(ValueError, match="not in its template"):
        licenses.Index.of([licenses.Template("x", "one two", ("two three",))], 0, {})
