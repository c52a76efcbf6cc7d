"""Exact patterns against Python's matcher, discovery by context, and redaction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablegauge.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["a@b.c_d@e.f x", "..@a.b", "a@b.c.d..e f@g.h.", "4111 1111-1111 1111 1 2", "4111-1111-1111-1111", "+1 (23) 456-7890. +12 3",
       "256.1.1.1 1.2.3.4.5.6.7.8 001.0002.3.255", "\x01a@b\x01.c d@e.f\x01 1\x012 4111111111111111", "é😀a.b@c-d.e-f 😀+49 30 1234567)",
       "1" * 50, "a@b", "@a.b", "a..b@c.d", "x@-.-", "9 " * 300, None, "", "+1", "+12345678901234567", "a" * 30_000 + "@", "1 " * 30_000,
       "x@" + "a." * 30_000 + "b", "4111  1111 1111 1111", "1.2.3.4@5.6", "+1-2-3-4-5-6-7-8-9 +1-2", "5500005555555559,5500 0055 5555 5559"]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (
                    13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_base_spans(spark):
    frame = spark.createDataFrame([*enumerate(ODD), (None, "a@b.c"), (0, ODD[0])], "doc_id long, text string").withColumn("KIND", F.lit(1))
    got = pii.find(frame).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "a@b.c" if r.doc_id is None else ODD[r.doc_id]
        assert [tuple(s) for s in r.base] == brute(text), text and text[:60]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


SEEDED = [(i, f"Please call tel: +49 30 12345{i:03d} now") for i in range(14)] + [(100, "tel: 030/1234567, today"), (101, "of 030/7654321 pages"),
                                                                              (102, "tel: 12 rooms")]


def test_contexts_find_more(spark):
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(SEEDED, "doc_id long, text string")).collect()}
    assert found[100] == [("phone", 5, 16)] and found[101] == found[102] == []


def test_common_words_are_no_patterns(spark):
    rows = [(i, f"see the +49 30 12345{i:03d} now and the end of the day") for i in range(8)] + [(50, "the 030/1234567 x")]
    assert {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[50] == []


def test_redaction(spark):
    rows = [(*r, 5) for r in SEEDED] + [(200, "a@b.co 1.2.3.4@x.yz", 1), (201, None, None), (202, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("mine"))
    left = pii.redact(docs)
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in left.collect()}
    assert left.columns == docs.columns and left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert got[3] == ("Please call tel: [PHONE] now", 28, "mine") and got[100][0] == "tel: [PHONE], today"
    assert got[200][0] == "[EMAIL] [EMAIL]" and got[201] == (None, None, "mine") and got[202] == ("clean", 5, "mine")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0


def test_native(spark):
    plan = pii.find(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))
    shown = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert not [name for name in ("Python", "Pandas", "Arrow") if name in shown]


def spans(spark, texts):
    found = pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    return [{texts[r.doc_id][s.start:s.end] for s in r.spans} for r in found]


def test_unseen_identifiers_do_not_veto_their_cue(spark):
    seeds = [f"a{i} tel: +49 30 12345{i:03d}" for i in range(7)]
    unseen = [f"b{i} tel: 030/76543{i:02d}" for i in range(3)]
    assert spans(spark, seeds + unseen)[7:] == [{f"030/76543{i:02d}"} for i in range(3)]
    assert spans(spark, seeds[:3] + unseen[:1])[3] == {"030/7654300"}


def test_contradicted_cues_find_nothing(spark):
    texts = [f"x{i} near +49 30 12345{i:03d}" for i in range(6)] + ["near home"] * 3 + ["so near 030/7654321"]
    assert spans(spark, texts)[-1] == set()


def test_chains_of_patterns(spark):
    """Each cue stands beside instances of the one before only: more steps than any fixed number of rounds had."""
    texts = [f"a{i} cue0: +49 30 12345{i:03d} e{i}" for i in range(4)]
    for step in range(5):
        texts += [f"c{i} cue{step + at}: 030/7{step}543{i:02d} d{i}" for i in range(3) for at in (0, 1)]
    got = spans(spark, texts)
    assert all(len(found) == 1 for found in got) and got[-1] == {"030/7454302"}


def test_words_on_the_right_two_words_and_neighbour_tokens(spark):
    right = [f"a{i} +49 30 12345{i:03d}, mobile" for i in range(4)] + ["b 030/7654321, mobile"]
    assert spans(spark, right)[-1] == {"030/7654321"}
    two = [f"a{i} reach under +49 30 12345{i:03d}" for i in range(4)] + ["lay under trees"] * 4 + ["b reach under 030/7654321", "c lay under 030/7654322"]
    assert spans(spark, two)[-2:] == [{"030/7654321"}, set()]
    beside = [f"a{i} tel2 +49 30 12345{i:03d}" for i in range(4)] + ["b tel2 030/7654321"]
    assert spans(spark, beside)[-1] == {"030/7654321"}


def test_redaction_tells_texts_of_one_id_apart(spark):
    rows = [*SEEDED, (100, "clean words of another text"), (100, "tel: 030/1234567, today")]
    left = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 100")
    assert sorted(r.text for r in left.collect()) == ["clean words of another text"] + ["tel: [PHONE], today"] * 2
