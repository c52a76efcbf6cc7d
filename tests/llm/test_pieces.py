"""Ids, spans and round trips against the library."""

from __future__ import annotations

import pytest

from tablegauge.llm import pieces
from tablegauge.llm.shared import piece_model

TEXTS = ["", " ", "\n", "Hello  world ", "▁x ▁", "é😀\n\t日本\x00z", "a" * 3000, "word " * 20_000, "ﬁ ①"]


@pytest.fixture
def model():
    return pieces.PieceModel(piece_model())


def test_spans(model):
    for text, (ids, begins, ends) in zip(TEXTS, model.encode([t.encode() for t in TEXTS])):
        raw, told = text.encode(), model.processor.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in told]
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        if text.isascii():
            assert [(p.begin, p.end) for p in told] == list(zip(begins, ends))


@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("escape", [False, True])
def test_character_map(model, prefix, squeeze, escape):
    from sentencepiece import SentencePieceNormalizer
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    library, proto = SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze,
                                             escape_whitespaces=escape), ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    model.use(proto.normalizer_spec)
    for text in ["ＡＢＣ ﬁ ①② ｶﾞ  x", "  a　b\tc ", "", "   ", "é Å ½ km² …", "日本 한국 ﷺ"]:
        made, sources = model.normalise(text.encode())
        assert made.decode() == library.normalize(text)
        assert len(sources) == len(made) + 1 and (sources[1:] >= sources[:-1]).all() and sources[-1] <= len(text.encode())


def test_documents(spark, model):
    rows = [*enumerate(TEXTS), (None, "x"), (50, None), (3, "Hello  world ")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, IDS int").repartition(3)
    encoded = pieces.encode(docs, piece_model())
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, model.processor.encode(t or "")) for i, t in rows), key=repr)
    decoded = pieces.decode(encoded, piece_model())
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=repr) == sorted(
        ((i, model.processor.decode(model.processor.encode(t or ""))) for i, t in rows), key=repr)
    assert pieces.encode(docs.limit(0), piece_model()).count() == 0
