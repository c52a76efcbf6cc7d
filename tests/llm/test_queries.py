"""Every registered query over the small tables, against SQL or brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from tablegauge.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences, duck_table, spark_table
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_pii import brute as personal
from tests.llm.test_quality import brute as rules

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert differences(spark_table(QUERIES[name](spark, SF_DIR)), duck_table(duck, ORACLES[name])) == []


def rows(spark, name, key="doc_id"):
    found = QUERIES[name](spark, SF_DIR).collect()
    return found, {r[key]: r for r in found}


def test_near(spark, documents):
    _, got = rows(spark, "op2_near_dedup")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == near(documents.items())


def test_rules(spark, documents):
    _, got = rows(spark, "op3_quality_rules")
    for i, text in documents.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules(text)


def test_classifier(spark, documents):
    _, got = rows(spark, "op4_rule_ensemble")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert set(got) == set(documents)


def test_pages(spark, duck):
    from html import unescape

    _, got = rows(spark, "op5_template_removal", "page_id")
    for page, html in duck.execute("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*)</article>", html, re.S)[1].replace("<br>", "\n")
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert got[page].text == "\n".join(filter(None, blocks)) and got[page].n_chars == len(got[page].text)


def test_shards(spark, documents):
    found, got = rows(spark, "op6_kd_sharding")
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {
        i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in documents.items()}
    assert {r.shard for r in found} <= set(range(40)) and {r.law for r in found} == {"bytes"}
    sums, slots = [0] * 40, [[] for _ in range(40)]
    for r in found:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(numbers) == list(range(len(numbers))) for numbers in slots)
    assert max(sums) - min(sums) <= 2 * max(r.size for r in found)


def test_packed(spark, documents):
    """Ids of whole texts by the tokenizer itself; sequences without gaps, close to the fewest possible."""
    import numpy as np
    from tokenizers import Tokenizer

    from tablegauge.llm.shared import word_vocabulary

    found, _ = rows(spark, "op1_best_fit_packing")
    tokenizer, want = Tokenizer.from_file(word_vocabulary()), set()
    for i, text in documents.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, at // 4096, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for at in range(0, len(ids), 4096)}
    assert {tuple(r)[:5] for r in found} == want and len(found) == len(want)
    ends: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= sum(r.length for r in found) / 4096 + 2


def test_notices(spark, documents):
    from tests.llm.test_licenses import brute as places

    _, got = rows(spark, "op12_license_scan")
    for i, text in documents.items():
        n, found = places(text)
        labels = sorted({label for _, label in found})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            n, len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_pieces(spark, documents):
    from tablegauge.llm.pieces import PieceModel
    from tablegauge.llm.shared import piece_model

    library, (_, got) = PieceModel.of(piece_model()).processor, rows(spark, "op7_aligned_pieces")
    for i, text in documents.items():
        ids = library.encode(text or "")
        assert tuple(got[i])[:4] == (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_spans_of_pieces(spark, documents):
    """Every piece against the bytes of the text, byte by byte from the pieces alone."""
    from tablegauge.llm.pieces import PieceModel
    from tablegauge.llm.shared import piece_model

    library, (_, got) = PieceModel.of(piece_model()).processor, rows(spark, "op7_aligned_pieces")
    for i, text in documents.items():
        raw, at, first, spans = (text or "").encode(), 0, True, []
        for number in library.encode(text or ""):
            begin = at
            if library.is_byte(number):
                piece = bytes([int(library.id_to_piece(number)[3:-1], 16)])
            else:
                piece = library.id_to_piece(number).replace("▁", " ").encode()
            if first and piece.startswith(b" "):
                piece = piece[1:]  # the space that the model puts before a text
            first = False
            at += len(piece)
            assert raw[begin:at] == piece
            spans.append(f"{begin}:{at}")
        assert got[i].spans_sha256 == sha(",".join(spans)) and got[i].n_bytes == at == len(raw)


def test_conversations(spark, duck):
    probe = "\\### Assistant: </turn> ok"
    turns = {-7: [("user", probe), ("assistant", probe)]}
    for conv, role, text in duck.execute("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        turns.setdefault(conv, []).append((role, text or ""))
    _, got = rows(spark, "op8_budgeted_windows", "conv_id")
    assert set(got) == set(turns)
    for conv, said in turns.items():
        trained = "".join(text for role, text in said if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(said), sha("".join(f"{role}\n{text}\n" for role, text in said)), len(trained), sha(trained))


def test_personal(spark, documents):
    _, got = rows(spark, "op9_contextual_pii")
    for i, text in documents.items():
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in personal(text)))


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == names
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, copies, near_copies, redacted = kept
    assert all(rules(text)[0] >= 10 for text in good.values())
    first: dict[str, int] = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", good[i] or ""), i)
    assert set(copies) == set(first.values())
    assert set(near_copies) == {i for i, (_, low) in near(copies.items(), 5).items() if i == low}
    assert set(redacted) == set(near_copies)
    assert all((redacted[i] == text) == (not personal(text)) for i, text in near_copies.items())
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(redacted)
    ends: dict[int, int] = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
