"""SentencePiece ids with the byte span of every piece in the original text, and back.

The ids are the library's. The spans come from the model's own normalisation, done once more with its alignment kept:
at each place the compiled character map gives the longest prefix it knows and what replaces it, so every normalised byte
knows the byte of the source it comes from; pieces lie end to end in the normalised text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablegauge.llm.shared import pick

SPACE = "▁".encode()
ROWS_AT_ONCE = 500


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values point into a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text`` from ``at`` and its replacement."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for end in range(at, len(text)):
            node ^= text[end]
            unit = units[node]
            if unit & 0x800000FF != text[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1]:self.pool.index(0, found[1])]


class PieceModel:
    """A model file for encoding, decoding and alignment; models without byte fallback are refused."""

    _made: dict[str, PieceModel] = {}

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.processor = SentencePieceProcessor(model_file=path)
        proto = ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must fall back to bytes and mark white space before words")
        self.use(proto.normalizer_spec)
        self.widths = np.array([1 if piece.type == piece.BYTE else len(piece.piece.encode()) for piece in proto.pieces], np.int64)

    def use(self, spec) -> None:
        self.characters = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @classmethod
    def of(cls, path: str) -> PieceModel:
        """One model a worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def sources(self, text: bytes) -> np.ndarray:
        """For each byte of the normalised text, and its end, the byte of ``text`` it comes from."""
        if not text:
            return np.zeros(1, np.int64)
        if self.characters.units or self.squeeze or not self.escape:
            return self.normalise(text)[1]
        width = np.where(np.frombuffer(text, np.uint8) == 32, len(SPACE), 1)
        begin = np.zeros(len(SPACE) * self.prefix, np.int64)
        return np.concatenate([begin, np.repeat(np.arange(len(text)), width), [len(text)]])

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and the source of each of its bytes, by longest prefixes."""
        out, source, at = bytearray(), [], 0
        space = SPACE if self.escape else b" "
        steps: list[tuple[int, int, bytes]] = []
        while at < len(text):
            known = self.characters.longest(text, at)
            if known is None:
                first = text[at]
                width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                known = width, text[at:at + width]
            steps.append((at, at + known[0], known[1]))
            at += known[0]
        if self.squeeze:
            while steps and not steps[0][2].strip(b" "):
                steps.pop(0)
        if not steps:
            return b"", np.array([len(text)], np.int64)
        if self.prefix:
            out += space
            source += [steps[0][0]] * len(space)
        blank = self.squeeze
        for begin, _, piece in steps:
            if self.squeeze and blank:
                piece = piece.lstrip(b" ")
            for byte in piece:
                made = space if byte == 32 else bytes([byte])
                out += made
                source += [begin] * len(made)
            blank = piece.endswith(b" ") if piece else blank
        end = len(text)
        if self.squeeze:
            while out.endswith(space):
                end = source[-1]
                del out[-len(space):], source[-len(space):]
        return bytes(out), np.array([*source, end], np.int64)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, begins and ends of each text; a piece of nothing but the added prefix has an empty span."""
        found = []
        for text, ids in zip(texts, self.processor.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)):
            ids = np.array(ids, np.int32)
            ends, sources = np.cumsum(self.widths[ids]), self.sources(text)
            # Text that is no UTF-8 is longer once repaired: its spans stay within it.
            ends = np.minimum(ends, len(sources) - 1)
            found.append((ids, sources[np.concatenate([[0], ends[:-1]])] if len(ids) else ends, sources[ends]))
        return found


def digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_sha256.

    What ``encode`` and ``decode`` give, told by digests: of the ids (decimal, joined by commas), of the decoded text, of the
    spans (begin:end, joined by commas), and the last byte that a piece covers. The arrays do not leave the task. NULL counts
    as empty; repeated rows, no rows and other columns are treated as by ``encode``.
    """
    texts = pick(docs, "doc_id", "text")

    def sha(text: str) -> str:
        return sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = pieces.encode([text or b"" for text in part.column(1).cast(pa.binary()).to_pylist()])
                ids = [row[0].tolist() for row in made]
                spans = [",".join(f"{b}:{e}" for b, e in zip(begins.tolist(), ends.tolist())) for _, begins, ends in made]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(",".join(map(str, row))) for row in ids]),
                    pa.array(list(map(sha, pieces.processor.decode(ids))), pa.string()),
                    pa.array([int(ends[-1]) if len(ends) else 0 for _, _, ends in made], pa.int64()),
                    pa.array(list(map(sha, spans)))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, begins, ends (arrays; spans are bytes of the UTF-8 text, end exclusive).

    NULL counts as empty and has no pieces. No begin or end ids, no sampling. Repeated rows are encoded each; no rows
    give no rows; other columns are ignored, whatever their names.
    """
    texts = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = pieces.encode([text or b"" for text in part.column(1).cast(pa.binary()).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(ids) for ids, _, _ in made])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([row[i] for row in made]).astype(np.int32)))
                         for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "ids", "begins", "ends"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """The columns of ``encoded`` with ``ids`` replaced by the decoded text; NULL decodes to an empty text."""
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = PieceModel.of(model).processor
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = processor.decode([row or [] for row in part.column(place).to_pylist()])
                columns = [pa.array(texts, pa.string()) if i == place else column for i, column in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=[name if i == place else n for i, n in enumerate(part.schema.names)])

    kinds = ", ".join(f"`{name if i == place else f.name}` {'string' if i == place else f.dataType.simpleString()}"
                      for i, f in enumerate(encoded.schema))
    return encoded.mapInArrow(run, kinds)
