"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the words that lead it by one to four places, padded with NULL
where its piece ends. A ROLLUP over the five columns then sums the windows of each shorter prefix, so phrases of one to
five words come from one table of windows and texts are not exploded once for each length.

Words travel as hashes of word and language, which are checked to be distinct and made wider until they are. A window also ends before a word, or a
pair of neighbours, that occurs too rarely to be in any phrase of the answer. Both are looked up in bit filters of a fixed
size, which may let rare ones through but never stop a frequent one: they spare shuffled rows and change no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, staged

LEADS = ("w1", "w2", "w3", "w4", "w5")
# Everything that ends a piece becomes a full stop, tabs become spaces.
_PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
_END = b"."
_CHUNK = 200_000  # words taken at once
_SLICE = 1 << 20  # bytes of a long text taken at once
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Settings:
    """Least occurrences of a phrase, phrases told for each language, and the size of a filter as a power of two of bits."""

    least: int = 100
    first: int = 2000
    filter_bits: int = 27


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order with a full stop after each piece; long texts come in parts that end with a piece."""
    text = text.lower().translate(_PLAIN)  # lower() of bytes knows ASCII only
    at = 0
    while at < len(text):
        end = text.find(_END, at + _SLICE)
        end = len(text) if end < 0 else end + 1
        yield [*text[at:end].replace(_END, b" . ").split(), _END]
        at = end


def chunks(batches: Iterator[pa.RecordBatch], size: int = _CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of batches of (lang, text), a bounded number at a time."""
    waiting: dict[str, list[bytes]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for words in pieces_of(text.as_py()):
                waiting.setdefault(lang, []).extend(words)
                held += len(words)
                if held >= size:
                    yield from waiting.items()
                    waiting, held = {}, 0
    yield from waiting.items()


def word_keys(lang: str, words: list[bytes], attempt: int) -> np.ndarray:
    """Hash of each word of a language; another attempt gives other hashes, with 48, 56 and then 64 bits. Fewer bits make
    less to shuffle."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode(), attempt)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words)) >> np.uint64(max(0, 16 - 8 * attempt))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * _ODD[0]) ^ (first >> np.uint64(31)) ^ (second * _ODD[1])
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD[2]


def short(keys: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return keys >> np.uint64(32)


class BitFilter:
    """A set of 64-bit keys in a fixed number of bits. What was put in is always found."""

    probes = 3

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.power = bits, int(len(bits) * 8).bit_length() - 1

    @classmethod
    def places(cls, keys: np.ndarray, power: int) -> np.ndarray:
        return np.stack([(keys * odd) >> np.uint64(64 - power) for odd in _ODD[:cls.probes]], axis=1)

    @classmethod
    def gathered(cls, keys: DataFrame, power: int) -> BitFilter:
        """Filter of the column ``key``: bits are set by Spark's bitmap aggregate, blocks of 4 KB reach the driver."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = cls.places(batch.column(0).to_numpy().view(np.uint64), power)
                yield pa.RecordBatch.from_arrays([pa.array(places.reshape(-1).view(np.int64) + 1)], names=["place"])

        set_ = keys.select("key").mapInArrow(run, "place long").groupBy(F.bitmap_bucket_number("place").alias("block")) \
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        bits = np.zeros(2**power // 8, np.uint8)
        for row in set_.toLocalIterator():  # at most 2**power / 32768 rows, whatever the table
            at = (row.block - 1) * len(row.bits)
            bits[at:at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
        return cls(bits)

    def found(self, keys: np.ndarray) -> np.ndarray:
        places = self.places(keys, self.power)
        return ((self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n for every word of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in chunks(batches):
            counted = Counter(words)
            del counted[_END]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()).cast(pa.string()),
                pa.array(list(counted.values()), pa.int64())], names=["lang", "word", "n"])

    made = _texts(docs).mapInArrow(run, "lang string, word string, n long")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_keys(words: DataFrame, attempt: int) -> DataFrame:
    """Counted words with their hash as ``key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [word_keys(lang, [word.encode()], attempt)[0] for lang, word in
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64))],
                                             names=["lang", "word", "n", "key"])

    return words.mapInArrow(run, "lang string, word string, n long, key long")


def count_pairs(docs: DataFrame, attempt: int, words: BitFilter) -> DataFrame:
    """key, n of neighbouring words that may both be frequent.

    The counts only serve a filter, so a key has 32 bits: pairs that share one count as more frequent than they are. Keys and
    counts are shuffled as arrays, one for each of a number of buckets that grows with the number of partitions.
    """
    spark = docs.sparkSession
    spread, buckets = spark.sparkContext.broadcast(words), max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in chunks(batches, 5 * _CHUNK):
            keys = word_keys(lang, some, attempt)
            known = spread.value.found(keys) & (keys != word_keys(lang, [_END], attempt))
            both = known[:-1] & known[1:]
            pairs, n = np.unique(short(pair_keys(keys[:-1][both], keys[1:][both])), return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(2**32) // np.uint64(buckets))
            held = np.flatnonzero(np.diff(bounds))
            offsets = pa.array(np.append(bounds[held], len(pairs)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(held.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(pairs.astype(np.uint32).view(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], names=["bucket", "keys", "counts"])

    packed = _texts(docs).mapInArrow(run, "bucket int, keys array<int>, counts array<int>").repartition("bucket")
    each = packed.select("bucket", F.inline(F.arrays_zip("keys", "counts")))
    counted = each.groupBy("bucket", F.col("keys").alias("half")).agg(F.sum(F.col("counts").cast("long")).alias("n"))
    return counted.select((F.col("half").cast("long").bitwiseAND(F.lit(2**32 - 1))).alias("key"), "n")


def windows(keys: np.ndarray, known: np.ndarray, words: BitFilter, pairs: BitFilter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and their counts, one row each, 0 after the end of a window.

    ``known`` is false for ends of pieces. Column k holds the word that leads by k places if all before it do.
    """
    starts = known & words.found(keys)
    joined = starts[:-1] & starts[1:]
    joined[joined] = pairs.found(short(pair_keys(keys[:-1][joined], keys[1:][joined])))
    joined = np.append(joined, np.zeros(len(LEADS), bool))
    lead = np.append(keys, np.zeros(len(LEADS), np.uint64))
    rows, on = np.zeros((len(keys), len(LEADS)), np.uint64), starts.copy()
    for k in range(len(LEADS)):
        rows[on, k] = lead[k:k + len(keys)][on]
        on &= joined[k:k + len(keys)]
    rows = rows[starts]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    mixed = rows[:, 0]
    for k in range(1, len(LEADS)):
        mixed = pair_keys(mixed, rows[:, k])
    _, first, place, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    if (rows[first][place] != rows).any():  # two windows with one hash
        return np.unique(rows, axis=0, return_counts=True)
    return rows[first], n


def count_windows(docs: DataFrame, attempt: int, words: BitFilter, pairs: BitFilter) -> DataFrame:
    """w1 to w5, n: the padded longest windows."""
    spread = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in chunks(batches):
            keys = word_keys(lang, some, attempt)
            rows, n = windows(keys, keys != word_keys(lang, [_END], attempt), *spread.value)
            columns = [pa.array(column, mask=column == 0) for column in rows.T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*LEADS, "n"])

    kind = ", ".join(f"{w} long" for w in LEADS) + ", n long"
    return _texts(docs).mapInArrow(run, kind).groupBy(*LEADS).agg(F.sum("n").alias("n"))


def prefixes(top: DataFrame, least: int) -> DataFrame:
    """phrase (1 to 5 keys), a: every prefix of the windows that occurs often enough.

    Full windows are counted already; a ROLLUP over the columns before the last lead sums what is shorter.
    """
    columns = LEADS[:-1]
    summed = top.rollup(*columns).agg(F.sum("n").alias("a"), F.grouping_id().alias("_level"))
    phrase = F.array_compact(F.array(*columns))
    length = F.lit(len(columns)) - F.bit_count("_level")
    # A padded window has no prefix of its full length; the level without a word is the sum of all windows.
    shorter = summed.where((F.col("a") >= least) & (length > 0) & (F.size(phrase) == length)).select(phrase.alias("phrase"), "a")
    full = top.where(F.col(LEADS[-1]).isNotNull() & (F.col("n") >= least))
    return shorter.unionByName(full.select(F.array(*LEADS).alias("phrase"), F.col("n").alias("a")))


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) in whole decimals of 38 digits, which hold products of any two counts."""
    def whole(x: str) -> str:
        return f"cast({x} as decimal(19, 0))"

    return F.expr(f"({whole(f'1000 * {a}')} * {whole(n)}) div ({whole(left)} * {whole(right)})")


def _distinct_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """Counted words of all languages with hashes that differ, and the attempt that gave them."""
    counted = staged(count_words(docs), "words")
    for attempt in count():
        words = staged(with_keys(counted, attempt), "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return words, attempt
    raise AssertionError


def mine(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first phrases of each language by score, most frequent and then by bytes: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    phrase has 2 to 5 words of one piece; it is left out if a longer one around it occurs as often. NULL texts have no
    words, NULL languages are ``und``; languages without a frequent phrase, and tables without rows, give no rows. Repeated
    rows count as often as they occur. Very long texts are taken in parts. Other columns are ignored, whatever their names.
    """
    words, attempt = _distinct_words(docs)
    frequent = F.col("n") >= settings.least
    gather = partial(BitFilter.gathered, power=settings.filter_bits)
    known = gather(words.where(frequent))
    pairs = gather(count_pairs(docs, attempt, known).where(frequent))
    top = staged(count_windows(docs, attempt, known, pairs), "windows")
    languages = words.where(frequent).select(F.col("key").alias("_first"), "lang")
    phrases = prefixes(top, settings.least).join(languages, F.get("phrase", F.lit(0)) == F.col("_first")).drop("_first")
    phrases = staged(phrases, "phrases")

    def part(at: int | Column, size: Column) -> Column:
        return F.slice("phrase", at, size)

    size = F.size("phrase")
    # A longer phrase around another occurs as often at most; if it does, so does every one between the two.
    inner = phrases.where(size > 2).select("lang", F.explode(F.array(part(1, size - 1), part(2, size - 1))).alias("phrase"), "a")
    own = phrases.where(size > 1).join(inner.hint("merge"), ["lang", "phrase", "a"], "left_anti")
    cut = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    def side(name: str, value: str) -> DataFrame:
        return phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(value)).hint("merge")

    told = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Lowest score, then smallest k, as one number: a fixed-size state that tasks combine.
    best = told.groupBy("lang", "phrase", "a", "n").agg(F.min(_score("a", "n", "l", "r") * 8 + F.col("k")).alias("lowest"))
    best = staged(best.select("lang", "phrase", "a", "n", F.expr("lowest div 8").alias("score"), (F.col("lowest") % 8).cast("int").alias("k")), "scored")
    leading = staged(_leaders(best, settings.first), "leading")
    named = leading.select("lang", "phrase", F.posexplode("phrase").alias("place", "key")) \
        .join(words.where(frequent).select("lang", "key", "word"), ["lang", "key"]).groupBy("lang", "phrase") \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w.word), " ").alias("name"))
    ended = leading.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right")) \
        .join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(named, ["lang", "phrase"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "name")
    ranked = ended.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= settings.first)
    return ranked.select("lang", "rank", F.col("name").alias("phrase"), "a", "l", "r", "n", "score")


def _leaders(best: DataFrame, first: int) -> DataFrame:
    """Rows that may be among the first of their language, all ties with the last included.

    Rows of a language are dealt to as many tasks as there are shuffle partitions; the last choice sees what those leave.
    """
    order = [F.desc("score"), F.desc("a")]
    parts = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for group in (["lang", "_part"], ["lang"]):
        dealt = dealt.withColumn("_rank", F.rank().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= first)
    return dealt.drop("_rank", "_part")
