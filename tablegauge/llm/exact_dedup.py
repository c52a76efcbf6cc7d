"""Exact duplicates by Golomb-coded fingerprint exchange.

Every partition sends its sorted distinct fingerprints to their owners, Golomb-Rice coded (about 12 bits a document
instead of a 256-bit digest or the text); owners answer with a bitmap of the fingerprints that other partitions hold
too. Documents without such a bit and without a copy in their own partition are unique and move no further. Only the
texts of suspects are shuffled, and grouped by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shared import SPACES, pick, positional, staged, text_or_empty

SENT = ("doc_id {id}, uid long, digest string, text_sha256 string, part long, owner int, place int, local boolean, "
        "n int, k int, unary binary, remainders binary")
# Rows after which a task closes a logical partition and starts the next: bounds what a task holds.
PART_ROWS = 500_000
# Fingerprints an owner gets, at most about this many.
OWNER_FINGERPRINTS = 1_000_000
SPARE_BITS = 10  # one in 2**10 unique documents is suspected without need


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and fixed-width remainders of the gaps between sorted distinct values."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(gaps.mean()) if len(gaps) else 1.0
    k = max(0, int(math.log2(max(1.0, mean * math.log(2)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    bits = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (bits << shifts).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def sender(bits: int, owners: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their place among the distinct fingerprints sent to an owner, then one coded message for each owner."""
    def emit(batches: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        prints = table.column("fingerprint").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        distinct, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = ((distinct.astype(object) * owners) >> bits).astype(np.int64) if bits + owners.bit_length() > 63 else \
            ((distinct * np.uint64(owners)) >> np.uint64(bits)).astype(np.int64)
        starts = np.searchsorted(owner, np.arange(owners + 1))
        rows = len(prints)
        columns = {"doc_id": table.column("doc_id"), "uid": part * (PART_ROWS * 2) + np.arange(rows),
                   "digest": table.column("digest"), "text_sha256": table.column("text_sha256"),
                   "part": np.full(rows, part), "owner": owner[inverse].astype(np.int32),
                   "place": (inverse - starts[owner[inverse]]).astype(np.int32), "local": counts[inverse] > 1}
        empty = {name: pa.nulls(rows, schema.field(name).type) for name in schema.names if name not in columns}
        made = pa.table({name: (columns | empty)[name] for name in schema.names}).cast(schema)
        yield from made.to_batches(max_chunksize=50_000)
        messages: dict[str, list] = {name: [] for name in ("part", "owner", "n", "k", "unary", "remainders")}
        for who in np.flatnonzero(np.diff(starts)):
            values = distinct[starts[who]:starts[who + 1]]
            for name, value in zip(messages, (part, int(who), len(values), *golomb_encode(values))):
                messages[name].append(value)
        sent = len(messages["part"])
        made = pa.table({name: pa.array(messages[name], schema.field(name).type) if name in messages
                         else pa.nulls(sent, schema.field(name).type) for name in schema.names})
        yield from made.cast(schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        rows = closed = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PART_ROWS:
                yield from emit(held, task * 1_000_000 + closed)
                held, rows, closed = [], 0, closed + 1
        if rows:
            yield from emit(held, task * 1_000_000 + closed)

    return run


def owner_answers(table: pa.Table) -> pa.Table:
    """For each partition a bitmap over the fingerprints it sent: set where another partition sent the same one."""
    parts, ns, ks, unary, rest = (table.column(name).to_pylist() for name in ("part", "n", "k", "unary", "remainders"))
    sent = [golomb_decode(*message) for message in zip(ns, ks, unary, rest)]
    _, inverse, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared, ends = counts[inverse] > 1, np.cumsum([len(x) for x in sent])
    bitmaps = [np.packbits(x) for x in np.split(shared, ends[:-1])]
    told = [i for i, bitmap in enumerate(bitmaps) if bitmap.any()]
    return pa.table({"bitmap_part": pa.array([parts[i] for i in told], pa.int64()),
                     "bitmap_owner": pa.array([table.column("owner")[0].as_py()] * len(told), pa.int32()),
                     "bitmap": pa.array([bitmaps[i].tobytes() for i in told], pa.binary())})


def exchange(prints: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows, and the suspects among them, of (doc_id, digest, text_sha256, fingerprint)."""
    spark, kind = prints.sparkSession, prints.schema["doc_id"].dataType.simpleString()
    bits = min(63, max(8, math.ceil(math.log2(rows + 1)) + SPARE_BITS))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // OWNER_FINGERPRINTS))
    schema = SENT.format(id=kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    sent = staged(prints.mapInArrow(sender(bits, owners, arrow), schema), "prints")
    narrow = sent.where(F.col("unary").isNull()).select("doc_id", "uid", "digest", "text_sha256", "part", "owner",
                                                        "place", "local")
    messages = sent.where(F.col("unary").isNotNull()).select("part", "owner", "n", "k", "unary", "remainders")
    bitmaps = messages.groupBy("owner").applyInArrow(owner_answers, "bitmap_part long, bitmap_owner int, bitmap binary")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("1 << (7 - place % 8)")
    told = narrow.join(bitmaps, (F.col("part") == F.col("bitmap_part")) & (F.col("owner") == F.col("bitmap_owner")), "left")
    suspects = told.where(F.col("local") | F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)))
    return narrow, suspects.select("doc_id", "uid", "digest", "text_sha256")


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space. NULL text counts as
    empty; empty texts are equal to each other. The row with the smallest doc_id stays (NULL before all others); of
    repeated rows with that doc_id exactly one is kept. No rows give no rows; other columns of ``docs`` are ignored,
    whatever their names.

    ``digest`` replaces the digest that suspects are grouped by, to test that texts with equal digests stay apart.
    """
    make = digest or (lambda text: F.sha2(text, 256))
    texts = pick(docs, "doc_id", "text").select("doc_id", normalised().alias("norm"))
    texts = texts.select("doc_id", "norm", make(F.col("norm")).alias("digest"))
    prints = texts.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"),
                          F.xxhash64("digest").alias("fingerprint"))
    narrow, suspects = exchange(prints, docs.count())
    suspects = staged(suspects, "suspects")
    # Sort-merge at every size: suspects grow with the corpus.
    ids = suspects.select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    # The bytes of suspects: copies shrink to one row in each task before they are shuffled.
    verified = (texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
                .groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")))
    clashes = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    clashes = staged(clashes, "clashes")
    classed = suspects.select("uid", "doc_id", F.col("digest").alias("class"))
    if not clashes.isEmpty():  # texts with the same digest: their class is the text itself
        apart = (texts.join(clashes, "digest", "left_semi").select(
            F.col("doc_id").alias("_id"), "digest", "norm", F.sha2("norm", 256).alias("sum")).distinct())
        hit = suspects.join(clashes, "digest", "left_semi")
        by_text = hit.join(apart, F.col("doc_id").eqNullSafe(F.col("_id")) & (hit.digest == apart.digest)
                           & (F.col("text_sha256") == F.col("sum")))
        classed = suspects.join(clashes, "digest", "left_anti").select("uid", "doc_id", F.col("digest").alias("class")) \
            .unionByName(by_text.select("uid", "doc_id", F.concat(hit.digest, F.lit(" "), "norm").alias("class")))
    firsts = (classed.groupBy("class").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    firsts = staged(firsts.select("class", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"),
                                  F.col("n").alias("group_size")), "firsts")
    # A hot class is one key with many narrow rows; the join of two plain tables is split by adaptive execution.
    members = classed.join(firsts, "class").select(F.col("uid").alias("_uid"), "keep_id", "keep_uid", "group_size")
    found = narrow.join(members, F.col("uid") == F.col("_uid"), "left")
    alone = F.col("keep_uid").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    kept = find_copies(docs).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_texts"))
    kept = staged(kept, "kept")
    key = f"_{docs.columns.index('doc_id')}"
    text = f"_{docs.columns.index('text')}"
    rows = positional(docs).join(kept, F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    # Ids that occur in several rows are rare: only those rows are compared as whole texts.
    repeated = staged(pick(docs, "doc_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
                      .where("n > 1"), "repeated")
    if repeated.isEmpty():
        return rows.toDF(*docs.columns)
    raise_on = F.col(key).eqNullSafe(F.col("_id"))
    ordinary = rows.join(repeated, raise_on, "left_anti")
    again = rows.join(repeated, raise_on, "left_semi").withColumn("_norm", normalised(text))
    sums = find_copies(docs).where("kept").select(F.col("doc_id").alias("_id"), "text_sha256")
    again = again.join(sums, F.col(key).eqNullSafe(F.col("_id")) & (F.sha2("_norm", 256) == F.col("text_sha256")),
                       "left_semi").dropDuplicates([key, "_norm"]).drop("_norm")
    return ordinary.unionByName(again).toDF(*docs.columns)
