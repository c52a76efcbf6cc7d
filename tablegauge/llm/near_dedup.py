"""Near duplicates by SetSketch registers.

Each text becomes a set of word shingles and each set a sketch: register i holds the truncated, exponentially spaced
minimum of an exponential variate over the set. Registers merge by their maximum, and two sets agree in a register about
as often as their Jaccard similarity says, so bands of registers serve as keys for a search. Candidates are first
judged by the likelihood of their similarity given all registers and both set sizes, then confirmed on the full sets.

No group is expanded into pairs. Equal sets are one node from the start. In each round a node meets the six hubs of other
components that it shares most buckets with, not all of its neighbours; what is already connected is not compared again.
Rounds go on as long as they find links. Nodes that share a bucket and are still in different components then go through an
exact filter on their sets, so that no link among them is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.shared import pick, positional, staged

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))
BITS = 1024  # of the parity bitmap of a set
PART = 500  # texts of a batch that are held as sets at once
DOUBT = 12.0  # a candidate is dropped when the registers are e**12 times likelier under some lower similarity


@dataclass(frozen=True)
class Settings:
    """Shingle length, threshold in percent, and the sketch: registers, base, rate, registers in a band.

    Two orders of the registers give two sets of disjoint bands. With 256 registers and bands of 8, a pair at the
    threshold of 80 % misses all 64 bands with probability 1e-5, one at 85 % with 2e-9, and a pair at 10 % meets in one
    of them with 6e-7, so that passages shared by very many documents bring few candidates.
    """

    words: int = 5
    percent: int = 80
    registers: int = 256
    base: float = 1.001
    rate: float = 20.0
    rows: int = 8
    orders: int = 2
    seed: int = 11

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1, 2**32, (self.registers, 1), dtype=np.uint32) | np.uint32(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a lower-cased text; a shorter text is one shingle."""
    import xxhash

    tokens = text.lower().split()  # lower() and split() of bytes know ASCII only
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if not len(hashes):
        return hashes
    span = min(words, len(hashes))
    n = len(hashes) - span + 1
    mixed = np.full(n, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ hashes[i:i + n]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[2]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def sketch(items: np.ndarray, settings: Settings, multipliers: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes. The least uniform variate gives the least exponential one."""
    if not len(items):
        return np.zeros(settings.registers, np.uint16)
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(settings.registers, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at:at + 2048] * multipliers).min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / settings.rate
    return np.clip(np.floor(1 - np.log(exponential) / math.log(settings.base)), 0, 65534).astype(np.uint16)


def parities(items: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit integers: bit i tells whether an odd number of its hashes ends in i.

    An element that only one of two sets has changes one bit, so their bitmaps differ in no more bits than the sets in elements.
    """
    odd = np.bincount((items & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def may_reach(sketches_a: np.ndarray, sketches_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
              settings: Settings) -> np.ndarray:
    """Whether a similarity of the threshold or more is still likely, from joint maximum likelihood, for rows of pairs."""
    above, below = (sketches_a > sketches_b).sum(axis=1), (sketches_a < sketches_b).sum(axis=1)
    equal = settings.registers - above - below
    u = (size_a / (size_a + size_b))[:, None]
    v, grid = 1 - u, np.linspace(0, 1, 101)[None, :]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (settings.base - 1) / settings.base) / math.log(settings.base)

    more, less = chance(u - v * grid), chance(v - u * grid)
    score = above[:, None] * np.log(more) + below[:, None] * np.log(less) \
        + equal[:, None] * np.log(np.clip(1 - more - less, 1e-9, 1))
    possible = grid <= np.minimum(u / v, v / u) + 0.01
    score = np.where(possible, score, -np.inf)
    return score[:, settings.percent - 1:].max(axis=1) >= score.max(axis=1) - DOUBT


def sketched(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, uid (unique), n_shingles, digest of the full set, registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, uid = settings.multipliers(), TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [shingles(text or b"", settings.words) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.arange(uid, uid + len(sets))), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([sketch(s, settings, multipliers).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "uid", "n_shingles", "digest", "registers"])
            uid += len(sets)

    texts = pick(docs, "doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, uid long, n_shingles long, digest binary, registers binary")


def bands(nodes: DataFrame, settings: Settings) -> DataFrame:
    """One row for each node and band: band (a hash of which registers and their values), node, n."""
    rng, picks = np.random.default_rng(settings.seed + 1), []
    for _ in range(settings.orders):
        order = rng.permutation(settings.registers)
        picks += [order[i:i + settings.rows] for i in range(0, len(order) - settings.rows + 1, settings.rows)]
    places = np.array(picks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, settings.registers)
                values = rows[:, places].astype(np.uint64)
                key = np.broadcast_to(np.arange(1, len(places) + 1, dtype=np.uint64), values.shape[:2]).copy()
                for i in range(settings.rows):
                    key = (key ^ values[:, :, i]) * _MIX[0]
                    key ^= key >> np.uint64(31)
                    key *= _MIX[1]
                    key ^= key >> np.uint64(29)
                each = len(places)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), each)),
                    pa.array(np.repeat(part.column(1).to_numpy(), each))], names=["band", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(run, "band long, node long, n long")


def full_sets(docs: DataFrame, needed: DataFrame, settings: Settings) -> DataFrame:
    """The whole shingle set of each needed node, made again from its text, and its parity bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part, found = batch.slice(at, PART), []
                for text, node, digest in zip(part.column(0).cast(pa.binary()), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    items = shingles(text.as_py() or b"", settings.words)
                    if blake2b(items.tobytes(), digest_size=16).digest() == digest:  # a repeated doc_id may have other texts
                        found.append((node, items))
                sets = [items for _, items in found]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                wide = np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
                none = [np.empty(0, np.int64)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([node for node, _ in found], pa.int64()),
                    pa.ListArray.from_arrays(ends, np.concatenate(none + [items.view(np.int64) for items in sets])),
                    pa.ListArray.from_arrays(wide, np.concatenate(none + [parities(items) for items in sets]))],
                    names=["node", "items", "bits"])

    wanted = needed.select(F.col("doc_id").alias("_id"), "node", "digest").hint("merge")
    texts = pick(docs, "doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
    return texts.select("text", "node", "digest").mapInArrow(run, "node long, items array<long>, bits array<long>")


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, settings.registers)
                        for c in ("ra", "rb"))
                keep = may_reach(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), settings)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    def side(table: DataFrame, node: str, value: str, *more: str) -> DataFrame:
        renamed = {"node": node, value: f"{value[0]}{node}"} | {m: f"{m}{node}" for m in more}
        return table.select(*[F.col(k).alias(v) for k, v in renamed.items()]).hint("merge")

    near = pairs.join(side(nodes, "a", "registers", "n"), "a").join(side(nodes, "b", "registers", "n"), "b")
    size = (100 * F.col("na") >= settings.percent * F.col("nb")) & (100 * F.col("nb") >= settings.percent * F.col("na"))
    near = near.where(size).mapInArrow(likely, "a long, b long")
    full = near.join(side(sets, "a", "items").withColumnRenamed("ia", "sa"), "a") \
        .join(side(sets, "b", "items").withColumnRenamed("ib", "sb"), "b")
    # Row by row in Spark: the sets of a batch of pairs have no bound, as one long set may be in many pairs.
    both = F.size(F.array_intersect("sa", "sb"))
    return full.where((100 + settings.percent) * both >= settings.percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def overlapping(nodes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (x, y) of nodes (node, n, label) with different labels that can reach the threshold: none of those is left out.

    Shingles are put in one order, rarest first. Two sets at the threshold share a shingle among the first of each, and
    after their first common one both still have enough left. Their parity bitmaps differ in no more bits than they differ in
    shingles. Sets that have only common passages in common, or many small differences, are told apart by this within the
    join and never become rows.
    """
    wanted = sets.join(nodes.select("node").hint("merge"), "node")
    tokens = wanted.select(F.explode("items").alias("token"), "node")
    tokens = staged(tokens, "tokens")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").hint("merge")
    ordered = tokens.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nodes", "token"))).alias("shared"))
    ordered = ordered.join(nodes.hint("merge"), "node").select("node", "n", "label", F.size("shared").alias("width"), F.posexplode("shared"))
    # Shingles of no other set come first and are not rows.
    ordered = ordered.select(F.col("col.token").alias("token"), "node", "n", "label", (F.col("n") - F.col("width") + F.col("pos")).alias("place"))
    prefixes = ordered.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * settings.percent / 100))
    first = staged(prefixes.join(wanted.select("node", "bits").hint("merge"), "node"), "prefixes")
    other = first.select("token", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "label", "place", "bits")]).hint("merge")
    left = F.least(F.col("n") - F.col("place"), F.col("n_y") - F.col("place_y"))
    either = F.col("n") + F.col("n_y")
    unlike = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(BITS // 64)), F.lit(0))
    return first.join(other, "token").where(
        (F.col("node") < F.col("node_y")) & (F.col("label") != F.col("label_y"))
        & (100 * F.col("n") >= settings.percent * F.col("n_y")) & (100 * F.col("n_y") >= settings.percent * F.col("n"))
        & ((100 + settings.percent) * left >= settings.percent * either)
        & ((100 + settings.percent) * (either - unlike) >= 2 * settings.percent * either)) \
        .select(F.col("node").alias("x"), F.col("node_y").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): label is the smallest node it is connected with.

    Labels spread along edges and then jump to the label of the label, so the number of rounds grows with the
    logarithm of a chain's length. Each round's labels are written to the shared folder.
    """
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("near"))
        lower = labels.join(told, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("further"))
        moved = staged(lower.join(jump, "lower", "left").select(
            "node", F.least("lower", F.coalesce("further", "lower")).alias("label"), F.col("label").alias("before")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after components that ``links`` (a, b) connect are made one; only labels are compared."""
    ends = labels.hint("merge")
    joined = links.join(ends.select(F.col("node").alias("a"), F.col("label").alias("la")), "a") \
        .join(ends.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    moves = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    told = labels.join(moves.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left")
    return staged(told.select("node", F.coalesce("_to", "label").alias("label")), "labels")


def mixed_buckets(buckets: DataFrame, labels: DataFrame, round_: int) -> DataFrame:
    """band, node, n, label, low, high for the buckets that hold several components.

    ``low`` and ``high`` are nodes of two of them, other ones in each round, so every node of a bucket can meet one that it is
    not connected with.
    """
    labelled = buckets.select("band", "node", "n").join(labels.hint("merge"), "node")
    hub = F.struct(F.xxhash64("label", F.lit(round_)).alias("of"), F.xxhash64("node", F.lit(round_)).alias("at"), "node", "label")
    hubs = labelled.groupBy("band").agg(F.min(hub).alias("low"), F.max(hub).alias("high")).where("low.label <> high.label")
    return labelled.join(hubs.hint("merge"), "band")


def met_hubs(apart: DataFrame, hubs: int = 6) -> DataFrame:
    """Pairs (a, b): each node with the hubs of other components that it shares most buckets with."""
    told = apart.select("node", "label", F.explode(F.array("low", "high")).alias("hub")).where("label <> hub.label")
    shared = told.groupBy("node", F.col("hub.node").alias("hub"), F.col("hub.at").alias("at")).agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "at", "hub"))
    best = shared.withColumn("_place", place).where(F.col("_place") <= hubs)
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


# A round in which fewer of the pairs than one in FEW are links is the last; the exact filter sees to what is left then.
FEW, ROUNDS = 40, 30


def linked(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), component_id of every row of ``docs``."""
    rows = staged(sketched(docs, settings), "sketches")
    narrow = rows.select("doc_id", "uid", "n_shingles", "digest")
    classes = staged(narrow.where("n_shingles > 0").groupBy("digest").agg(F.min("uid").alias("node")), "classes")
    nodes = rows.join(classes.select(F.col("node").alias("uid")).hint("merge"), "uid") \
        .select(F.col("uid").alias("node"), "doc_id", "digest", F.col("n_shingles").alias("n"), "registers")
    banded = bands(nodes, settings)
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    buckets = staged(banded.join(shared.select("band").hint("merge"), "band"), "buckets")
    meeting = staged(buckets.select("node").distinct(), "meeting")
    met = staged(nodes.join(meeting.hint("merge"), "node"), "nodes")
    sets = staged(full_sets(docs, met, settings), "sets")
    met = met.select("node", "n", "registers")
    labels, tested = staged(meeting.select("node", F.col("node").alias("label")), "labels"), None
    for round_ in range(ROUNDS):
        buckets = staged(mixed_buckets(buckets, labels, round_), "apart")  # a bucket of one component stays one
        pairs = met_hubs(buckets)
        pairs = staged(pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        links = staged(confirmed(pairs, met, sets, settings), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = links.count()
        if found:
            labels = relabelled(labels, links)
        if found * FEW < pairs.count() or not found:
            break
    apart = mixed_buckets(buckets, labels, ROUNDS).select("node", "n", "label").distinct()
    pairs = overlapping(staged(apart, "apart"), sets, settings).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    fresh = staged(pairs.distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    labels = relabelled(labels, staged(confirmed(fresh, met, sets, settings), "links"))
    classes = classes.join(labels.hint("merge"), "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    placed = narrow.join(classes.hint("merge"), "digest", "left").withColumn("label", F.coalesce("label", "uid"))
    placed = placed.withColumn("label", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("uid")))
    placed = staged(placed.select("doc_id", "n_shingles", "digest", "label"), "placed")
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    found = placed.join(smallest.where("_n > 1").drop("_n").hint("merge"), "label", "left")
    return found.select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"))


def link(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts with fewer words than a shingle are one shingle; NULL and empty texts and those without a word have an empty
    set and are linked with nothing. ``component_id`` is the smallest doc_id that links lead to; ``kept`` marks rows whose
    doc_id it is. Repeated rows are equal sets and get the same answer. No rows give no rows; other columns are ignored,
    whatever their names.
    """
    return linked(docs, settings).select("doc_id", "n_shingles", "component_id",
                                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def with_digests(docs: DataFrame, place: int, settings: Settings) -> DataFrame:
    """``docs`` with the digest of the set of the text column at a place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            digests = [blake2b(shingles(text or b"", settings.words).tobytes(), digest_size=16).digest() for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "_digest"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_digest", T.BinaryType())]))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, all columns unchanged.

    An id that rows of different texts share is told by id and set of each row, so one of them may stay and another not.
    """
    found = staged(linked(docs, settings), "linked")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    place, plain = docs.columns.index("doc_id"), positional(docs)
    key = F.col(f"_{place}")
    several = staged(found.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
                     .where("low <> high").select(F.col("doc_id").alias("_id")), "several")
    stay = staged(found.where(kept).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept")).distinct(), "kept")
    one = stay.join(several, stay["_id"].eqNullSafe(several["_id"]), "left_anti").select("_id").distinct().hint("merge")
    result = plain.join(one, key.eqNullSafe(F.col("_id")), "left_semi")
    if not several.isEmpty():
        rows = plain.join(several.hint("merge"), key.eqNullSafe(F.col("_id")), "left_semi")
        told = with_digests(rows, docs.columns.index("text"), settings).join(
            stay, key.eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept")), "left_semi").drop("_digest")
        result = result.unionByName(told)
    return result.toDF(*docs.columns)
