"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards. In a shard, every (position, turn) has the bitset of the conversations that say this turn
there. Depth first, the bitset of a node and the postings of the next turns give its children by intersection, the number
of members by counting bits, the smallest member by the lowest bit and, with one bitset for each length, the members that
end there. Shards name a node by a fingerprint of its turns, so Spark adds up what they found.

Conversations are also cut into segments of positions: a segment starts from the fingerprints of what came before it, which
are known without walking there. So neither very many conversations nor a very long one meet in one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, staged

SEGMENT = 1024  # turns of a conversation in one shard
SHARD_ROWS = 50_000  # turns of all conversations in one shard, on average
SIBLINGS = 100  # conversations that may share a head: ids that differ in the last two digits only
BLOCK = 5_000  # ids that are written as one text

_NODE = ("key_a long, key_b long, parent_a long, parent_b long, depth long, conv_id long, n_convs long, chars long, "
         "ends array<long>")


class Trie(NamedTuple):
    """Nodes by key, and the conversations that end at them: key, conv_id."""

    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id (digest of role and text), chars; by turn, NULL first, then role and digest.

    A conversation may hold any share of all rows: rows are put in order by ranges, which cut large conversations, and each
    range is numbered by itself, starting from what lies in the ranges before it.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat_ws(",", F.length(role), F.concat(role, text))
    rows = staged(turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("turn_id"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_row")), "turns")
    order = [F.asc_nulls_first("turn"), "role", "turn_id", "_row"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (4 * SHARD_ROWS)))
    ranged = staged(rows.repartitionByRange(parts, "conv_id", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("conv_id", "_part").orderBy(*order)
    placed = ranged.withColumn("_rank", F.row_number().over(within) - 1).join(bases.hint("merge"), ["conv_id", "_part"])
    return placed.select("conv_id", (F.col("_base") + F.col("_rank")).alias("pos"), "turn_id", "chars")


def with_shared_heads(rows: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows of ``numbered`` with the head of each conversation replaced, and conv_id, n (turns) of all conversations.

    The first h turns become those of the conversation whose id ends in 00 (all it has if fewer, none if it is absent); h is
    the crc32 of the id in decimal digits, modulo ``most`` + 1. Ids are taken apart like SQL's %, so -7 belongs to 0.
    """
    base = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    lengths = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = lengths.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    heads = lengths.select(F.col("conv_id").alias("base"), F.least("own", F.lit(most)).alias("had"))
    convs = convs.join(heads.hint("merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("had", F.lit(0))))
    convs = staged(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
                   .select("conv_id", "base", "h", "taken", "n"), "conversations")
    own = rows.join(convs.select("conv_id", "h", "taken").hint("merge"), "conv_id").where(F.col("pos") >= F.col("h")) \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "chars")
    first = rows.where((F.col("pos") < most) & (F.col("conv_id") % SIBLINGS == 0)).withColumnRenamed("conv_id", "base")
    head = first.join(convs.select("conv_id", "base", "h").hint("merge"), "base").where(F.col("pos") < F.col("h")) \
        .select("conv_id", "pos", "turn_id", "chars")
    return own.unionByName(head), convs.select("conv_id", "n")


def _sharded(rows: DataFrame, convs: DataFrame, turns: int) -> DataFrame:
    """Rows with segment, shard, length of their conversation, fingerprints of the turn and of all earlier segments.

    Fingerprints of (position, turn) pairs are joined by exclusive or, so those of a segment need no order.
    """
    told = rows.join(convs.hint("merge"), "conv_id").withColumns({
        "segment": F.expr(f"pos div {turns}"), "a": F.xxhash64("pos", "turn_id"), "b": F.xxhash64("turn_id", "pos")})
    silent = convs.where("n = 0").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"),
                                         F.lit(0).cast("long").alias("chars"), "n", F.lit(0).cast("long").alias("segment"),
                                         F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    told = staged(told.select(*silent.columns).unionByName(silent), "rebuilt")
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = told.where(F.col("n") > turns).groupBy("conv_id", "segment").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    carried = long_ones.select("conv_id", "segment", F.bit_xor("x").over(before).alias("from_a"), F.bit_xor("y").over(before).alias("from_b"))
    shards = max(1, -(-told.count() // SHARD_ROWS))
    first = told.where("segment = 0").withColumns({"from_a": F.lit(0).cast("long"), "from_b": F.lit(0).cast("long")})
    later = told.where("segment > 0").join(carried.where("segment > 0").hint("merge"), ["conv_id", "segment"]).select(*first.columns)
    family = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    return first.unionByName(later).withColumn("shard", F.pmod(F.xxhash64(family), F.lit(shards)))


def _bits(places: list[int]) -> int:
    found = bytearray(places[-1] // 8 + 1)
    for at in places:
        found[at >> 3] |= 1 << (at & 7)
    return int.from_bytes(found, "little")


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def grow(shard: pa.Table, turns: int) -> Iterator[tuple]:
    """Nodes of one segment of the conversations of one shard, depth first, in the order of ``_NODE``."""
    rows = shard.select(["conv_id", "pos", "turn_id", "chars", "n", "a", "b", "from_a", "from_b"]).to_pydict()
    convs = sorted(set(rows["conv_id"]))
    place = {conv: at for at, conv in enumerate(convs)}
    segment = shard.column("segment")[0].as_py()
    said: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    begun: dict[tuple[int, int], set[int]] = defaultdict(set)
    lengths: dict[int, set[int]] = defaultdict(set)
    turn_at: dict[tuple[int, int], tuple] = {}
    for conv, pos, turn, chars, n, a, b, from_a, from_b in zip(*rows.values()):
        at = place[conv]
        begun[from_a, from_b].add(at)
        lengths[n].add(at)
        if pos >= 0:
            said[pos, turn].append(at)
            turn_at[at, pos] = (turn, chars, a, b)
    postings = {key: _bits(sorted(places)) for key, places in said.items()}
    ending = {n: _bits(sorted(places)) for n, places in lengths.items()}
    first, last = segment * turns, (segment + 1) * turns
    # The node where a later segment starts is told by the segment before.
    waiting = [(first, key, None, _bits(sorted(places)), 0) for key, places in begun.items()]
    while waiting:
        depth, key, parent, members, chars = waiting.pop()
        ended = members & ending.get(depth, 0)
        if depth > first or depth == 0:
            ends, rest = [], ended
            while rest:
                low = _lowest(rest)
                ends.append(convs[low])
                rest &= rest - 1
            yield (*key, *(parent or (None, None)), depth, convs[_lowest(members)], members.bit_count(), chars, ends)
        rest = members & ~ended if depth < last else 0
        while rest:
            turn, size, a, b = turn_at[_lowest(rest), depth]
            child = rest & postings[depth, turn]
            rest &= ~child
            waiting.append((depth + 1, (key[0] ^ a, key[1] ^ b), key, child, size))


def _grown(table: pa.Table, turns: int) -> pa.Table:
    kinds = pa.schema([(name, pa.list_(pa.int64()) if name == "ends" else pa.int64())
                       for name in (part.split()[0] for part in _NODE.split(", "))])
    found = list(zip(*grow(table, turns))) or [[] for _ in kinds]
    return pa.Table.from_arrays([pa.array(column, kind.type) for column, kind in zip(found, kinds)], schema=kinds)


def build(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> Trie:
    """Trie of the conversations ``convs`` (conv_id, n) with the turns ``rows`` (conv_id, pos, turn_id, chars).

    Nodes: key_a, key_b, parent_a, parent_b (NULL for the root), depth, conv_id (smallest member), n_convs, chars (of the last
    turn), n_children. The path of a node is the first ``depth`` turns of its conv_id. Conversations without turns are
    members of the root; without conversations there are no nodes. Equal conversations share all their nodes.
    """
    shards = _sharded(rows, convs, segment).groupBy("segment", "shard")
    found = staged(shards.applyInArrow(lambda shard: _grown(shard, segment), _NODE), "shard-nodes")
    merged = found.groupBy("key_a", "key_b").agg(
        *[F.min(c).alias(c) for c in ("parent_a", "parent_b", "depth", "conv_id")], F.sum("n_convs").alias("n_convs"),
        F.min("chars").alias("chars"))
    merged = staged(merged, "nodes")
    children = merged.where("depth > 0").groupBy(F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children.hint("merge"), ["key_a", "key_b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    ends = found.select("key_a", "key_b", F.explode("ends").alias("conv_id"))
    return Trie(staged(nodes, "trie"), ends)


def subtree_sums(nodes: DataFrame, **values: object) -> DataFrame:
    """key_a, key_b and the sum of each value (a column over ``nodes``) over the subtree of every node.

    Each round doubles the distance that sums come from, so rounds grow with the logarithm of the depth.
    """
    names = list(values)
    up = staged(nodes.select("key_a", "key_b", F.col("parent_a").alias("up_a"), F.col("parent_b").alias("up_b"),
                             *[value.cast("long").alias(name) for name, value in values.items()]), "sums")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        below = up.where("up_a is not null").groupBy(F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")) \
            .agg(*[F.sum(name).alias(f"{name}_below") for name in names])
        above = up.select(F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("up_a").alias("next_a"),
                          F.col("up_b").alias("next_b"))
        moved = up.join(below.hint("merge"), ["key_a", "key_b"], "left").join(above.hint("merge"), ["up_a", "up_b"], "left")
        up = staged(moved.select("key_a", "key_b", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"),
                                 *[(F.col(name) + F.coalesce(f"{name}_below", F.lit(0))).alias(name) for name in names]), "sums")
    return up.drop("up_a", "up_b")


def digests(ends: DataFrame) -> DataFrame:
    """key_a, key_b, ends_sha256: digest of the ids that end at a node, ascending, in decimal, joined by commas.

    Ids are ordered by ranges, which cut the lists of nodes with very many, and written as blocks of text; a digest then
    reads the blocks of its node one after the other and holds one at a time.
    """
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key_a": key[0], "key_b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}])

        now, ids = None, []
        for batch in batches:
            for a, b, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and ((a, b) != now or len(ids) == BLOCK):
                    yield block(now, ids)
                    ids = []
                now = (a, b)
                ids.append(conv)
        if ids:
            yield block(now, ids)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: tuple[int, int], digest: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key_a": key[0], "key_b": key[1], "ends_sha256": digest.hexdigest()}])

        now, digest = None, None
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b", "ids"))):
                if (a, b) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    yield told(now, digest)
                now, digest = (a, b), hashlib.sha256(ids.encode())
        if now:
            yield told(now, digest)

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key_a", "key_b", "conv_id"]
    blocks = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .mapInArrow(written, "key_a long, key_b long, first long, ids string")
    return blocks.repartition(parts, "key_a", "key_b").sortWithinPartitions("key_a", "key_b", "first") \
        .mapInArrow(digested, "key_a long, key_b long, ends_sha256 string")


def described(trie: Trie) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = trie.nodes
    sums = subtree_sums(nodes, n_leaves=F.col("n_children") == 0, saved_tokens=(F.col("n_convs") - 1) * F.col("chars"))
    parents = nodes.select(F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums.hint("merge"), ["key_a", "key_b"]).join(digests(trie.ends).hint("merge"), ["key_a", "key_b"], "left") \
        .join(parents.hint("merge"), ["parent_a", "parent_b"], "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, most: int = 5, segment: int = SEGMENT) -> DataFrame:
    """Every node of the trie of conversations with shared heads.

    NULL roles and texts are empty, rows without a conversation are left out, repeated rows are turns of their own, other
    columns are ignored whatever their names, and a table without rows gives no nodes.
    """
    return described(build(*with_shared_heads(staged(numbered(conversations), "numbered"), most), segment))
