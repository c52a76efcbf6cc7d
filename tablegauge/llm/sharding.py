"""Shards of nearly equal bytes by a k-d tree over metadata.

A node is split along its widest dimension at the weighted median of its bytes (for an odd number of leaves at the
matching fraction), until every node is one shard. All nodes of a level are split together. A median is found by counting
bytes in equal bins and going into the bin that holds it: each pass is one aggregate with partial sums, and the driver
sees one row for each node. Rows are never sorted or moved for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shared import dense_positions, pick, staged, text_or_empty
from tablegauge.workdir import small_table

BINS = 4096
# A median is near enough when its bin holds less than this share of an average shard.
TOLERANCE = 0.001
ROW_BYTES = 16
DIMENSIONS = ("position", "size", "kind", "origin")
KEYS = [f"{name}_key" for name in DIMENSIONS]


@dataclass
class Node:
    """A box, named by the first of its shards, that is still to be split."""

    shard: int
    leaves: int
    weight: int = 0
    axis: int = 0
    cut: int | None = None  # keys below it go left
    start: int = 0  # the cut is sought from here to ``end``, with ``left`` bytes still to lie before it
    end: int = 0
    left: float = 0.0

    @property
    def width(self) -> int:
        return max(1, -(-(self.end - self.start) // BINS))


def metadata(docs: DataFrame, extra: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32 and one 63-bit key a dimension: its value scaled to 32 bits, then 31 bits of a hash that
    tells equal values apart. Columns that are missing or NULL are one value."""
    there = [name for name in extra if name in docs.columns]
    rows = pick(docs, "doc_id", "text", *there)
    code = {name: F.xxhash64(F.col(name).cast("string")).bitwiseAND(F.lit(2**31 - 1)) if name in there else F.lit(0)
            for name in extra}
    rows = rows.select("doc_id", (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
                       F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("position_value"),
                       *[F.coalesce(code[name], F.lit(0)).alias(as_) for name, as_ in zip(extra, ("kind_value", "origin_value"))])
    return staged(rows.withColumns({"size_value": F.col("size"), "row": F.monotonically_increasing_id()}), "metadata")


def keyed(rows: DataFrame) -> DataFrame:
    spans = rows.agg(*[f(f"{d}_value").cast("double").alias(f"{d}_{n}") for d in DIMENSIONS
                       for n, f in (("min", F.min), ("max", F.max))]).first()
    tie = F.xxhash64("doc_id", "text_crc32", "row").bitwiseAND(F.lit(2**31 - 1))  # repeated rows are told apart as well
    keys = []
    for d in DIMENSIONS:
        least, most = spans[f"{d}_min"] or 0.0, spans[f"{d}_max"] or 0.0
        scale = (2**32 - 1) / (most - least) if most > least else 0.0
        scaled = F.floor((F.col(f"{d}_value") - F.lit(least)) * F.lit(scale)).cast("long")
        keys.append((F.shiftleft(F.least(scaled, F.lit(2**32 - 1)), 31) + tie).alias(f"{d}_key"))
    return staged(rows.select("doc_id", "size", "text_crc32", *keys), "keys")


def grow(rows: DataFrame, shards: int) -> DataFrame:
    """Keyed rows with their ``shard``; each level of the tree is written to the shared folder."""
    rows, level = rows.withColumn("shard", F.lit(0)), [Node(0, shards)] if shards > 1 else []
    while level:
        level = _measured(rows, level)
        searching = level
        while searching:
            _narrow(rows, searching)
            searching = [node for node in searching if node.cut is None]
        cuts = _small(rows, [(node.shard, node.axis, node.cut, node.leaves // 2) for node in level], "cut long, step int")
        right = F.array(*KEYS)[F.col("axis")] >= F.col("cut")
        rows = staged(rows.join(F.broadcast(cuts), F.col("shard") == F.col("node"), "left").withColumn(
            "shard", F.col("shard") + F.when(right, F.col("step")).otherwise(0)).drop("node", "axis", "cut", "step"), "level")
        level = [child for node in level for child in (Node(node.shard, node.leaves // 2),
                 Node(node.shard + node.leaves // 2, node.leaves - node.leaves // 2)) if child.leaves > 1]
    return rows


def _small(rows: DataFrame, values: list[tuple], more: str) -> DataFrame:
    """One row a node of a level: fewer than there are shards."""
    schema = f"node int, axis int, {more}"
    names = [column.split()[0] for column in schema.split(", ")]
    return small_table(rows.sparkSession, [dict(zip(names, value)) for value in values], schema)


def _measured(rows: DataFrame, level: list[Node]) -> list[Node]:
    """The nodes of a level that hold rows, with their bytes, widest dimension and the span to search."""
    ends = [f(key).alias(f"{key}_{n}") for key in KEYS for n, f in (("min", F.min), ("max", F.max))]
    named, found = {node.shard: node for node in level}, []
    for row in rows.where(F.col("shard").isin(list(named))).groupBy("shard").agg(F.sum("size").alias("w"), *ends).collect():
        node = named[row["shard"]]
        spans = [(row[f"{key}_min"], row[f"{key}_max"]) for key in KEYS]
        node.weight, node.axis = row["w"], max(range(len(KEYS)), key=lambda i: spans[i][1] - spans[i][0])
        node.start, node.end = spans[node.axis][0], spans[node.axis][1] + 1
        node.left = node.weight * (node.leaves // 2) / node.leaves
        found.append(node)
    return found


def _narrow(rows: DataFrame, nodes: list[Node]) -> None:
    """One pass: go into the bin of every node that holds its cut, or cut beside the bin when it is light enough."""
    asked = _small(rows, [(n.shard, n.axis, n.start, n.end - 1, n.width, n.left) for n in nodes],
                   "start long, last long, width long, goal double")
    key = F.array(*KEYS)[F.col("axis")]
    counted = rows.join(F.broadcast(asked), F.col("shard") == F.col("node")).withColumn("_key", key) \
        .where(F.col("_key").between(F.col("start"), F.col("last"))) \
        .groupBy("node", "goal", F.expr("(_key - start) div width").alias("bin")).agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
    held = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal")))
    found = {row["node"]: row for row in held.collect()}
    for node in nodes:
        row = found.get(node.shard)
        if row is None:  # nothing to the left of the cut
            node.cut = node.start
            continue
        begin, before = node.start + row["bin"] * node.width, row["upto"] - row["w"]
        if node.width == 1 or row["w"] <= TOLERANCE * node.weight / node.leaves:
            node.cut = begin if node.left - before < row["upto"] - node.left else min(begin + node.width, 2**63 - 1)
        else:
            node.start, node.end, node.left = begin, min(begin + node.width, node.end), node.left - before


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (NULL).

    Size is the UTF-8 bytes of the text (NULL: none) plus 16. Sizes of shards differ by about one row at each cut, however
    many rows share a source or a text. Repeated rows and NULL ids are placed like any other; no rows give no rows.
    Columns beside doc_id, text, lang and source are ignored, whatever their names, and the last two may be missing.
    """
    placed = grow(keyed(metadata(docs)), shards).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    slotted = dense_positions(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
