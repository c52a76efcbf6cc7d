"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length decides which lengths share a sequence. That histogram has at most ``capacity``
entries whatever the corpus, so the plan is made from it: sets that provably dominate every alternative are fixed, the
shrunk instance is packed best-fit in order of decreasing length. The plan is a table of runs ("pieces 0 to 999 of length
700 go to sequences 40 to 539, two to a sequence, from place 0"), and every piece finds its run by its length and its
rank among the pieces of that length. Ranks are dealt within tasks and moved by a running sum over the tasks' counts, so
no piece is moved to be ranked, however many have the same length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, staged
from tablegauge.llm.word_ids import WordIds

CAPACITY = 4096
END = 1  # id after each document
PIECES = "piece int, start long, length long, ids binary, task long, rank long"


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (little-endian unsigned 32-bit) and, for
    ranking, the task that made the piece and its rank among the pieces of that length there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordIds.of(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [text or b"" for text in part.column(1).cast(pa.binary()).to_pylist()]
                rows: list[tuple] = []
                for row, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        span = ids[start:start + capacity]
                        rows.append((row, piece, start, len(span), span.tobytes(), task, seen[len(span)]))
                        seen[len(span)] += 1
                columns = list(zip(*rows))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(columns[0], pa.int64())),
                     *(pa.array(values, kind) for values, kind in zip(columns[1:], kinds))],
                    names=["doc_id", *(name.split()[0] for name in PIECES.split(", "))])

    texts = pick(docs, "doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {PIECES}")


class Plan:
    """Runs of a packing; sequences are numbered from 0."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.left = capacity, {size: n for size, n in counts.items() if n > 0}
        self.ranks = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset, each
        self.reduce()
        self.fixed_sequences = self.sequences
        self.best_fit()

    def take(self, size: int, sequences: int, first: int, offset: int, each: int) -> None:
        """Put ``each`` pieces of a length, side by side from ``offset``, into each of some sequences."""
        self.runs.append((size, self.ranks[size], sequences * each, first, offset, each))
        self.ranks[size] += sequences * each
        self.left[size] -= sequences * each
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int]) -> None:
        """As many sequences of just these lengths as there are pieces for."""
        each = {size: sizes.count(size) for size in sizes}
        times, offset = min(self.left[size] // n for size, n in each.items()), 0
        for size, n in each.items():
            self.take(size, times, self.sequences, offset, n)
            offset += size * n
        self.sequences += times

    def reduce(self) -> None:
        """Fix sets that hold the largest piece and dominate all others that could hold it.

        A set dominates another when the other's pieces can be dealt to its pieces so that none gets more than its own
        length; swapping them then costs no sequence. Removing pieces keeps a set dominating, so it is fixed as often as
        its pieces allow.
        """
        for size in sorted(self.left, reverse=True):
            while size in self.left:
                chosen = self.dominating(size)
                if chosen is None:
                    break
                self.fix(chosen)

    def dominating(self, size: int) -> list[int] | None:
        room = self.capacity - size
        others = sorted((s for s, n in self.left.items() if s <= room and n > (s == size)))
        if not others:
            return [size]  # nothing fits beside it

        def spare(s: int) -> int:
            return self.left.get(s, 0) - (s == size)

        largest = others[-1]
        smallest = [s for s in others[:3] for _ in range(min(3, spare(s)))][:3]
        if largest == room:
            return [size, largest]  # a full sequence: all else that fits there fits into the partner's place
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return [size, largest]  # only one more piece fits: the largest
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        # At most two more pieces fit. The largest with the largest beside it dominates pairs with a smaller second.
        beside = [s for s in others if s <= room - largest and spare(s) > (s == largest)]
        second = max((y for y in others if 2 * y <= room and (spare(y) > 1 or any(
            y < x <= room - y for x in others[bisect_right(others, y):]))), default=0)
        if beside and second <= beside[-1]:
            return [size, largest, beside[-1]]
        best = max((x + others[i - 1] for x in others if (i := bisect_right(others, room - x))
                    and (others[i - 1] != x or spare(x) > 1 or i > 1)), default=0)
        return [size, largest] if best <= largest else None

    def best_fit(self) -> None:
        """Decreasing lengths, each piece into the fullest sequence that has room; equal sequences are filled at once."""
        open_: dict[int, list[list[int]]] = {}
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    insort(rooms, room)
                open_.setdefault(room, []).append([first, n])

        for size in sorted(self.left, reverse=True):
            while n := self.left.get(size, 0):
                at = bisect_left(rooms, size)
                room = rooms[at] if at < len(rooms) else self.capacity
                if at < len(rooms):
                    first, there = open_[room][-1]
                else:
                    first, there = self.sequences, n
                each = room // size
                taken = min(there, n // each)
                if not taken:
                    taken, each = 1, n
                self.take(size, taken, first, self.capacity - room, each)
                if at == len(rooms):
                    self.sequences += taken
                else:
                    group = open_[room][-1]
                    group[0], group[1] = first + taken, there - taken
                    if not group[1]:
                        open_[room].pop()
                        if not open_[room]:
                            del open_[room]
                            rooms.pop(at)
                add(room - each * size, first, taken)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; ``pieces`` is a stored table as ``tokenised`` makes it.

    Sequences have no gaps. Pieces as long as a sequence have one to themselves. No pieces give no rows.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "lengths")
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"),
                          F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # At most a few runs for each length and never more than capacity ** 2 / 2, however many pieces there are.
    runs = spark.createDataFrame(plan.runs, "run_length long, run_first long, run_pieces long, first long, place long, each long")
    ranked = pieces.join(bases, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    within = F.col("base") + F.col("rank") - F.col("run_first")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (within >= 0)
                         & (within < F.col("run_pieces")))
    return placed.select(*pieces.columns, (F.col("first") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("place") + within % F.col("each") * F.col("length")).cast("long").alias("offset")) \
        .drop("task", "rank")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids, sequence_id, offset.

    NULL and empty texts are one id, the end mark. Only documents longer than ``capacity`` are cut. Repeated rows and
    NULL ids are packed as they come; other columns are ignored, whatever their names.
    """
    return pack(staged(tokenised(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids. One group is one sequence, at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x.ids), "")).alias("ids"))
