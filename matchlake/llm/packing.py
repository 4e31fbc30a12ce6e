"""Variable-capacity best-fit packing of documents into training sequences.

The plan is made on the histogram of lengths, not on documents: lengths from the longest down, each count placed into
the open bins that it fills best, all equal bins at once. It has a few steps for each distinct length, of which there
are no more than the largest capacity, however many documents there are. Documents get ranks among those of their
length and find their bins in the plan without any of them meeting in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import keyed, small_batches, stored

#: Permitted sequence lengths, in words and ends.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, so that few long ones are preferred to many short ones of equal waste.
OVERHEAD = 8
#: Rows of a length that one task ranks, about.
RANKED = 100_000


class Plan:
    """Best fit of counts of lengths, longest first.

    steps: (length, first rank, number in each bin, first bin, start in the bin); ranks fill one bin after the other.
    bins: (first bin, number, content, capacity) after downsizing.
    """

    def __init__(self, counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD):
        self.capacities = sorted(capacities)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.bins: list[tuple[int, int, int, int]] = []
        self.made = 0
        #: room left -> groups (first bin, number, content); rooms is sorted.
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.rooms: list[int] = []
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length], overhead)
        for groups in self.open.values():
            self.bins += [(first, n, content, self._least(content)) for first, n, content in groups]
        self.bins.sort()

    def _least(self, content: int) -> int:
        return self.capacities[bisect.bisect_left(self.capacities, content)]

    def _keep(self, room: int, group: tuple[int, int, int]) -> None:
        if room not in self.open:
            self.open[room] = []
            bisect.insort(self.rooms, room)
        self.open[room].append(group)

    def _place(self, length: int, left: int, overhead: int) -> None:
        rank = 0
        while left:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                # the least cost for each item, if the bin were filled with items of this length; then the largest bin
                size = min((c for c in self.capacities if c >= length), key=lambda c: ((c + overhead) / (c // length), -c))
                n = -(-left // (size // length))
                self._keep(size, (self.made, n, 0))
                self.made += n
                continue
            room = self.rooms[at]
            first, n, content = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            # what is left of a bin fits best again until it is too small, so each bin takes as many as it can
            each = min(room // length, left)
            bins = min(n, left // each)
            if bins < n:
                self._keep(room, (first + bins, n - bins, content))
            self.steps.append((length, rank, each, first, content))
            self._keep(room - each * length, (first, bins, content + each * length))
            rank += bins * each
            left -= bins * each


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length): words of the whole text and one end."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len((x or "").encode("utf-8", "surrogatepass").split()) + 1 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "length"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc_id long, length long")


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, piece_length, bin_id, bin_size, bin_start for lengths(doc_id, length).

    Longer documents than the largest capacity are cut into pieces of that size and a rest; nothing is dropped. Bins
    are opened at the size of least cost, filled by best fit and at last made as small as a permitted length allows.
    Lengths under 1, or null, take no room and give no rows. Repeated rows, and rows with null ids, are packed each on
    its own; further columns are not read. An empty table
    gives no rows.
    """
    spark = lengths.sparkSession
    small_batches(spark)
    most = max(capacities)
    whole = lengths.filter("length >= 1").select("doc_id", "length")
    pieces = whole.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0L, (length - 1) div {most}), i -> least(length - i * {most}, {most}L))")).alias("piece", "piece_length"))
    pieces = keyed(stored(pieces, "pieces"))  # pieces are told apart by their place in what was written: ids may be null or repeat
    total = pieces.count()
    salts = max(8, -(-total // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)))
    parts = salted.groupBy("piece_length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("piece_length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["piece_length"]: r["n"] for r in parts.groupBy("piece_length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, capacities, overhead)
    steps = np.array(sorted(plan.steps), np.int64).reshape(-1, 5)
    bins = np.array(plan.bins, np.int64).reshape(-1, 4)
    made = spark.sparkContext.broadcast((steps, bins))
    rank = F.row_number().over(Window.partitionBy("piece_length", "salt").orderBy("doc_id", "piece", "row_key")) - 1
    ranked = salted.withColumn("within", rank).join(offsets, ["piece_length", "salt"]).select("doc_id", "piece", "piece_length", (F.col("offset") + F.col("within")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, bins = made.value
        wide = np.int64(1) << 40  # ranks stay below; steps are sorted by length, then rank
        key = steps[:, 0] * wide + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            step = steps[np.searchsorted(key, length * wide + rank, "right") - 1]
            bin_id = step[:, 3] + (rank - step[:, 1]) // step[:, 2]
            start = step[:, 4] + (rank - step[:, 1]) % step[:, 2] * length
            size = bins[np.searchsorted(bins[:, 0], bin_id, "right") - 1, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(bin_id), pa.array(size), pa.array(start)], names=["doc_id", "piece", "piece_length", "bin_id", "bin_size", "bin_start"])

    return ranked.select("doc_id", F.col("piece").cast("long"), "piece_length", "rank").mapInArrow(work, "doc_id long, piece long, piece_length long, bin_id long, bin_size long, bin_start long")
