"""Bounded-space online packing: whatever the corpus, a task holds a fixed number of open windows.

Documents are taken in the order in which they are read. One goes into the open window with the tightest gap that holds it. If
none does and no more may be opened, the fullest window is filled up with the document's beginning and emitted, and the rest is
placed like a document. What a long document has of whole windows is emitted at once. So every emitted window is full, most
documents stay whole, and there is at most one cut for each window.

At a partition's end its open windows are left. They are merged over all partitions: laid end to end, where each begins is the
prefix sum of what the partitions before it have left, one number for each, and cut every `capacity` tokens. Only the end of
the last one is short; it is cut into windows whose sizes are powers of two, which aren't padded. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, vocabulary

#: Open windows of a task.
OPEN = 32
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, window long, offset long"


class Windows:
    """place() yields finished windows, lists of pieces (key, start, length); left() the open ones."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.gaps: list[tuple[int, int]] = []  # (gap, window), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0

    def place(self, key: object, n: int) -> Iterator[list[tuple]]:
        at = 0
        while at < n:
            left = n - at
            if left >= self.capacity:
                yield [(key, at, self.capacity)]
                at += self.capacity
                continue
            k = bisect_left(self.gaps, (left, -1))
            if k < len(self.gaps):
                gap, window = self.gaps.pop(k)
            elif len(self.gaps) < self.most:
                gap, window = self.capacity, self.opened
                self.opened += 1
                self.pieces[window] = []
            else:
                gap, window = self.gaps.pop(0)  # the fullest
            own = min(left, gap)
            self.pieces[window].append((key, at, own))
            at += own
            if own == gap:
                yield self.pieces.pop(window)
            else:
                insort(self.gaps, (gap - own, window))

    def left(self) -> list[list[tuple]]:
        """The fullest first."""
        return [self.pieces[window] for _, window in self.gaps]


def placed(docs: DataFrame, capacity: int, path: str, end_id: int, most: int) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, task, window (its number in the task; null: left over), offset (in the window, or
    in what the task has left over)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens, end = TaskContext.get().partitionId(), encoder(path), end_id.to_bytes(4, "little")
        windows, made, waiting = Windows(capacity, most), 0, []

        def add(pieces: list[tuple], window: int | None, offset: int) -> int:
            for (doc_id, ids), start, length in pieces:
                waiting.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, task, window, offset))
                offset += length
            return offset

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*waiting)) or [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _SCHEMA.split(", ")])
            waiting.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.ids(text) + end
                for pieces in windows.place((doc_id, ids), len(ids) // 4):
                    add(pieces, made, 0)
                    made += 1
                    if len(waiting) >= 1000:
                        yield rows()
        at = 0
        for pieces in windows.left():
            at = add(pieces, None, at)
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, _SCHEMA)


def merged(rest: DataFrame, capacity: int) -> DataFrame:
    """The left-over pieces (task, offset: their place among those of the task) laid end to end and cut into windows:
    sequence_id from 0, offset."""
    sums = sorted((r["task"], r["n"]) for r in rest.groupBy("task").agg(F.sum("length").alias("n")).collect())  # one row for each task
    begins = [0, *accumulate(n for _, n in sums)]
    whole, total = begins[-1] // capacity, begins[-1]
    ends = [whole * capacity]  # where the short windows of the last one begin
    for power in reversed(range(capacity.bit_length())):
        if (total - whole * capacity) >> power & 1:
            ends.append(ends[-1] + (1 << power))
    spark, edges = rest.sparkSession, F.array(*map(F.lit, ends)).cast("array<long>")
    bases = spark.createDataFrame([(task, base) for (task, _), base in zip(sums, begins)], "task long, base long")
    own = rest.join(F.broadcast(bases), "task").withColumn("_from", F.col("base") + F.col("offset")).withColumn("_to", F.col("_from") + F.col("length"))
    next_edge = F.array((F.floor(F.col("_from") / capacity) + 1) * capacity)  # a piece is shorter than a window
    inner = F.filter(F.array_union(next_edge, edges), lambda x: (x > F.col("_from")) & (x < F.col("_to")))
    cuts = F.array_sort(F.concat(F.array("_from"), inner, F.array("_to")))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.struct(F.get(cuts, k - 1).alias("a"), F.get(cuts, k).alias("b")))
    cut = own.withColumn("_p", F.explode(parts)).withColumn("_a", F.col("_p.a")).withColumn("length", F.col("_p.b") - F.col("_a"))
    past = F.filter(edges, lambda x: x <= F.col("_a"))
    short = F.size(past) > 0
    skipped = (F.col("_a") - F.col("_from")).cast("int")
    return cut.select(
        "doc_id", (F.col("start") + skipped).alias("start"), "length", F.substring(F.col("ids"), 4 * skipped + 1, (4 * F.col("length")).cast("int")).alias("ids"), "doc_tokens",
        F.when(short, whole + F.size(past) - 1).otherwise(F.floor(F.col("_a") / capacity)).cast("long").alias("sequence_id"),
        F.when(short, F.col("_a") - F.array_max(past)).otherwise(F.pmod("_a", F.lit(capacity))).cast("long").alias("offset"),
    )


def pack_online(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, most_open: int = OPEN) -> DataFrame:
    """Packs the documents (doc_id, text, ...) into sequences of `capacity` tokens, all full but for those whose size is a power
    of two.

    Returns one row per piece: doc_id, start, length, ids (binary, 32 bits each), ids_crc32, doc_tokens, sequence_id, offset. A
    null text counts as empty and still has its end id. Repeated rows, also those that share an id or have none, are separate
    documents. Other columns are ignored. An empty table gives no rows. Which documents meet depends on how the table is cut
    into partitions; every id lies in one piece whatever the cut.
    """
    pieces = written(placed(docs, capacity, vocabulary(tokenizer), end_id, most_open), "windows")
    sequence = F.shiftleft(F.col("task") + 1, 33) + F.col("window")
    done = pieces.filter("window is not null").select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), "offset")
    found = done.unionByName(merged(pieces.filter("window is null"), capacity))
    return found.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
