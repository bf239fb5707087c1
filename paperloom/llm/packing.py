"""Best-fit packing of token sequences, planned on the histogram of lengths.

Only the number of pieces of each length matters for a packing, so the plan is made on the driver from at most `capacity`
counts, whatever the size of the corpus. Pieces longer than a third of the capacity are large: at most two of them share a
sequence, and greedy matching pairs each, from the longest down, with the longest that still fits. The others go, from the
longest down, each into the tightest gap that takes it. The plan says, for each length, which ranks go to which sequences; a
piece finds its place by its rank among the pieces of its length. Pieces keep their token ids all the way, so a sequence is
its pieces' ids in the order of their offsets.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written
from .tokens import encoder, vocabulary

#: Documents that are encoded at once.
ROWS = 1000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces per sequence, first sequence, offset of the first) for each run.

    Rank r of the run goes to sequence ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    rank, runs, sequences = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[list[int]]] = {}  # gap: [first sequence, count] of the sequences that have it
    sizes: list[int] = []  # the gaps there are, ascending

    def put(n: int, pieces: int, per: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], rank[n] + pieces, per, first, offset))
        rank[n] += pieces
        left[n] -= pieces

    def open_gap(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append([first, count])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                count = left[n]
                put(n, count, 1, sequences, 0)
                open_gap(capacity - n, sequences, count)
            elif mate == n:
                count = left[n] // 2
                put(n, 2 * count, 2, sequences, 0)
                open_gap(capacity - 2 * n, sequences, count)
            else:
                count = min(left[n], left[mate])
                put(n, count, 1, sequences, 0)
                put(mate, count, 1, sequences, n)
                open_gap(capacity - n - mate, sequences, count)
            sequences += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # no gap takes it: new sequences
                per = capacity // n
                count = max(1, left[n] // per)
                open_gap(capacity, sequences, count)
                sequences += count
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            per = min(gap // n, left[n])
            full = min(count, left[n] // per)
            put(n, full * per, per, first, capacity - gap)
            open_gap(gap - per * n, first, full)
            open_gap(gap, first + full, count - full)
    return runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer one all but the first have the full capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """Each document's ids and the end id (little-endian, 32 bits each), in pieces of at most `capacity`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.ids(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(rows, (doc_id, k, start, length, ids[4 * start : 4 * (start + length)])):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids"])
        give_back()  # what follows runs in the JVM, beside workers that wait

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECE_SCHEMA)


def place(pieces: DataFrame, capacity: int, rows_per_group: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), which are read several times.

    Ranks within a length are taken in salted groups of about rows_per_group rows, so that no length, however common, is
    numbered in one task; the groups' counts are summed into the ranks of their first rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan({n: c for n, c in counts.items() if n < capacity}, capacity)
    sequences = max((f + -(-(b - a) // per) for _, a, b, per, f, _ in runs), default=0)
    salts = max(8, math.ceil(max(counts.values(), default=0) / rows_per_group))
    full = (
        pieces.filter(F.col("length") == capacity)
        .withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(sequences))
        .withColumn("offset", F.lit(0).cast("long"))
    )
    if not runs:
        return full
    by_length: dict[int, list] = {}
    for n, a, b, per, first, offset in runs:
        by_length.setdefault(n, []).append((a, b, per, first, offset))
    planned = spark.createDataFrame(
        list(by_length.items()), "length long, runs array<struct<a: long, b: long, per: long, first: long, at: long>>"
    )
    salted = pieces.filter(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    local = salted.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    base = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    rank = F.col("_local") + F.col("_base")
    run = F.get(F.filter("runs", lambda x: (F.col("_rank") >= x["a"]) & (F.col("_rank") < x["b"])), F.lit(0))
    past = F.col("_rank") - F.col("_run.a")
    partial = (
        local.join(base, ["length", "_salt"])
        .withColumn("_rank", rank)
        .join(F.broadcast(planned), "length")  # one row for each length below the capacity: bounded by the capacity
        .withColumn("_run", run)
        .withColumn("sequence_id", F.col("_run.first") + F.floor(past / F.col("_run.per")).cast("long"))
        .withColumn("offset", F.col("_run.at") + F.pmod(past, F.col("_run.per")) * F.col("length"))
    )
    return partial.select(full.columns).unionByName(full)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Packs the documents (doc_id, text, ...) into few sequences of at most `capacity` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids (binary, 32 bits each), ids_crc32, sequence_id, offset. A null text counts as empty and
    still has its end id. Repeated rows are separate documents. Other columns are ignored. An empty table gives no rows.
    """
    pieces = written(tokenized_pieces(docs, capacity, vocabulary(tokenizer), end_id), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary, 32 bits each) of what pack() returns: a sequence's pieces one after the other."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    join = F.aggregate("pieces", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return own.select("sequence_id", "n_tokens", join.alias("ids"))
