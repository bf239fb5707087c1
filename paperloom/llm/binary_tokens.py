"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder of parts. ``part-K.ids`` holds the ids of the part's documents end to end as little-endian unsigned
integers (16 bits where the vocabulary fits, else 32); ``part-K.idx`` holds for each document four little-endian signed
64-bit integers: its id, its first token within the part, its tokens, and 1 if it has an id (0: null). Parts follow one another
in ascending document id; the manifest gives each part's first document and first token in the whole, from prefix sums over the
parts' counts. A reader maps both files into memory where the folder is a mounted one, and reads ranges of them elsewhere.

Texts are encoded where they are read, and only ids are shuffled, into ranges of document ids. Parts are written under names that no other attempt of a task
uses, and only those that finished tasks report are in the manifest, so a task that runs again leaves nothing wrong behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import encoder, vocabulary

PART_SCHEMA = "part int, name string, documents long, tokens long"


def _store(folder: str):
    """A file system that executors can reach, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """part, doc_id, ids (binary, width bytes each, the end id last) of every document (part, doc_id, text)."""
    path = vocabulary(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = [tokens.ids(text) + end for text in part.column(2).to_pylist()]
                joined, ends = np.frombuffer(b"".join(own), "<u4"), np.cumsum([0, *(len(x) // 4 for x in own)])
                if width == 2 and joined.max() > 0xFFFF:
                    raise ValueError("ids of this vocabulary need 32 bits")
                small = joined.astype(f"<u{width}").tobytes()
                ids = [small[a * width : b * width] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return docs.select("part", "doc_id", "text").mapInArrow(encode, "part int, doc_id long, ids binary")


def placed(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, text: parts are ranges of ascending ids with about as many rows each. The rows of an id that fills several
    ranges are dealt out over them by their text; null ids come first."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [k / parts for k in range(1, parts)]
    bounds = (own.agg(F.percentile_approx("doc_id", shares).alias("b")).first()["b"] if shares else None) or []  # parts - 1 numbers
    edges = F.array(*map(F.lit, bounds)).cast("array<long>")
    low, high = F.size(F.filter(edges, lambda b: b < F.col("doc_id"))), F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(low + F.pmod(F.xxhash64("text"), high - low + 1))
    return own.select(part.cast("int").alias("part"), "doc_id", "text")


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, parts: int | None = None) -> list[dict]:
    """Writes the data set in ascending doc_id and returns its manifest, in order: one small record per part."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, at = _store(folder)
        ids_file = index_file = None
        documents = total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_file is None:
                store.create_dir(at, recursive=True)
                ids_file, index_file = store.open_output_stream(f"{at}/{name}.ids"), store.open_output_stream(f"{at}/{name}.idx")
            own = batch.column(1).to_pylist()
            sizes = np.array([len(x) // width for x in own], np.int64)
            ids_file.write(b"".join(own))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = batch.column(0).fill_null(0).to_numpy()
            index_file.write(np.stack([numbers, total + np.cumsum(sizes) - sizes, sizes, known], 1).astype("<i8").tobytes())
            documents, total = documents + len(own), total + int(sizes.sum())
        if ids_file is not None:
            ids_file.close()
            index_file.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([documents]), pa.array([total])], names=["part", "name", "documents", "tokens"])

    rows = encoded(placed(docs, parts), tokenizer, end_id, width)
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("doc_id").select("doc_id", "ids")
    found = sorted(ordered.mapInArrow(write, PART_SCHEMA).collect(), key=lambda r: r["part"])  # a record per part
    firsts = zip(accumulate((r["documents"] for r in found), initial=0), accumulate((r["tokens"] for r in found), initial=0))
    return [r.asDict() | {"first_document": d, "first_token": t, "width": width} for r, (d, t) in zip(found, firsts)]


def _opened(store, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """A function that gives the numbers from one place to another of a file, which is mapped into memory if it's a local one."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        mapped = np.memmap(path, kind, mode="r")
        return lambda first, last: mapped[first:last]
    source, size = store.open_input_file(path), np.dtype(kind).itemsize
    return lambda first, last: np.frombuffer(source.read_at((last - first) * size, first * size), kind)


def read_ids(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and with_ids the ids (binary, 32 bits each)."""
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in batches:
            for part in (manifest[k] for k in batch.column(0).to_pylist()):
                index_of, ids_of = _opened(store, f"{at}/{part['name']}.idx", "<i8"), _opened(store, f"{at}/{part['name']}.ids", f"<u{part['width']}")
                for block in range(0, part["documents"], 1000):
                    rows = index_of(4 * block, 4 * min(block + 1000, part["documents"])).reshape(-1, 4)
                    first, last = int(rows[0, 1]), int(rows[-1, 1] + rows[-1, 2])
                    ids = ids_of(first, last).astype("<u4")
                    own = [ids[s - first : s - first + n].tobytes() for _, s, n, _ in rows.tolist()]
                    values = [pa.array(rows[:, 0], pa.int64(), mask=rows[:, 3] == 0), pa.array(rows[:, 1] + part["first_token"]), pa.array(rows[:, 2]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(values + [pa.array(own)] * with_ids, names=columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(read, schema)


def write_and_read(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Writes the ids of all documents (doc_id, text, ...) to the shared folder and returns what the files say.

    doc_id, start (tokens of all documents before it), n_tokens (with the end id), ids_crc32. A null text has the end id only.
    Rows that share a doc_id are separate documents, side by side in no fixed order. A null doc_id comes first. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/paperloom/ids-{uuid.uuid4().hex}"
    return read_ids(spark, folder, write_ids(docs, folder, tokenizer, end_id))
