"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of the word notions that the operators use (Java syntax).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, a local session) a folder of this machine
    is made once and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows that a file of a written table has at least, where their number is known to be small.
ROWS_A_FILE = 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a parquet table in the shared folder: cuts the lineage, and survives the loss of any executor. rows: as many as it
    has at most, if that is known; a table of few rows gets few files, however many partitions a shuffle has."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    for paths in _WRITTEN:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written inside each open scratch().
_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end the tables written inside, but for those that the given function writes. A frame that still has to
    be computed from them must be written by it first."""
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.append(_WRITTEN[-1][-1])
        return out

    _WRITTEN.append([])
    try:
        yield keep
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in set(_WRITTEN.pop()) - set(kept):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


#: How a Python worker's caches are emptied, by who uses them.
_CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, clear: Callable[[], None]) -> None:
    _CACHES[owner] = clear


def use_caches_of(owner: str) -> None:
    """Called where a task begins: workers are used again, and only one owner's caches stay in memory."""
    for other, clear in _CACHES.items():
        if other != owner:
            clear()
    give_back()


def give_back() -> None:
    """Returns to the system what a worker has freed; it would stay the worker's, which outlives its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def keep_freed() -> None:
    """Called where a task begins that makes and frees arrays of some MB all the time: a worker then keeps up to 62 MB of what it
    frees, until give_back(), and doesn't ask the system for each page again and again. glibc gives a block that is larger than
    any freed so far a mapping of its own, up to 32 MB, and keeps twice as much as the largest freed one."""
    np.empty(31 << 20, np.uint8)  # freed at once; no page of it is touched


class WordHashes(dict):
    """64-bit hashes of words (never 0), kept for those seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word) or 1
        return got


WORD_HASHES = WordHashes()
keep_cache("hashes", WORD_HASHES.clear)
