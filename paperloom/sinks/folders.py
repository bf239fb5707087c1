"""A sink of text files: what a job writes appears when the whole job is done, or not at all.

Rows (path, place, glue, text) become files below a folder: a file's rows, in the order of their places, one after the other, with
`glue` between two that have it. A task goes through its sorted rows and holds none, so a file of any length is written by
one pass. Each attempt of a task writes below a folder of its own; when all tasks are done the driver moves what the finished
attempts wrote to its place, one move for each entry (the first `depth` parts of a path), which no other attempt can change. If
the job fails, the folder of the attempts goes, and nothing else was touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, place string, glue string, text string"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: its folder and the entries in it."""

    folder: str
    entries: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, depth: int, replace: bool):
        self.folder, self.depth, self.replace = folder.rstrip("/"), depth, replace
        self.staging = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = _store(self.folder)
        own, entries, file, name, glued = f"{at}/{self.staging}/{uuid.uuid4().hex}", {}, None, None, False
        try:
            for r in iterator:
                if r["path"] != name:
                    if file is not None:
                        file.close()
                    name, glued = r["path"], False
                    target = f"{own}/{name}"
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    file = store.open_output_stream(target)
                    entries["/".join(name.split("/")[: self.depth])] = None
                if r["glue"] is not None and glued:
                    file.write(r["glue"].encode())
                glued = r["glue"] is not None
                file.write((r["text"] or "").encode())
        finally:
            if file is not None:
                file.close()
        return Written(own, list(entries))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.folder)
        store.create_dir(at, recursive=True)
        moves = [(f"{m.folder}/{e}", f"{at}/{e}") for m in messages if m for e in m.entries]
        if not self.replace and (there := [to for _, to in moves if store.get_file_info(to).type != fs.FileType.NotFound]):
            self.abort(messages)
            raise ValueError(f"not empty: {there[0]}")
        for folder in sorted({to.rpartition("/")[0] for _, to in moves}):
            store.create_dir(folder, recursive=True)

        def move(pair: tuple[str, str]) -> None:
            source, to = pair
            kind = store.get_file_info(to).type
            if kind == fs.FileType.Directory:
                store.delete_dir(to)
            elif kind == fs.FileType.File:
                store.delete_file(to)
            store.move(source, to)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.folder)
        if store.get_file_info(f"{at}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.staging}")


class TextFolders(DataSource):
    """Format "text_folders". Options: path, depth (1), replace (false)."""

    @classmethod
    def name(cls) -> str:
        return "text_folders"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("depth", "1")), self.options.get("replace", "false") == "true")


def listed(folder: str) -> list[str]:
    """The entries of a folder, but for what attempts of a running or lost job have written."""
    from pyarrow import fs

    store, at = _store(folder)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if not i.base_name.startswith(("_attempts-", ".")))


#: Bytes of a block, a row that stands for rows of a long file that follow one another.
BLOCK_BYTES = 1 << 20


def _blocks(rows: DataFrame) -> DataFrame:
    """The same files from few rows: rows (path, place, glue, text) are sorted by ranges of path and place, and those of a range
    that follow one another become blocks, in many tasks. What is left to a file's task is to write its blocks down."""
    from ..tables import written

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, parts, size, number = None, None, [], 0, 0

        def block() -> pa.RecordBatch:
            values = [pa.array([path], pa.string()), pa.array([number], pa.int64()), pa.array([first], pa.string()), pa.array(["".join(parts)], pa.string())]
            return pa.RecordBatch.from_arrays(values, names=["path", "number", "glue", "text"])

        for batch in batches:
            for name, glue, text in zip(*(c.to_pylist() for c in batch.columns)):
                if path is not None and (name != path or (glue is None) != (first is None) or size >= BLOCK_BYTES):
                    yield block()
                    path, parts, size, number = None, [], 0, number + 1
                if path is None:
                    path, first = name, glue
                else:
                    parts.append(glue or "")
                parts.append(text or "")
                size += len(parts[-1])
        if path is not None:
            yield block()

    own = written(rows.select("path", "place", "glue", "text"), "lines")  # the ranges are taken from what is written
    sorted_rows = own.repartitionByRange("path", "place").sortWithinPartitions("path", "place").select("path", "glue", "text")
    joined = sorted_rows.mapInArrow(join, "path string, number long, glue string, text string")
    return joined.select("path", F.struct(F.spark_partition_id().alias("range"), "number").alias("place"), "glue", "text")


def write_files(rows: DataFrame, folder: str, depth: int = 1, replace: bool = False, long: bool = False) -> None:
    """Writes rows (path, place, text, and glue or none) as files; the rows of an entry are one task's. Files that are there
    already are an error unless `replace` is set, in which case an entry is replaced as a whole. long: few files of very many
    rows each, whose rows are put together by other tasks before."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(TextFolders)
    glue = F.col("glue") if "glue" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("glue", glue)
    own = (_blocks(rows) if long else rows).select("path", "place", "glue", "text", F.substring_index("path", "/", depth).alias("_entry"))
    dealt = own.repartition("_entry").sortWithinPartitions("path", "place").select("path", F.lit("").alias("place"), "glue", "text")
    dealt.write.format("text_folders").option("path", folder).option("depth", str(depth)).option("replace", str(replace).lower()).mode("append").save()
