"""Files and converted packs as tables."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators.chunking import html_outline
from . import office

CHUNK_SCHEMA = (
    "chunk_id string, evidence_type string, heading_path array<string>, text string, char_count int, locator string, provenance_status string, "
    "doc_id string, source_file string, source_path string, document_kind string, quality_status string, page_number int, slide_number int, "
    "slide_numbers array<int>, sheet_name string, table_name string, section_number string, section_title string, topic_label string, "
    "batch_id string, confidence string, group_path string, row_number int"
)
MANIFEST_SCHEMA = "source_file string, source_path string, checksum string, engine string, status string, document_kind string, quality_status string, extraction_status string"
KNOWLEDGE_SCHEMA = "title string, document_kind string, quality_status string, extraction_status string, tags array<string>"


def supported(name: Column) -> Column:
    """Whether a file name is of a kind that can be read: no hidden file, no lock file of an office program."""
    return T.extension(name).isin(*R.SUPPORTED) & ~name.startswith(".") & ~name.startswith("~$")


def hidden(relative: Column) -> Column:
    return F.exists(F.split(relative, "/"), lambda p: p.startswith("."))


def scan(spark: SparkSession, folder: str, recursive: bool = True, include_hidden: bool = False) -> DataFrame:
    """path, relative_path, name, extension, size, modified, content of the files below a folder; a missing folder raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    relative = F.regexp_replace(F.replace(F.col("path"), F.lit(folder.rstrip("/") + "/"), F.lit("")), r"^file:/*", "")
    own = found.select("path", relative.alias("relative_path"), T.file_name("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    own = own.withColumn("extension", T.extension(F.col("name")))
    return own if include_hidden else own.filter(~hidden(F.col("relative_path")))


def in_order(files: DataFrame) -> DataFrame:
    """Adds doc_ord, the place by lower-cased path, which later rules of "the first wins" go by. Ranges of paths are sorted
    apart and numbered by the counts of the ranges before."""
    from pyspark.sql import Window

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = files.withColumn("_o", F.lower("path")).repartitionByRange(parts, "_o", "path").withColumn("_p", F.spark_partition_id())
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "path")))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c"))  # a row a partition
    return own.join(F.broadcast(counts.select("_p", "_b")), "_p").withColumn("doc_ord", F.col("_n") + F.col("_b")).drop("_o", "_p", "_n", "_b")


def filter_globs(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files whose name or relative path any include pattern fits (all, without one) and no exclude pattern does."""

    def fits(patterns: list[str]) -> Column:
        regex = "|".join(re.sub(r"^\(\?s:|\)\\[zZ]$", "", fnmatch.translate(p)) for p in patterns)
        return F.col("name").rlike(f"(?s)^(?:{regex})$") | F.col("relative_path").rlike(f"(?s)^(?:{regex})$")

    if include:
        files = files.filter(fits(include))
    return files.filter(~fits(exclude)) if exclude else files


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first so many by path: a limit that the caller asks for."""
    return files.orderBy(F.lower("path"), "path").limit(most)


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", T.checksum(F.col("content")))


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement of what isn't."""
    return F.decode(content, "UTF-8")


def _office_text(content: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        wanted = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml"}[kind]
        out = []
        for n in names:
            if re.fullmatch(wanted, n):
                xml = z.read(n).decode("utf-8", "replace")
                if kind == "pptx":
                    out.append(f"<!-- Slide number: {re.search(r'(\d+)', n)[1]} -->")
                marked = re.sub(r"</(?:w:p|a:p|row|si)>", "\n", xml)
                out.append(re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", marked)).strip())
        return "\n".join(out)


def _unknown(content: bytes, kind: str) -> str:
    raise NotImplementedError(f"no reader for {kind}")


#: Readers by name; callers add their own. Text and HTML are read by Spark itself.
READERS: dict[str, Callable[[bytes, str], str]] = {"office": _office_text, "layout": _unknown, "marker": _unknown}


def convert(files: DataFrame, reader: str = "office") -> DataFrame:
    """path, markdown, engine, warnings, error for files (path, extension, content).

    Text kinds are decoded and HTML is outlined in the JVM, office files become Markdown by joins over their parts (office.py);
    others, or all if another reader is named, go through a reader in Python. What fails is an error row and no exception."""
    simple = files.filter(F.col("extension").isin("txt", "md", "csv", "json", "html", "htm"))
    text = decode_text(F.col("content"))
    none = F.lit(None).cast("string")
    read = simple.select("path", F.when(F.col("extension").isin("html", "htm"), html_outline(text)).otherwise(text).alias("markdown"), F.lit("text").alias("engine"), F.array(F.lit("plain text fallback")).alias("warnings"), none.alias("error"))
    chosen = READERS[reader]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["extension"], batch["content"]):
                try:
                    rows.append((path, chosen(bytes(content), kind), reader, [], None))
                except Exception as error:  # a file that can't be read is a row, not the end of the job
                    rows.append((path, None, reader, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "engine", "warnings", "error"])

    others = files.filter(~F.col("extension").isin("txt", "md", "csv", "json", "html", "htm")).select("path", "extension", "content")
    if reader == "office":
        parts = office.markdown(others).select("path", "markdown", F.lit("office").alias("engine"), F.when(F.col("media") > 0, F.array(F.concat(F.col("media").cast("string"), F.lit(" embedded media")))).otherwise(F.array().cast("array<string>")).alias("warnings"), "error")
        read, others = read.unionByName(parts), others.filter(~F.col("extension").isin(*office.KINDS))
    return read.unionByName(others.mapInPandas(run, "path string, markdown string, engine string, warnings array<string>, error string"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first reader's result, else the second's, marked as such."""
    a, b = first.alias("a"), second.alias("b")
    failed = F.col("a.error").isNotNull()
    both = a.join(b, "path", "left")
    pick = lambda c: F.when(failed, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    warned = F.when(failed, F.array_append(F.col("b.warnings"), F.concat(F.lit("fallback after "), F.col("a.error")))).otherwise(F.col("a.warnings"))
    return both.select("path", pick("markdown"), pick("engine"), warned.alias("warnings"), pick("error"), failed.alias("fallback_used"))


def embedded_media(content: bytes) -> int:
    """How many media files an office file holds; 0 for a broken one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return sum(n.startswith(("word/media/", "ppt/media/")) for n in z.namelist())
    except zipfile.BadZipFile:
        return 0


def core_properties(xml: Column) -> Column:
    """Title, creator and subject from the text of docProps/core.xml; null where there is none."""
    return F.struct(*[T.blank_to_null(F.regexp_extract(xml, rf"<dc:{n}>([^<]*)</dc:{n}>", 1)).alias(n) for n in ("title", "creator", "subject")])


#: What is quoted in the path of a URI, as Spark does in a file's path.
_QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@\u00a1-\U0010FFFF]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of texts that a task hands on at once.
_BATCH_BYTES = 4 << 20


def _entries(store, folder: str, pattern: str) -> tuple[list[str], list[str]]:
    """The folders and the files like the pattern in a folder, but for what Spark's readers leave out too."""
    from pyarrow import fs

    hidden = lambda name: name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    found = [i for i in store.get_file_info(fs.FileSelector(folder)) if not hidden(i.base_name)]
    return [i.path for i in found if i.type == fs.FileType.Directory], [i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern)]


def _read_text(store, path: str, lines: bool) -> Iterator[bytes]:
    """A file's lines, or its whole text."""
    with store.open_input_stream(path) as file:
        if not lines:
            yield file.read()
            return
        for k, line in enumerate(io.TextIOWrapper(file, "latin-1")):  # bytes as they are; CR, LF and CR LF end a line
            own = line.removesuffix("\n").encode("latin-1")
            yield own.removeprefix(b"\xef\xbb\xbf") if k == 0 else own


def _texts_below(spark: SparkSession, folder: str, pattern: str, lines: bool) -> DataFrame | None:
    """value, _file: the texts, or the lines, of the files below a folder whose names are like the pattern. Tasks list the folder,
    go through its entries and read their files, so the driver gets no list of files; a file is read by one task. None where
    that can't be done: the folder is a pattern, a file or missing, or its store is one that only Spark can read."""
    from pyarrow import fs

    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    own = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if re.search(r"[*?\[{]", folder) or not own.exists(at) or not own.getFileStatus(at).isDirectory():
        return None
    uri = own.makeQualified(at).toUri()
    authority, uri_path = uri.getAuthority() or "", uri.getPath()
    scheme, whole = f"{uri.getScheme()}:" + (f"//{authority}" if authority else ""), f"{uri.getScheme()}://{authority}{quote(uri_path)}"
    try:
        fs.FileSystem.from_uri(whole)
    except (pa.ArrowException, OSError):
        return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(whole)
        for _ in batches:  # one row
            folders, found = _entries(store, root, pattern)
            for paths, is_folder in ((folders, True), (found, False)):
                for k in range(0, len(paths), 10_000):
                    part = paths[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([is_folder] * len(part))], names=["path", "is_folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(whole)
        above = f"{scheme}{uri_path[: len(uri_path) - len(root)]}" if uri_path.endswith(root) else scheme
        values, places, size = [], [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(places, pa.string())], names=["value", "_file"])

        for batch in batches:
            for path, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folders, found = ([path], []) if is_folder else ([], [path])
                while folders or found:
                    if not found:
                        more, found = _entries(store, folders.pop(), pattern)
                        folders += more
                        continue
                    path = found.pop()
                    name = above + _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)
                    for value in _read_text(store, path, lines):
                        values.append(value)
                        places.append(name)
                        size += len(value) + len(name)
                        if size >= _BATCH_BYTES:
                            yield batch_of()
                            values, places, size = [], [], 0
        yield batch_of()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = spark.range(0, 1, 1, 1).mapInArrow(listed, "path string, is_folder boolean").repartition(parts, "path")
    return entries.mapInArrow(read, "value binary, _file string").select(F.col("value").cast("string").alias("value"), "_file")


def read_json_tolerant(spark: SparkSession, path: str, schema: str, lines: bool = False, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings): what can't be read is a warning with its file."""
    found = _texts_below(spark, path, pattern, lines) if pattern else None
    if found is None:
        reader = spark.read.option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        found = reader.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("_file"))
    found = found.filter(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    own = found.withColumn("j", parsed).withColumn("doc_dir", F.regexp_replace("_file", "/[^/]*$", ""))
    bad = own.filter("j._bad is not null").select(F.concat(F.col("_file"), F.lit(": can't be read")).alias("warning"))
    return own.filter("j._bad is null").select("j.*", "doc_dir").drop("_bad"), bad


def read_packs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """manifests (those that failed left out), chunks and warnings of the packs below a folder."""
    manifests, bad = read_json_tolerant(spark, folder, MANIFEST_SCHEMA, pattern="manifest.json")
    chunks, bad_chunks = read_json_tolerant(spark, folder, CHUNK_SCHEMA, lines=True, pattern="chunks.jsonl")
    skipped = manifests.filter("status = 'failed'").select(F.concat(F.col("doc_dir"), F.lit(": failed conversion is left out")).alias("warning"))
    good = manifests.filter("coalesce(status, '') != 'failed'")
    return {"manifests": good, "chunks": chunks.join(good.select("doc_dir"), "doc_dir", "left_semi"), "warnings": bad.unionByName(bad_chunks).unionByName(skipped)}


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, digest: the MD5 of each of these files, which is read piece by piece and may be longer than a value can be."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as file:
                    found = hashlib.file_digest(file, "md5").hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array([at.rpartition("/")[2]]), pa.array([found])], names=["name", "digest"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return rows.mapInArrow(digest, "name string, digest string")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the engine, or an empty one where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
