"""Batch workflows: conversion, library build and update, workspaces, catalogs and tools."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sinks.exports import write_library
from . import changes, index, search
from .library import Library

VERSION_SCHEMA = "library_version_id string, registered_at string, library_path string, source_root string, source_hash string, label string, notes string, documents long, chunks long, source_dirty boolean, warnings array<string>"
OUTPUT_SCHEMA = "output_version_id string, registered_at string, output_path string, output_type string, library_version_id string, file_count long, total_size_bytes long, folder_sha256 string"
CATALOG_SCHEMA = "library_id string, library_name string, library_path string, source_root string, registered_at string"
REVIEW_SOURCES, REVIEW_PENDING = 500, 100


def now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from ..sources.files import read_table

    return read_table(spark, path, schema)


def _append(spark: SparkSession, path: str, schema: str, record: dict) -> dict:
    spark.createDataFrame([record], schema).write.mode("append").parquet(path)
    return record


def init_workspace(spark: SparkSession, path: str) -> dict[str, int]:
    """The numbers of records that are there; what exists is never touched."""
    return {name: _rows(spark, f"{path}/{name}", schema).count() for name, schema in (("library_versions", VERSION_SCHEMA), ("output_versions", OUTPUT_SCHEMA), ("catalog", CATALOG_SCHEMA))}


def register_library(spark: SparkSession, path: str, library_path: str, source_root: str, source_hash: str, documents: int, chunks: int, dirty: bool, allow_dirty: bool = False, label: str | None = None, notes: str | None = None) -> dict:
    """Appends a version; sources that changed since the scan are refused unless allowed, then noted."""
    if dirty and not allow_dirty:
        raise ValueError("sources have changed since they were scanned")
    warnings = ["sources had changed when the version was registered"] if dirty else []
    record = {
        "library_version_id": f"lib-{uuid.uuid4().hex[:12]}", "registered_at": now(), "library_path": library_path, "source_root": source_root, "source_hash": source_hash,
        "label": label, "notes": notes, "documents": documents, "chunks": chunks, "source_dirty": dirty, "warnings": warnings,
    }
    return _append(spark, f"{path}/library_versions", VERSION_SCHEMA, record)


def register_output(spark: SparkSession, path: str, output_path: str, output_type: str, library_version_id: str | None = None, allow_missing: bool = False, **measures: object) -> tuple[dict, list[str]]:
    """Appends an output, linked to the library version asked for, however old, or else to the latest."""
    rows = _rows(spark, f"{path}/library_versions", VERSION_SCHEMA)
    wanted = rows.filter(F.col("library_version_id") == library_version_id) if library_version_id else rows.orderBy(F.desc("registered_at"), "library_version_id").limit(2)
    versions = [r.asDict() for r in wanted.collect()]  # two rows at most
    linked, warnings = changes.linked_version(versions, library_version_id, allow_missing)
    record = {
        "output_version_id": f"out-{uuid.uuid4().hex[:12]}", "registered_at": now(), "output_path": output_path, "output_type": output_type,
        "library_version_id": linked and linked["library_version_id"], "file_count": measures.get("file_count"), "total_size_bytes": measures.get("total_size_bytes"), "folder_sha256": measures.get("folder_sha256"),
    }
    return _append(spark, f"{path}/output_versions", OUTPUT_SCHEMA, record), warnings


def workspace_status(spark: SparkSession, path: str) -> dict:
    """Numbers of versions and the latest of each."""
    out = {}
    for name, schema in (("library_versions", VERSION_SCHEMA), ("output_versions", OUTPUT_SCHEMA)):
        rows = _rows(spark, f"{path}/{name}", schema)
        last = rows.orderBy(F.desc("registered_at")).limit(1).collect()
        out[name] = {"count": rows.count(), "latest": last[0].asDict() if last else None}
    return out


def add_to_catalog(spark: SparkSession, path: str, library_id: str, library_name: str, library_path: str, source_root: str | None = None) -> DataFrame:
    """The catalog with the library in it, replacing one of the same id, sorted by id; written as a new version."""
    new = spark.createDataFrame([(library_id, library_name, library_path, source_root, now())], CATALOG_SCHEMA)
    rows = changes.upsert(read_catalog(spark, path), new, "library_id").orderBy("library_id").collect()  # a row for each library
    spark.createDataFrame(rows, CATALOG_SCHEMA).coalesce(1).write.parquet(f"{path}/catalog/version={datetime.now(UTC):%Y%m%d%H%M%S%f}")
    return read_catalog(spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    found = _rows(spark, f"{path}/catalog", CATALOG_SCHEMA + ", version string")
    last = found.agg(F.max("version").alias("v")).scalar()
    return found.filter(F.col("version") == last).drop("version")


def build_library(library: Library, folder: str) -> str:
    """Writes the library and its search index into a fresh folder below `folder` and returns it: readers of an older one aren't disturbed, and a
    build that fails leaves nothing that is read. The table of chunks comes from the index's rows, which hold them whole, so
    that chunks are made once."""
    target = f"{folder}/build-{datetime.now(UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
    rows = search.search_rows(library.chunks, library.documents) if library.rows is None else search.search_rows(library.rows)
    own = index.write_index(rows, target, dealt=True)
    if library.rows is not None and not set(index.OWN) & set(library.chunks.columns):
        library = replace(library, chunks=own.rows.select(library.chunks.columns))
    write_library(library, target)
    return target


#: The records' schema versions and what they say of themselves.
STATE_VERSION, REVIEW_VERSION = "library_state.v1", "kb_review.v1"
REVIEW_LIMITS = ["kb-review is read-only and never runs update-library execution", "review uses source_root from the library catalog when available"]
STATE_LIMITS = ["library_state.json is a status snapshot, not an update operation", "agents must refresh status/scan before relying on old state snapshots"]
NO_ROOT = "catalog record has no source_root; update review is limited to library-status"
REGISTRY_SCHEMA = "path string, size long, mtime long, sha256 string, status string"


def save_record(spark: SparkSession, path: str, record: dict) -> dict:
    """A JSON record as the newest version below path; older ones stay."""
    text = json.dumps(record, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/version={datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}")
    return record


def load_record(spark: SparkSession, path: str, default: dict | None = None) -> dict | None:
    """The newest version of a record; the default where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
        found = rows.orderBy(F.desc("file")).limit(1).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = []
    return json.loads(found[0]["value"]) if found else default


def save_registry(registry: DataFrame, folder: str) -> str:
    """The sources of a library, as its newest registry."""
    target = f"{folder}/source_registry/version={datetime.now(UTC):%Y%m%d%H%M%S%f}"
    registry.select([f.split()[0] for f in REGISTRY_SCHEMA.split(", ")]).write.parquet(target)
    return target


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The newest registry of a library, or none's: no rows."""
    found = _rows(spark, f"{folder}/source_registry", REGISTRY_SCHEMA + ", version string")
    return found.filter(F.col("version") == found.agg(F.max("version").alias("v")).scalar()).drop("version")


def library_state(spark: SparkSession, folder: str, plan: dict[str, int] | None = None) -> dict:
    """What is known of a library: its registered sources, the plan's changes, the status that follows."""
    registry = load_registry(spark, folder)
    counts = {r["status"]: r["count"] for r in registry.groupBy("status").count().collect()}  # two statuses
    total, missing = sum(counts.values()), counts.get("missing", 0)
    before = load_record(spark, f"{folder}/library_state", {})
    status = changes.library_status(missing if total else None, plan, before.get("status"))
    return {
        "schema_version": STATE_VERSION, "generated_at": now(), "library_path": folder, "status": status, "pending_changes": plan,
        "counts": {"registered_sources": total, "current_sources": total - missing, "stale_sources": missing, "missing_sources": missing}, "limitations": STATE_LIMITS,
    }


def save_state(spark: SparkSession, folder: str, plan: dict[str, int] | None = None) -> dict:
    return save_record(spark, f"{folder}/library_state", library_state(spark, folder, plan))


def kb_review(spark: SparkSession, path: str, library_id: str, scan: Callable[[str], DataFrame] | None = None) -> dict:
    """What an update of a catalogued library would do; nothing is written or converted. scan: the files of a source root now
    (path, size, mtime, sha256)."""
    found = read_catalog(spark, path).filter(F.col("library_id") == library_id).collect()  # one row
    if not found:
        raise ValueError(f"unknown library: {library_id}")
    library, plan, warnings, next_steps = found[0].asDict(), None, [], []
    if library["source_root"] and scan:
        registry = load_registry(spark, library["library_path"]).withColumn("manifest_there", F.col("status") != "missing")
        rows = changes.change_plan(scan(library["source_root"]), registry)
        plan = {s: 0 for s in changes.STATUSES} | {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}  # seven statuses
        warnings += changes.plan_warnings(plan)
    elif not library["source_root"]:
        warnings.append(NO_ROOT)
        next_steps.append("Register source_root in the library catalog to enable scan-based review.")
    pending = sum((plan or {}).get(s, 0) for s in ("new", "modified"))
    review = None if plan is None else {"pending": pending, "total": sum(plan.values()), "large": pending >= REVIEW_PENDING or sum(plan.values()) >= REVIEW_SOURCES}
    return {
        "schema_version": REVIEW_VERSION, "generated_at": now(), "request": {"catalog_path": path, "library_id": library_id}, "library": library,
        "library_status": library_state(spark, library["library_path"], plan), "review_summary": review, "change_counts": plan,
        "latest_update_result": load_record(spark, f"{library['library_path']}/update_result"), "warnings": warnings, "next_steps": next_steps, "limitations": REVIEW_LIMITS,
    }


def update_library(spark: SparkSession, plan: DataFrame, convert: Callable[[DataFrame], DataFrame], rebuild: Callable[[DataFrame], Library], folder: str, reusable: DataFrame, dry_run: bool = True, registry: DataFrame | None = None) -> dict:
    """Plan, convert what is new or modified, rebuild from that and the packs that can be used again; then the registry, the
    state and the result are written.

    A dry run writes nothing. Any failed conversion, and any pack that is refused, stops the rebuild. What was converted is a
    written table, so no file is converted twice."""
    counts = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}  # seven statuses
    pending = counts.get("new", 0) + counts.get("modified", 0)
    result = {"dry_run": dry_run, "counts": counts, "warnings": changes.plan_warnings(counts), "pending": pending, "status": "planned", "library": None}
    if sum(counts.values()) >= REVIEW_SOURCES or pending >= REVIEW_PENDING:
        result["warnings"].append("large update; review the plan first")
    if dry_run:
        return result
    converted = f"{folder}/converted-{uuid.uuid4().hex}"
    convert(plan.filter(F.col("status").isin("new", "modified"))).write.parquet(converted)
    done = spark.read.parquet(converted)
    failed = done.filter("error is not null").count()
    if failed:
        return save_record(spark, f"{folder}/update_result", result | {"status": "conversion_failed", "failed": failed})
    unsafe = changes.reuse_refusal(reusable).filter("refusal is not null").count()
    if unsafe:
        return save_record(spark, f"{folder}/update_result", result | {"status": "reuse_refused", "unsafe": unsafe})
    result |= {"status": "updated", "library": build_library(rebuild(done), folder)}
    if registry is not None:
        save_registry(registry, folder)
    save_state(spark, folder)
    return save_record(spark, f"{folder}/update_result", result)


def artifact_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path, exists, size_bytes, status (written, empty, missing)."""
    from pyarrow import fs

    rows = []
    for name, path in sorted(paths.items()):
        store, at = fs.FileSystem.from_uri(path)
        info = store.get_file_info(at)
        there = info.type != fs.FileType.NotFound
        size = int(info.size or 0) if info.type == fs.FileType.File else sum(i.size or 0 for i in store.get_file_info(fs.FileSelector(at, recursive=True))) if there else 0
        rows.append((name, path, there, size, "written" if size else "empty" if there else "missing"))
    return spark.createDataFrame(rows, "name string, path string, exists boolean, size_bytes long, status string")


#: What marks a folder as an output of some type, the first that fits.
OUTPUT_MARKS = [("library", "library_manifest.json"), ("vault", "vault_manifest.json"), ("packs", "_index.json"), ("vault", ".obsidian")]


def output_type(names: list[str]) -> str:
    return next((kind for kind, mark in OUTPUT_MARKS if mark in names), "folder")


def failure_manifests(files: DataFrame, results: DataFrame) -> DataFrame:
    """A manifest of 17 fields for every file (path, sha256), and its text; failed ones have the error and no text. results: path,
    markdown, engine, warnings, error and whichever of the other fields there are."""
    joined = files.select("path", "sha256").join(results, "path", "left")
    status = F.when(F.col("error").isNull() & F.col("markdown").isNotNull(), F.lit("success")).otherwise(F.lit("failed"))

    def given(name: str, default: object) -> Column:
        return (F.coalesce(F.col(name), F.lit(default)) if name in results.columns else F.lit(default)).alias(name)

    return joined.select(
        T.file_name(F.col("path")).alias("source_file"), F.col("path").alias("source_path"), F.col("sha256").alias("checksum"), T.extension(F.col("path")).alias("file_type"), "engine",
        given("fallback_used", False), given("ocr_used", False), given("quality_status", "ok"), given("document_kind", "document"), given("asset_count", 0), given("ai_used", False),
        given("extraction_status", "text"), given("requires_ocr_or_vision", False), F.current_timestamp().alias("converted_at"), status.alias("status"), "warnings",
        F.array_compact(F.array("error")).alias("errors"), F.coalesce("markdown", F.lit("")).alias("markdown"),
    )


def output_index(manifests: DataFrame, knowledge: DataFrame, vault: bool = False) -> DataFrame:
    """One JSON text and one Markdown line for each converted document. knowledge: source_path, title (the folder's name) and
    whichever of tags, chunks_count, assets_count there are. vault: links as a vault writes them."""
    own = manifests.join(knowledge, "source_path", "left")
    count = lambda name: (F.coalesce(F.col(name), F.lit(0)) if name in knowledge.columns else F.lit(0)).cast("long").alias(name)
    tags = F.coalesce("tags", F.array()) if "tags" in knowledge.columns else F.array().cast("array<string>")
    title = F.coalesce("title", "source_path")
    document = F.concat(title, F.lit("/document.md"))
    kept = F.struct(title.alias("title"), document.alias("document"), "source_file", "document_kind", "quality_status", tags.alias("tags"), count("chunks_count"), count("assets_count"))
    label = F.coalesce("source_file", title)
    link = F.concat(F.lit("[["), document, F.lit("|"), label, F.lit("]]")) if vault else F.concat(F.lit("["), label, F.lit("]("), document, F.lit(")"))
    cells = [link, F.col("document_kind"), F.col("quality_status"), F.array_join(tags, ", "), count("chunks_count").cast("string"), count("assets_count").cast("string")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return own.select("source_path", "status", F.to_json(kept).alias("json"), line.alias("markdown"))


def run_tool(files: DataFrame, commands: dict[str, list[str]], timeout: int = 60) -> DataFrame:
    """Runs read-only commands on each file (path, content) and says how it went: path, command, status (ok, failed, timeout,
    missing), seconds. The file is a copy of its own, so the source can't change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tempfile
        import time

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                with tempfile.NamedTemporaryFile(suffix="-" + path.rpartition("/")[2]) as f:
                    f.write(bytes(content))
                    f.flush()
                    for name, command in commands.items():
                        began = time.time()
                        if shutil.which(command[0]) is None:
                            status = "missing"
                        else:
                            try:
                                done = subprocess.run([*command, f.name], capture_output=True, timeout=timeout)
                                status = "failed" if done.returncode else "ok"
                            except subprocess.TimeoutExpired:
                                status = "timeout"
                        rows.append((path, name, status, time.time() - began))
            yield pd.DataFrame(rows, columns=["path", "command", "status", "seconds"])

    return files.select("path", "content").mapInPandas(run, "path string, command string, status string, seconds double")


def legacy_conversion(files: DataFrame, program: str = "soffice", timeout: int = 60) -> DataFrame:
    """path, content, error: old office files as new ones by an office program, where it is installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tempfile
        from pathlib import Path

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                if shutil.which(program) is None:
                    rows.append((path, None, f"{program} is not installed"))
                    continue
                with tempfile.TemporaryDirectory() as folder:
                    source = Path(folder, path.rpartition("/")[2])
                    source.write_bytes(bytes(content))
                    target = source.with_suffix(source.suffix + "x")
                    try:
                        subprocess.run([program, "--headless", "--convert-to", target.suffix[1:], "--outdir", folder, str(source)], capture_output=True, timeout=timeout, check=True)
                        rows.append((path, target.read_bytes(), None))
                    except (OSError, subprocess.SubprocessError) as error:
                        rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


#: The optional libraries that each part of the engine uses.
PARTS = {"all": ("fitz", "docx", "openpyxl", "yaml"), "layout": ("docling",), "enrichment": ("openai", "requests")}


def doctor(part: str = "all") -> dict[str, str]:
    """What optional parts are there."""
    import importlib.util

    out = {"python": sys.version.split()[0]}
    for name in PARTS[part]:
        out[name] = "installed" if importlib.util.find_spec(name) else "missing"
    for program in ("soffice",):
        out[program] = "installed" if shutil.which(program) else "missing"
    return out
