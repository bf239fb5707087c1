"""Counts, distributions and quality reports over a library."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..tables import written

LOCATED = "coalesce(locator, '') != ''"


def distribution(rows: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """value, count; empty values are left out; with an order column, equal counts come as first seen."""
    own = rows.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).cast("string").alias("value"))
    if order is None:
        return own.agg(F.count("*").alias("count"))
    return own.agg(F.count("*").alias("count"), F.min(order).alias("first")).orderBy(F.desc("count"), "first")


def missing_locators(chunks: DataFrame, size: int = 20) -> DataFrame:
    """source_file, missing, evidence_types of the sources that lack most locators."""
    own = chunks.groupBy("source_file").agg(F.count_if(~F.expr(LOCATED)).alias("missing"), F.count("*").alias("chunk_count"), F.array_join(F.array_sort(F.collect_set(F.when(~F.expr(LOCATED), F.col("evidence_type")))), ",").alias("evidence_types"))
    return own.filter("missing > 0").orderBy(F.desc("missing"), "source_file").limit(size)


#: Extensions of office documents; kinds of evidence that are pages.
OFFICE = ("docx", "xlsx", "pptx", "doc", "xls", "ppt")
PAGES = ("page", "text_page", "drawing_index")


def missing_locator_detail(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """dimension, value, missing: chunks without a locator by kind of document, kind of evidence, extension and source, and the
    raw Markdown ones of office documents by extension, in one scan. documents: doc_id, document_kind, source_file; chunks: doc_id,
    evidence_type, locator, provenance_status."""
    own = chunks.filter(~F.expr(LOCATED)).select("doc_id", "evidence_type", "provenance_status").join(documents.select("doc_id", "document_kind", "source_file"), "doc_id", "left")
    named = own.withColumn("extension", T.extension(F.coalesce("source_file", F.lit(""))))
    raw = F.when((F.col("provenance_status") == "raw_markdown") & F.col("extension").isin(*OFFICE), F.col("extension"))
    values = {"document_kind": F.coalesce("document_kind", F.lit("")), "evidence_type": F.coalesce("evidence_type", F.lit("")), "extension": F.col("extension"), "source_file": F.coalesce("source_file", F.lit("")), "office_raw_markdown": raw}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in values.items()]))
    return named.select(each.alias("x")).select("x.*").filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("missing"))


def metrics(documents: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """metric, value: each table is read once."""
    of_chunks = chunks.agg(
        F.count("*").alias("chunks"), F.count_if("is_noisy").alias("noisy_chunks"), F.count_if(F.expr(LOCATED)).alias("chunks_with_locator"),
        F.count_if(~F.expr(LOCATED)).alias("chunks_without_locator"), F.count_distinct("doc_id").alias("documents_with_chunks"),
    )
    of_documents = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("quality_status") == "low_structure").alias("low_structure_documents"), F.count_distinct("document_kind").alias("document_kinds"))
    of_entities = entities.agg(F.count("*").alias("entities"), F.count_distinct("entity_type").alias("entity_types"))
    of_mentions = mentions.agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents_with_entities"))
    parts = [x.select(F.explode(F.create_map(*[y for c in x.columns for y in (F.lit(c), F.col(c))])).alias("metric", "value")) for x in (of_chunks, of_documents, of_entities, of_mentions)]
    return reduce(DataFrame.unionByName, parts)


def page_level_documents(documents: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """PDFs of low structure whose pages can still be searched: with page chunks, some of them located, with assets, and without
    noise. documents: doc_id, title, source_file, document_kind, quality_status."""
    page = F.col("evidence_type").isin(*PAGES)
    own = documents.filter((F.col("quality_status") == "low_structure") & F.col("document_kind").endswith("_pdf"))
    counts = chunks.groupBy("doc_id").agg(F.count_if(page).alias("page_level_chunks"), F.count_if(page & F.expr(LOCATED)).alias("locator_chunks"), F.count_if("is_noisy").alias("noisy"))
    there = assets.groupBy("doc_id").agg(F.count("*").alias("asset_count"))
    good = counts.filter("page_level_chunks > 0 and locator_chunks > 0 and noisy = 0").drop("noisy")
    return own.join(good, "doc_id").join(there, "doc_id").select("doc_id", "title", "source_file", "document_kind", "quality_status", "page_level_chunks", "locator_chunks", "asset_count")


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """doc_id, evidence_type, batch_id, located, is_noisy, raw, n: all that a report counts of chunks, from one scan; as many rows as a
    document has different chunks in these, as a written table."""
    own = chunks.select("doc_id", "evidence_type", "batch_id", F.expr(LOCATED).alias("located"), F.coalesce("is_noisy", F.lit(False)).alias("is_noisy"), F.coalesce(F.col("provenance_status") == "raw_markdown", F.lit(False)).alias("raw"))
    return written(own.groupBy(*own.columns).agg(F.count("*").alias("n")), "chunk-facts")


#: The parts of a report, in order.
PARTS = (
    "documents_count", "chunks_count", "entities_count", "document_kind_distribution", "evidence_type_distribution", "top_entities", "top_batches", "missing_assets_summary", "low_quality_documents",
    "page_level_pdf_documents", "noisy_chunks_count", "chunks_without_locator", "chunks_without_locator_by_document_kind", "chunks_without_locator_by_evidence_type", "chunks_without_locator_by_extension",
    "chunks_without_locator_top_sources", "office_raw_markdown_missing_locator_summary", "noisy_documents", "hmi_translation_documents", "export_files_generated",
)


def library_report(documents: DataFrame, chunks: DataFrame, entities: DataFrame, assets: DataFrame, exports: list[str]) -> dict[str, DataFrame | list[str]]:
    """The twenty parts of a library's report. documents: doc_id, title, source_file, output_dir, document_kind, quality_status,
    missing_assets_count; chunks: doc_id, evidence_type, locator, is_noisy, batch_id, provenance_status; entities: entity_id,
    entity_text, mention_count. Chunks are read once; all parts come from what was counted then (chunk_facts), which is joined with
    the documents once."""
    facts = chunk_facts(chunks)
    docs = documents.select("doc_id", "title", "source_file", "output_dir", "document_kind", "quality_status", "missing_assets_count")
    joined = facts.join(docs, "doc_id", "left").withColumn("extension", T.extension(F.coalesce("source_file", F.lit(""))))
    page, missing = F.col("evidence_type").isin(*PAGES), ~F.col("located")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    per_document = written(
        joined.groupBy("doc_id", "title", "source_file", "output_dir", "document_kind", "quality_status").agg(
            total(page).alias("page_level_chunks"), total(page & F.col("located")).alias("locator_chunks"), total(F.col("is_noisy")).alias("noisy_chunks_count"), total(missing).alias("chunks_without_locator"),
            total(missing & F.col("raw")).alias("raw_markdown_chunks"), F.array_sort(F.collect_set(F.when(missing, F.col("evidence_type")))).alias("evidence_types"),
        ),
        "report-documents",
    )
    raw = F.when(missing & F.col("raw") & F.col("extension").isin(*OFFICE), F.col("extension"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = {
        "chunks_count": F.lit(""), "noisy_chunks_count": F.when(F.col("is_noisy"), F.lit("")), "chunks_without_locator": F.when(missing, F.lit("")), "evidence_type_distribution": T.blank_to_null(F.col("evidence_type")),
        "top_batches": T.blank_to_null(F.col("batch_id")), "chunks_without_locator_by_document_kind": F.when(missing, text("document_kind")), "chunks_without_locator_by_evidence_type": F.when(missing, text("evidence_type")),
        "chunks_without_locator_by_extension": F.when(missing, F.col("extension")), "office_raw_markdown_missing_locator_summary": raw,
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in listed.items()]))
    counts = written(joined.select(each.alias("x"), "n").select("x.*", "n").filter("value is not null").groupBy("part", "value").agg(F.sum("n").alias("count")), "report-counts")
    of = lambda part: counts.filter(F.col("part") == part)
    number = lambda part: of(part).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    by = lambda part: of(part).select("value", F.col("count").alias("missing")).orderBy(F.desc("missing"), "value")
    ranked = lambda part: of(part).select("value", "count").orderBy(F.desc("count"), "value")
    there = assets.groupBy("doc_id").agg(F.count("*").alias("asset_count"))
    pages = per_document.filter("quality_status = 'low_structure' and endswith(document_kind, '_pdf') and page_level_chunks > 0 and locator_chunks > 0 and noisy_chunks_count = 0").join(there, "doc_id")
    pages = pages.select("doc_id", "title", "source_file", "document_kind", "quality_status", "page_level_chunks", "locator_chunks", "asset_count")
    return {
        "documents_count": docs.agg(F.count("*").alias("n")), "chunks_count": number("chunks_count"), "entities_count": entities.agg(F.count("*").alias("n")),
        "document_kind_distribution": distribution(docs, "document_kind"), "evidence_type_distribution": ranked("evidence_type_distribution"),
        "top_entities": entities.orderBy(F.desc("mention_count"), "entity_id").limit(10), "top_batches": ranked("top_batches").limit(10),
        "missing_assets_summary": docs.filter("missing_assets_count > 0").select("title", F.col("missing_assets_count").alias("missing")),
        "low_quality_documents": docs.filter(F.col("quality_status").isin("low_structure", "visual_only")).join(pages, "doc_id", "left_anti").select("doc_id", "title", "quality_status"),
        "page_level_pdf_documents": pages, "noisy_chunks_count": number("noisy_chunks_count"), "chunks_without_locator": number("chunks_without_locator"),
        "chunks_without_locator_by_document_kind": by("chunks_without_locator_by_document_kind"), "chunks_without_locator_by_evidence_type": by("chunks_without_locator_by_evidence_type"), "chunks_without_locator_by_extension": by("chunks_without_locator_by_extension"),
        "chunks_without_locator_top_sources": per_document.filter("chunks_without_locator > 0 and source_file is not null").select("doc_id", "chunks_without_locator", "raw_markdown_chunks", "evidence_types", "title", "source_file", "output_dir", "document_kind").orderBy(F.desc("chunks_without_locator"), "source_file", "doc_id").limit(20),
        "office_raw_markdown_missing_locator_summary": by("office_raw_markdown_missing_locator_summary"),
        "noisy_documents": per_document.filter("noisy_chunks_count > 0 and title is not null").select("doc_id", "noisy_chunks_count", "title", "source_file").orderBy(F.desc("noisy_chunks_count"), "doc_id"),
        "hmi_translation_documents": docs.filter("document_kind = 'hmi_translation_xlsx'").select("title", "source_file", "output_dir"),
        "export_files_generated": sorted(exports),
    }


def report_rows(report: dict[str, DataFrame | list[str]], spark: SparkSession) -> DataFrame:
    """part, value: all parts of a report, each row as JSON."""
    plain = [(name, v) for name, rows in report.items() if not isinstance(rows, DataFrame) for v in rows]
    own = [rows.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("value")) for name, rows in report.items() if isinstance(rows, DataFrame)]
    return reduce(DataFrame.unionByName, own).unionByName(spark.createDataFrame(plain, "part string, value string"))


def documents_without(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    return documents.join(mentions.select("doc_id"), "doc_id", "left_anti")


def quality_issues(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, issue."""
    low = documents.filter("quality_status != 'ok'").select("doc_id", F.concat(F.lit("quality status: "), "quality_status").alias("issue"))
    noisy = chunks.filter("is_noisy").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.concat(F.col("n").cast("string"), F.lit(" noisy chunks")).alias("issue"))
    unlocated = chunks.filter(~F.expr(LOCATED)).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.concat(F.col("n").cast("string"), F.lit(" chunks without locator")).alias("issue"))
    bare = documents_without(documents, mentions).select("doc_id", F.lit("no entities").alias("issue"))
    return reduce(DataFrame.unionByName, (low, noisy, unlocated, bare))


def status_counts(rows: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row: a count for each status, 0 where there is none, and the total."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses], F.count("*").alias("total"))


def coverage(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.expr(LOCATED)).alias("with_locator"), F.count_if(~F.expr(LOCATED)).alias("without_locator"), F.count_distinct("doc_id").alias("documents"))


def folder_digest(files: DataFrame, group: str, path: Column, sha: Column) -> DataFrame:
    """group, digest, file_count: one digest for each group of files, over their paths and hashes in the order of the lower-cased
    paths. A group's rows go through one digest, sorted, and none is kept, so a group may have any size."""
    name = files.schema[group]
    schema = StructType([name, *StructType.fromDDL("digest string, file_count long").fields])
    kinds = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, digest, n = None, None, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((open_group, digest.hexdigest(), n), kinds)], schema=kinds)

        for batch in batches:
            for g, p, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if digest is None or g != open_group:
                    if digest is not None:
                        yield row()
                    open_group, digest, n = g, hashlib.sha256(), 0
                digest.update(f"{p}\n{s}\n".encode())
                n += 1
        if digest is not None:
            yield row()

    own = files.select(F.col(group).alias("_g"), path.alias("_p"), sha.alias("_s"))
    return own.repartition("_g").sortWithinPartitions("_g", F.lower("_p"), "_p", "_s").mapInArrow(fold, schema)
