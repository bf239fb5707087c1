"""Exports: interop records, JSON contracts, Markdown pages, vaults, tables and graphs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranks import numbered
from .folders import listed, write_files

#: The fields of each consumer's records.
FORMATS = {"llamaindex": ("id", "text", "metadata"), "haystack": ("id", "content", "meta"), "txtai": ("id", "text", "metadata"), "graphrag": ("id", "text", "metadata")}
METADATA = ("doc_id", "source_file", "source_path", "document_kind", "evidence_type", "locator")


def interop(rows: DataFrame, kind: str) -> DataFrame:
    """Chunks (chunk_id, text, title and METADATA) as records of one consumer."""
    ident, text, metadata = FORMATS[kind]
    names = [c for c in METADATA if c in rows.columns]
    more = {"txtai": [F.array(F.col("document_kind")).alias("tags")], "graphrag": [F.col("title"), F.col("source_file").alias("source")]}.get(kind, [])
    return rows.select(F.col("chunk_id").alias(ident), F.col("text").alias(text), F.struct(*names).alias(metadata), *more)


def write_interop(rows: DataFrame, folder: str) -> list[str]:
    """All four as JSON lines, each in its folder."""
    for kind in FORMATS:
        interop(rows, kind).write.mode("overwrite").json(f"{folder}/{kind}")
    return [f"{folder}/{kind}" for kind in FORMATS]


def write_library(library, folder: str) -> None:
    """Each table of a library as parquet, written whole; chunks by the bucket of their document."""
    for name in ("documents", "entities", "mentions", "assets", "relations"):
        getattr(library, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    library.chunks.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/chunks")


#: A pack's files that hold one text each, and the columns that they are written from.
PACK_FILES = {"document.md": "markdown", "document.raw.md": "raw_markdown", "manifest.json": "manifest", "knowledge.json": "knowledge", "entities.json": "entities", "document.json": "document"}


def pack_files(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, place, glue, text: the rows of a pack's files, document.md, document.raw.md, document.json, manifest.json,
    knowledge.json, entities.json, source_map.json and chunks.jsonl.

    documents: doc_id, output_dir, markdown, raw_markdown, and manifest, knowledge, entities, document (structs or JSON texts);
    chunks: doc_id, chunk_ord and the fields of a chunk."""
    kinds = dict(documents.dtypes)
    text = lambda c: F.coalesce(F.col(c) if kinds[c] == "string" else F.to_json(c), F.lit(""))
    none = F.lit(None).cast("string")
    row = lambda name, place, glue, content: F.struct(F.lit(name).alias("name"), place.cast("long").alias("place"), glue.alias("glue"), content.alias("text"))
    whole = [row(name, F.lit(0), none, text(c)) for name, c in PACK_FILES.items()]
    ends = [row("chunks.jsonl", F.lit(-(1 << 40)), none, F.lit("")), row("source_map.json", F.lit(-(1 << 40)), none, F.lit("{")), row("source_map.json", F.lit(1 << 40), none, F.lit("}"))]
    heads = documents.select("output_dir", F.explode(F.array(*whole, *ends)).alias("r"))
    fields = [c for c in chunks.columns if c not in ("doc_id", "chunk_ord")]
    line = F.concat(F.to_json(F.struct(*fields)), F.lit("\n"))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("chunk_id").alias("k"))), r'^\{"k":|\}$', "")
    mapped = F.concat(quoted, F.lit(": "), F.to_json(F.struct(*[c for c in fields if c != "text"])))
    own = chunks.join(documents.select("doc_id", "output_dir"), "doc_id")
    parts = own.select("output_dir", F.explode(F.array(row("chunks.jsonl", F.col("chunk_ord"), none, line), row("source_map.json", F.col("chunk_ord"), F.lit(", "), mapped))).alias("r"))
    return heads.unionByName(parts).select(F.concat("output_dir", F.lit("/"), "r.name").alias("path"), "r.place", "r.glue", "r.text")


def write_packs(documents: DataFrame, chunks: DataFrame, folder: str, replace: bool = False) -> None:
    """A folder for each document with its artifacts (pack_files). All packs appear when the last is written, or none does; a
    pack that is there is an error unless `replace` is set. A document's chunks pass through one task, in order, and are never
    held whole."""
    write_files(pack_files(documents, chunks), folder, 1, replace)


def json_contract(rows: DataFrame, schema_version: str, columns: list[str]) -> DataFrame:
    """One JSON text for each row, its keys in the given order, with the contract's version first."""
    return rows.select(F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), *columns), {"ignoreNullFields": "false"}).alias("value"))


def index_json(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, title, chunk_count and entities (distinct, as first seen) for each document."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    names = mentions.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_text"))), lambda x: x["entity_text"])).alias("entities"))
    return documents.join(counts, "doc_id", "left").join(names, "doc_id", "left").select("doc_id", "title", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("entities", F.array()).alias("entities"))


def library_index(documents: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """path, place, glue, text: library_index.json, its counts, distributions (values in the order first seen), first entities and
    documents in their order; each document is a row, so the file may have any number of them.

    documents: doc_id, doc_ord, title, source_file, document_kind, output_dir; chunks: doc_id, chunk_ord, evidence_type; entities:
    entity_id, entity_type, entity_text, normalized_text, first_ord; mentions: entity_id, doc_id, chunk_id, ord."""
    from ..operators import library

    own = mentions.filter("chunk_id is null").join(entities.select("entity_id", "entity_text"), "entity_id")
    counted = own.groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    top = library.top_entities(entities.drop("mention_count").join(counted, "entity_id")).withColumn("_n", F.monotonically_increasing_id())
    placed = chunks.join(documents.select("doc_id", "doc_ord"), "doc_id", "left")
    number = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(0).alias("at"), F.concat(F.lit(f'"{name}": '), F.col("n").cast("string")).alias("text"))
    object_of = lambda rows, key: rows.select(F.col("first").alias("at"), F.concat(_quoted(F.col(key)), F.lit(": "), F.col("n").cast("string")).alias("text"))
    kinds = documents.groupBy("document_kind").agg(F.count("*").alias("n"), F.min("doc_ord").alias("first"))
    evidence = placed.groupBy("evidence_type").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_ord", F.lit(0)) * (1 << 24) + F.col("chunk_ord")).alias("first"))
    shown = index_json(documents, chunks, own).withColumnRenamed("chunk_count", "chunks_count")
    listed = documents.join(shown.drop("title"), "doc_id").select(F.col("doc_ord").alias("at"), F.col("doc_id").cast("string").alias("tie"), F.to_json(F.struct("doc_id", "title", "source_file", "document_kind", "chunks_count", "entities", "output_dir"), {"ignoreNullFields": "false"}).alias("text"))
    fields = ["entity_text", "entity_type", "entity_types", "normalized_text", "count"]
    parts: list[tuple[DataFrame | str, str | None]] = [
        ("{", None), (number(documents, "documents_count"), ""), (", ", None), (number(chunks, "chunks_count"), ""), (", ", None), (number(entities, "entities_count"), ""),
        (', "document_kind_distribution": {', None), (object_of(kinds, "document_kind"), ", "), ('}, "evidence_type_distribution": {', None), (object_of(evidence, "evidence_type"), ", "),
        ('}, "top_entities": [', None), (top.select(F.col("_n").alias("at"), F.to_json(F.struct(*fields)).alias("text")), ", "), ('], "documents": [\n', None), (listed, ",\n"),
        (f'\n], "warnings": {json.dumps(warnings or [], ensure_ascii=False)}}}\n', None),
    ]
    spark, rows = documents.sparkSession, []
    for k, (part, glue) in enumerate(parts):
        part = spark.createDataFrame([(0, part)], "at long, text string") if isinstance(part, str) else part
        tie = "tie" if "tie" in part.columns else "text"  # a document's text goes to the file's task once
        rows.append(part.select(F.lit("library_index.json").alias("path"), F.struct(F.lit(k).alias("part"), F.col("at").cast("long").alias("at"), F.col(tie).alias("tie")).alias("place"), F.lit(glue).cast("string").alias("glue"), "text"))
    return reduce(DataFrame.unionByName, rows)


def _quoted(value: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("k"))), r'^\{"k":|\}$', "")


def manifest(documents: int, chunks: int, entities: int, warnings: list[str], root: str) -> dict:
    from datetime import UTC, datetime

    built = datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    return {"schema_version": "1", "built_at": built, "input_output_root": root, "documents_count": documents, "chunks_count": chunks, "entities_count": entities, "warnings_count": len(warnings), "exports_count": len(FORMATS)}


#: The portal's pages and their headings.
PORTAL = ("_library.md", "_documents.md", "_entities.md", "_topics.md", "_batches.md", "_quality_report.md")
KEY_ENTITIES, KEY_TOPICS, KEY_BATCHES, TOPIC_LOCATORS, LISTED_PAGES = 15, 30, 50, 10, 100
NO_ISSUES, NO_ROWS, NO_PAGES = "_No quality issues detected._", "_None._", "- No page-level searchable PDFs detected."
DOCUMENT_COLUMNS = ["| Title | Source File | Quality | Output |", "|---|---|---|---|"]
LOCATOR_NOTE = "- note: Missing locator data is often already absent in source_map/chunks for raw_markdown inputs; the library builder preserves available locator data and does not invent missing provenance."
_LINE = "page string, part int, name string, at long, line string"
#: The place of a piece of a line that another piece begins.
MORE = 1 << 41


def _lines(rows: DataFrame, page: str, part: int, line: Column, name: Column | None = None, at: Column | None = None) -> DataFrame:
    """Lines of a part of a page, in the order of name and place."""
    none = F.lit("") if name is None else name
    return rows.select(F.lit(page).alias("page"), F.lit(part).alias("part"), none.cast("string").alias("name"), (F.lit(0) if at is None else at).cast("long").alias("at"), line.alias("line"))


def _listed_by(rows: DataFrame, page: str, part: int, group: Column, heading: Column, line: Column, at: Column, more: list[str]) -> DataFrame:
    """For each group in order: a heading, an empty line (then `more`), a line for each row, an empty line."""
    heads = rows.select(group.alias("g"), heading.alias("h")).distinct()
    begin = F.array(F.col("h"), F.lit(""), *map(F.lit, more))
    first = heads.select("g", F.posexplode(begin).alias("k", "line"))
    last = heads.select("g", F.lit("").alias("line"))
    own = _lines(rows, page, part, line, group, at)
    return own.unionByName(_lines(first, page, part, F.col("line"), F.col("g"), F.col("k") - (1 << 40))).unionByName(_lines(last, page, part, F.col("line"), F.col("g"), F.lit(1 << 40)))


def _or_else(rows: DataFrame, page: str, part: int, instead: str) -> DataFrame:
    """The lines, or one line where there are none."""
    spark = rows.sparkSession
    none = spark.createDataFrame([(page, part, "", 0, instead)], _LINE)
    return rows.unionByName(none.join(rows.limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_anti"))


def portal(documents: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, assets: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """page, part, name, at, line: the lines of the six pages, to be read in the order of these columns; nothing is gathered.

    documents: doc_id, doc_ord, title, source_file, output_dir, document_kind, quality_status, and whichever of extraction_status,
    missing_assets_count, embedded_images_count there are; chunks: doc_id, chunk_id, chunk_ord, title, text, evidence_type, locator,
    is_noisy, provenance_status, and whichever of topic_label, section_title, heading_path, batch_id, confidence there are; entities:
    entity_id, entity_type, entity_text, normalized_text, mention_count, first_ord; mentions: entity_id, doc_id, chunk_id."""
    from ..operators import library, reports

    spark, warnings = documents.sparkSession, warnings or []
    given = lambda rows, c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    fixed = lambda page, part, lines: spark.createDataFrame([(page, part, "", k, x) for k, x in enumerate(lines)], _LINE)
    out: list[DataFrame] = []

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.concat(F.lit(f"- {name}: "), F.col("n").cast("string")).alias("line"))

    page = PORTAL[0]
    doc_line = F.concat(F.lit("- ["), "title", F.lit("]("), "output_dir", F.lit("/document.md)"))
    kinds = documents.groupBy("document_kind").agg(F.count("*").alias("n"), F.min("doc_ord").alias("first"))
    label, batch = T.blank_to_null(given(chunks, "topic_label")), T.blank_to_null(given(chunks, "batch_id"))
    some = lambda rows, most: rows.filter("v is not null").distinct().orderBy("v").limit(most)
    top = library.top_entities(entities, KEY_ENTITIES)
    issues = reports.quality_issues(documents, chunks, mentions.filter("chunk_id is null")).join(documents.select("doc_id", "doc_ord", "title"), "doc_id")
    out += [
        fixed(page, 0, ["# Knowledge Library", "", "## Library Summary", ""]),
        *[_lines(counted(rows, name), page, 1 + k, F.col("line")) for k, (rows, name) in enumerate(((documents, "documents_count"), (chunks, "chunks_count"), (entities, "entities_count")))],
        fixed(page, 4, ["", "## Document Kind Distribution", ""]),
        _lines(kinds, page, 5, F.concat(F.lit("- "), "document_kind", F.lit(": "), F.col("n").cast("string")), None, F.col("first")),
        fixed(page, 6, ["", "## Documents by Type", ""]),
        _listed_by(documents, page, 7, F.col("document_kind"), F.concat(F.lit("### "), "document_kind"), doc_line, F.col("doc_ord"), []),
        fixed(page, 8, ["## Key Entities", ""]),
        _lines(top.withColumn("_n", F.monotonically_increasing_id()), page, 9, F.concat(F.lit("- "), "entity_text", F.lit(" ("), F.array_join("entity_types", ", "), F.lit("): "), F.col("count").cast("string")), None, F.col("_n")),
        fixed(page, 10, ["", "## Key Topics", ""]), _lines(some(chunks.select(label.alias("v")), KEY_TOPICS), page, 11, F.concat(F.lit("- "), "v"), F.col("v")),
        fixed(page, 12, ["", "## Batch IDs", ""]), _lines(some(chunks.select(batch.alias("v")), KEY_BATCHES), page, 13, F.concat(F.lit("- "), "v"), F.col("v")),
        fixed(page, 14, ["", "## Quality Issues", ""]),
        _or_else(_lines(issues, page, 15, F.concat(F.lit("- "), "title", F.lit(": "), "issue"), F.col("issue"), F.col("doc_ord")), page, 15, NO_ISSUES),
    ]

    page = PORTAL[1]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "title", "source_file", "quality_status", "output_dir"), F.lit(" |"))
    out += [fixed(page, 0, ["# Documents", ""]), _listed_by(documents, page, 1, F.col("document_kind"), F.concat(F.lit("## "), "document_kind"), row, F.col("doc_ord"), DOCUMENT_COLUMNS)]

    page = PORTAL[2]  # an entity's further titles are pieces of its line, as a common entity has very many
    of_type = F.col("entity_type")
    own = entities.select("entity_id", "entity_type", "entity_text", F.concat_ws("\u0001", "entity_type", F.lower("entity_text"), "entity_id").alias("name"))
    titles = mentions.filter("chunk_id is null").join(documents.select("doc_id", "title"), "doc_id").select("entity_id", "title").distinct()
    first = titles.groupBy("entity_id").agg(F.min("title").alias("_first"))
    begun = _lines(own.join(first, "entity_id", "left"), page, 1, F.concat(F.lit("- "), "entity_text", F.lit(": "), F.coalesce("_first", F.lit(""))), F.col("name"))
    more = titles.join(first, "entity_id").filter("title > _first").join(own, "entity_id")
    types = own.select("entity_type").distinct()
    out += [
        fixed(page, 0, ["# Entities", ""]),
        _lines(types, page, 1, F.concat(F.lit("## "), of_type), of_type, F.lit(0)), _lines(types, page, 1, F.lit(""), of_type, F.lit(1)),
        begun, _lines(more, page, 1, F.col("title"), F.concat_ws("\u0002", "name", "title"), F.lit(MORE)),
        _lines(types, page, 1, F.lit(""), F.concat(of_type, F.lit("\u0002"))),
    ]

    page = PORTAL[3]
    heading = F.try_element_at(given(chunks, "heading_path", "array<string>"), F.lit(-1))
    topic = F.coalesce(label, T.blank_to_null(given(chunks, "section_title")), F.when(F.col("evidence_type") == "drawing_index", F.coalesce(heading, F.col("title"))), F.when(F.col("evidence_type") == "table_section", T.blank_to_null(F.col("title"))))
    own = chunks.select(topic.alias("topic"), T.blank_to_null(F.col("locator")).alias("locator")).filter("topic is not null").groupBy("topic", "locator").agg(F.count("*").alias("n"))
    first = own.filter("locator is not null").select("topic", "locator")
    first = numbered(first, ["topic"], ["locator"], "_k").filter(F.col("_k") <= TOPIC_LOCATORS).groupBy("topic").agg(F.array_sort(F.collect_list("locator")).alias("some"))  # TOPIC_LOCATORS for each
    topics = own.groupBy("topic").agg(F.sum("n").alias("n")).join(first, "topic", "left")
    line = F.concat(F.lit("- "), "topic", F.lit(": "), F.col("n").cast("string"), F.lit(" chunks; "), F.coalesce(F.array_join("some", ", "), F.lit("")))
    out += [fixed(page, 0, ["# Topics", ""]), _lines(topics, page, 1, line, F.col("topic"))]

    page = PORTAL[4]
    batches = chunks.withColumns({"_b": batch, "_c": given(chunks, "confidence")}).filter("_b is not null").select("_b", "_c", "doc_id", "chunk_ord", "locator", "text").join(documents.select("doc_id", "doc_ord", F.col("title").alias("_t")), "doc_id", "left")
    line = F.concat(F.lit("- "), F.coalesce("_t", F.lit("")), F.lit(": "), F.coalesce("locator", F.lit("")), F.lit("; confidence="), F.coalesce("_c", F.lit("")), F.lit("; "), T.preview(F.col("text")))
    out += [fixed(page, 0, ["# Batches", ""]), _listed_by(batches, page, 1, F.col("_b"), F.concat(F.lit("## "), "_b"), line, F.coalesce("doc_ord", F.lit(0)) * (1 << 24) + F.col("chunk_ord"), [])]

    page = PORTAL[5]
    failed = [w for w in warnings if "failed" in w.lower()]
    pages = reports.page_level_documents(documents, chunks, assets).join(documents.select("doc_id", "doc_ord"), "doc_id")
    page_line = F.concat(F.lit("- "), "title", F.lit(": "), "document_kind", F.lit(", "), "quality_status", F.lit(", locators="), F.col("locator_chunks").cast("string"), F.lit(", assets="), F.col("asset_count").cast("string"))
    low = documents.filter("quality_status = 'low_structure'").join(pages.select("doc_id"), "doc_id", "left_anti")
    visual = documents.filter((F.col("quality_status") == "visual_only") | (given(documents, "extraction_status") == "image_only"))
    number = lambda c: F.coalesce(given(documents, c, "int"), F.lit(0))
    media = documents.withColumns({"_m": number("missing_assets_count"), "_e": number("embedded_images_count")}).filter("_m > 0 or _e > 0")
    media_line = F.concat(F.lit("- "), "title", F.lit(": missing_assets_count="), F.col("_m").cast("string"), F.lit(", embedded_images_count="), F.col("_e").cast("string"))
    detail = reports.missing_locator_detail(documents, chunks)
    unlocated = chunks.filter("coalesce(locator, '') = ''")
    note = unlocated.limit(1).select(F.explode(F.array(F.lit(LOCATOR_NOTE))).alias("line"))
    titled = lambda rows, part: _or_else(_lines(rows, page, part, F.concat(F.lit("- "), "title"), None, F.col("doc_ord")), page, part, NO_ROWS)
    out += [
        fixed(page, 0, ["# Quality Report", "", "## Failed Documents", "", *([f"- {w}" for w in failed] or [NO_ROWS]), "", "## Page-Level Searchable PDFs", ""]),
        _lines(counted(pages, "page_level_pdf_count"), page, 1, F.col("line")),
        _or_else(_lines(pages.orderBy("doc_ord").limit(LISTED_PAGES), page, 2, page_line, None, F.col("doc_ord")), page, 2, NO_PAGES),
        fixed(page, 3, ["", "## Low Structure", ""]), titled(low, 4), fixed(page, 5, ["", "## Visual Only / Image Only", ""]), titled(visual, 6),
        fixed(page, 7, ["", "## Missing / Embedded Assets", ""]), _or_else(_lines(media, page, 8, media_line, None, F.col("doc_ord")), page, 8, NO_ROWS),
        fixed(page, 9, ["", "## Chunks Without Locator", ""]), _lines(counted(unlocated, "chunks_without_locator"), page, 10, F.col("line")), _lines(note, page, 11, F.col("line")),
    ]
    for k, (title, name) in enumerate((("By Document Kind", "document_kind"), ("By Evidence Type", "evidence_type"), ("By Source Extension", "extension"))):
        own = detail.filter(F.col("dimension") == name)
        shown = F.concat(F.lit("."), "value") if name == "extension" else F.col("value")
        head = own.limit(1).select(F.posexplode(F.array(F.lit(""), F.lit(f"### {title}"), F.lit(""))).alias("k", "line"))
        out += [_lines(head, page, 12 + 2 * k, F.col("line"), None, F.col("k")), _lines(own, page, 13 + 2 * k, F.concat(F.lit("- "), shown, F.lit(": "), F.col("missing").cast("string")), F.col("value"), -F.col("missing"))]
    out += [fixed(name, 99, [""]) for name in (PORTAL[0], PORTAL[3], PORTAL[5])]
    return reduce(DataFrame.unionByName, out)


def portal_files(lines: DataFrame) -> DataFrame:
    """path, place, glue, text: the portal's pages as files."""
    glue = F.when(F.col("at") == MORE, F.lit(", ")).otherwise(F.lit("\n"))
    return lines.select(F.col("page").alias("path"), F.struct("part", "name", "at").alias("place"), glue.alias("glue"), F.col("line").alias("text"))


def write_portal(lines: DataFrame, folder: str, replace: bool = True) -> None:
    """The six pages; lines are put together by ranges, and a page's task writes the blocks down."""
    write_files(portal_files(lines), folder, 1, replace, long=True)


def _unique_names(rows: DataFrame, title: str, key: str) -> DataFrame:
    """Adds name: a file name that is unique whatever the case; later ones of a name end with a part of their key's hash. The first
    of a name is a minimum that is taken before anything is shuffled."""
    own = rows.withColumn("_name", T.note_name(F.col(title)))
    first = own.groupBy(F.lower("_name").alias("_low")).agg(F.min(key).alias("_first"))
    named = F.when(F.col(key).eqNullSafe(F.col("_first")), F.col("_name")).otherwise(F.concat("_name", F.lit("-"), F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 8)))
    return own.join(first, F.lower("_name") == F.col("_low"), "left").withColumn("name", named).drop("_name", "_low", "_first")


def vault_notes(documents: DataFrame, previews: DataFrame) -> DataFrame:
    """name (unique whatever the case), markdown: a note with front matter for each document."""
    named = _unique_names(documents.join(previews, "doc_id", "left"), "title", "doc_id")
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("preview", F.lit("")))
    return named.select("name", T.front_matter({"doc_id": F.col("doc_id"), "document_kind": F.col("document_kind")}, body).alias("markdown"))


def concept_notes(concepts: DataFrame, evidence: DataFrame, most: int = 100, most_evidence: int = 5) -> DataFrame:
    """name, markdown: a note for each of the `most` heaviest concepts (label, weight, doc_count) with up to `most_evidence` places
    (label, document_title, locator, ord) where it stands."""
    from pyspark.sql import Window

    chosen = concepts.orderBy(F.desc("weight"), "label").limit(most)
    near = evidence.join(F.broadcast(chosen.select("label")), "label").withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("ord")))  # `most` labels
    places = near.filter(F.col("_n") <= most_evidence).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_n", "document_title", F.coalesce("locator", F.lit("")).alias("locator")))).alias("_p"))
    lines = F.array_join(F.transform("_p", lambda x: F.concat(F.lit("- [["), x["document_title"], F.lit("]] "), x["locator"])), "\n")
    named = _unique_names(chosen.join(places, "label", "left"), "label", "label")
    body = F.concat(F.lit("# "), F.col("label"), F.lit("\n\n## Evidence\n\n"), F.coalesce(lines, F.lit("")))
    return named.select("name", T.front_matter({"label": F.col("label"), "weight": F.col("weight"), "documents": F.col("doc_count")}, body).alias("markdown"))


def export_vault(notes: DataFrame, concepts: DataFrame, folder: str, report: str = "", overwrite: bool = False, dry_run: bool = False) -> dict:
    """Documents/, Concepts/, an index note, a report note and a manifest, all of them or none; a dry run only says what would be
    written. A folder that isn't empty is refused unless overwrite is set. The index passes through one task, line by line."""
    manifest = {"documents_exported": notes.count(), "concepts_exported": concepts.count(), "overwrite": overwrite, "dry_run": dry_run, "folder": folder}
    if dry_run:
        return manifest
    _refuse(folder, overwrite)
    spark = notes.sparkSession
    fixed = [("00_Library_Report.md", "", f"# Library report\n\n{report}\n"), ("export_manifest.json", "", json.dumps(manifest, ensure_ascii=False))]
    rows = []
    for k, (title, own) in enumerate((("Documents", notes), ("Concepts", concepts))):
        fixed += [("00_Index.md", f"{k}0", f"# {title}\n\n"), ("00_Index.md", f"{k}2", "\n")]
        rows.append(own.select(F.concat(F.lit(f"{title}/"), "name", F.lit(".md")).alias("path"), F.lit("").alias("place"), F.col("markdown").alias("text")))
        rows.append(own.select(F.lit("00_Index.md").alias("path"), F.concat(F.lit(f"{k}1"), "name").alias("place"), F.concat(F.lit("- [["), "name", F.lit("]]\n")).alias("text")))
    rows.append(spark.createDataFrame(fixed, "path string, place string, text string"))
    write_files(reduce(DataFrame.unionByName, rows), folder, 2, overwrite)
    return manifest


def _refuse(folder: str, overwrite: bool) -> None:
    if not overwrite and listed(folder):
        raise ValueError(f"not empty: {folder}")


def write_vault(notes: DataFrame, folder: str, overwrite: bool = False) -> None:
    """The notes as text files, all of them or none; a folder that isn't empty is refused unless overwrite is set."""
    _refuse(folder, overwrite)
    write_files(notes.select(F.concat("name", F.lit(".md")).alias("path"), F.lit("").alias("place"), F.col("markdown").alias("text")), folder, 1, overwrite)
