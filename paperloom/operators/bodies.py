"""The Markdown body of a document, by its kind.

Every body is a list of lines with places (part, at), made by expressions over the tables that a document's pages, sections, slides,
topics and studies are; the lines of all documents are one frame, from which each document's text is put together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds by the shape of their body, a body's headings, and what stands where there is nothing.
MANUALS = ("manual_pdf", "functional_description_pdf", "fault_catalog_pdf")
DRAWINGS = ("technical_drawing_pdf",)
PRESENTATIONS = ("process_development_presentation", "project_presentation_pptx")
RELEASES = ("release_rationale_docx",)
SUMMARY, METADATA, TRACE, CONTENT = "## Document Summary", "## Key Metadata", "## Source Traceability", "## Content"
NO_SUMMARY, NO_REVISION, NO_TOC, NO_PAGES, NO_OUTLINE, NO_TEXT = "_No summary generated._", "_No revision history detected._", "_No table of contents detected._", "_No page overview available._", "_No section outline detected._", "_No text extracted for this page._"
NO_TOPICS, NO_PARAMETERS, NO_RECOMMENDATION, NO_EXTRACTED, NOT_RENDERED = "_No topic outline generated._", "_No key process parameters detected._", "_No recommendation detected._", "_No text extracted._", "No page images rendered. Re-run with --render-pdf-pages."
VISION_NOTE, REVISION_TITLE = "- note: No text was extracted; page image preserved for visual review.", "Revision Overview"
PROJECT_FIELDS = ("project_number", "project_name", "annual_volume", "production_size", "formula_structure", "technology", "manloc", "package_type", "batch_ids", "equipment", "process_parameters")
RELEASE_FIELDS = ("document_title", "project_number", "product_name", "pathfinder_mass_code", "manufacturing_location", "filling_location", "formula_system", "release_phase", "annual_volume")
SLIDE_HEAD = ["| Slide | Title | Topic | Visual Evidence Needed | Key Entities |", "|---|---|---|---|---|"]
STUDY_HEAD = ["| Batch ID | Batch Size | Equipment / Route | M4E Parameter | Result / Status | Confidence | Evidence Slides | Evidence Snippet |", "|---|---|---|---|---|---|---|---|"]
DRAWING_HEAD = ["| Page Code | Description | Type | Date | Edited By | Source |", "|---|---|---|---|---|---|"]


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _item(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), value)


def _fixed(*lines: str) -> list[Column]:
    return [F.lit(x) for x in lines]


def _metadata(*more: Column) -> list[Column]:
    ocr = F.lower(F.coalesce("requires_ocr_or_vision", F.lit(False)).cast("string"))
    return [_item("source_file", _text("source_file")), _item("document_kind", _text("document_kind")), _item("quality_status", _text("quality_status")), _item("extraction_status", F.coalesce("extraction_status", F.lit("text"))), _item("requires_ocr_or_vision", ocr), *more]


def _trace() -> list[Column]:
    return [*_fixed(TRACE, ""), _item("source_path", _text("source_path")), _item("checksum", _text("checksum")), F.lit("")]


def _part(rows: DataFrame, part: int, lines: list[Column], at: Column | None = None) -> DataFrame:
    """The lines of each row (doc_id, ...) as a part of its document; at: the row's place in the part."""
    place = F.lit(0) if at is None else at
    own = rows.select("doc_id", place.cast("long").alias("_at"), F.posexplode(F.array(*lines)).alias("_k", "line")).filter("line is not null")
    return own.select("doc_id", F.lit(part).alias("part"), F.col("_at").alias("at"), F.col("_k").alias("k"), "line")


def _instead(docs: DataFrame, rows: DataFrame, part: int, lines: list[Column]) -> DataFrame:
    """The lines for the documents that have no rows."""
    return _part(docs.join(rows.select("doc_id"), "doc_id", "left_anti"), part, lines)


def _general(docs: DataFrame) -> list[DataFrame]:
    head = [F.concat(F.lit("# "), "title"), *_fixed("", SUMMARY, "", NO_SUMMARY, "", METADATA, ""), *_metadata(_item("converter", _text("converter"))), F.lit("")]
    return [_part(docs, 0, [*head, *_trace(), *_fixed(CONTENT, ""), _stripped(F.col("markdown")), F.lit("")])]


def _manual(docs: DataFrame, pages: DataFrame, toc: DataFrame) -> list[DataFrame]:
    name = F.try_element_at("fields", F.lit("equipment_name"))
    title = F.when((F.col("document_kind") == MANUALS[1]) & (_text(name) != ""), F.concat(F.lit("Functional Description - "), name)).otherwise(F.col("title"))
    extra = F.array_join(F.transform(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    head = [F.concat(F.lit("# "), title), *_fixed("", SUMMARY, "", NO_SUMMARY, "", METADATA, ""), *_metadata(_item("converter", _text("converter")), _item("tags", F.array_join(F.coalesce("tags", F.array()), ", ")), T.blank_to_null(extra)), F.lit("")]
    revised = pages.filter(F.col("page_title") == REVISION_TITLE)
    section = F.concat(F.lit("- "), "section_number", F.lit(" "), "title")
    number, shown = F.concat(F.lit("Source page: "), F.col("page_number").cast("string")), F.coalesce("page_title", F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    return [
        _part(docs, 0, [*head, *_trace(), *_fixed("## Revision History", "")]),
        _part(revised, 1, [number, F.lit(""), _stripped(F.col("text")), F.lit("")], F.col("page_number")), _instead(docs, revised, 1, _fixed(NO_REVISION, "")),
        _part(docs, 2, _fixed("## Table of Contents", "")), _part(toc, 3, [section], F.col("position")), _instead(docs, toc, 3, _fixed(NO_TOC)),
        _part(docs, 4, _fixed("", "## Page Overview", "")), _part(pages, 5, [F.concat(F.lit("- "), shown, F.lit(": "), _text("locator"))], F.col("page_number")), _instead(docs, pages, 5, _fixed(NO_PAGES)),
        _part(docs, 6, _fixed("", "## Section Outline", "")), _part(toc, 7, [section], F.col("position")), _instead(docs, toc, 7, _fixed(NO_OUTLINE)),
        _part(docs, 8, _fixed("", CONTENT, "")),
        _part(pages, 9, [F.concat(F.lit("### "), shown), F.lit(""), number, F.lit(""), F.coalesce(T.blank_to_null(_stripped(F.col("text"))), F.lit(NO_TEXT)), F.lit("")], F.col("page_number")),
        _instead(docs, pages, 9, [_stripped(F.col("markdown"))]),
    ]


def _drawing(docs: DataFrame, pages: DataFrame, drawings: DataFrame) -> list[DataFrame]:
    name = F.regexp_replace("source_file", r"\.[^.]*$", "")
    note = F.when(F.col("requires_ocr_or_vision"), F.lit(VISION_NOTE))
    head = [F.concat(F.lit("# "), name), *_fixed("", SUMMARY, "", NO_SUMMARY, "", "## Document Classification", ""), *_metadata(note)[1:], *_fixed("", METADATA, ""), _item("source_file", _text("source_file")), _item("converter", _text("converter")), _item("tags", F.array_join(F.coalesce("tags", F.array()), ", ")), F.lit("")]
    rows = [F.concat(F.lit("| "), F.concat_ws(" | ", *map(_text, ("page_code", "page_description", "page_type", "date", "edited_by", "locator"))), F.lit(" |"))]
    shown = F.coalesce("page_title", F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    number, image = F.col("page_number").cast("string"), _text("image_path")
    link = F.concat(F.lit("- "), shown, F.lit(": "), F.coalesce("locator", F.concat(F.lit("Page "), number)), F.lit(" - "), image)
    some = drawings.select("doc_id").distinct()
    texts = pages.join(docs.select("doc_id", F.col("markdown").alias("_whole")), "doc_id")
    own = F.coalesce(T.blank_to_null(_stripped(F.coalesce(T.blank_to_null(F.col("text")), F.col("_whole")))), F.lit(NO_EXTRACTED))
    return [
        _part(docs, 0, [*head, *_trace(), *_fixed("## Page Index", "")]), _part(some, 1, _fixed("## Drawing Index", "", *DRAWING_HEAD)), _part(drawings, 2, rows, F.col("position")), _part(some, 3, _fixed("")),
        _part(pages, 4, [link], F.col("page_number")), _part(pages.select("doc_id").distinct(), 5, _fixed("")),
        _part(texts, 6, [F.concat(F.lit("## "), shown), F.lit(""), F.concat(F.lit("Source page: "), number), F.lit(""), F.concat(F.lit("![Page "), number, F.lit("]("), image, F.lit(")")), *_fixed("", "### Extracted Text", ""), own, *_fixed("", "### Notes", "", "")], F.col("page_number")),
        _instead(docs, pages, 6, [*_fixed(NOT_RENDERED, "", "## Extracted Text", ""), F.coalesce(T.blank_to_null(_stripped(F.col("markdown"))), F.lit(NO_EXTRACTED)), F.lit("")]),
    ]


def _field_rows(names: tuple[str, ...]) -> list[Column]:
    value = lambda n: F.replace(_text(F.try_element_at("fields", F.lit(n))), F.lit("|"), F.lit("/"))
    return [F.lit("| Field | Value |"), F.lit("|---|---|"), *[F.concat(F.lit(f"| {n} | "), value(n), F.lit(" |")) for n in names]]


def _release(docs: DataFrame) -> list[DataFrame]:
    given = lambda n, none: F.coalesce(T.blank_to_null(F.try_element_at("fields", F.lit(n))), F.lit(none))
    parameters = F.try_element_at("fields", F.lit("process_parameters"))
    listed = F.coalesce(F.array_join(F.transform(F.split(T.blank_to_null(parameters), r"\s*;\s*"), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(NO_PARAMETERS))
    head = [F.concat(F.lit("# "), "title"), *_fixed("", "## Release Summary", ""), given("summary", NO_SUMMARY), *_fixed("", "## Key Release Metadata", ""), *_field_rows(RELEASE_FIELDS), *_fixed("", "## Key Process Parameters", ""), listed, *_fixed("", "## Recommendation", ""), given("recommendation", NO_RECOMMENDATION), F.lit("")]
    return [_part(docs, 0, [*head, *_trace(), *_fixed(CONTENT, ""), _stripped(F.col("markdown")), F.lit("")])]


def _presentation(docs: DataFrame, slides: DataFrame, topics: DataFrame, studies: DataFrame) -> list[DataFrame]:
    given = lambda n, none: F.coalesce(T.blank_to_null(F.try_element_at("fields", F.lit(n))), F.lit(none))
    number, visual = F.col("slide_number").cast("string"), F.lower(F.coalesce("visual", F.lit(False)).cast("string"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", number, _text("title"), _text("topic"), visual, F.lit("")), F.lit(" |"))
    cells = [F.replace(_text(c), F.lit("|"), F.lit("/")) for c in ("batch_id", "batch_size", "route", "parameter", "status", "confidence", "locators", "snippet")]
    narrative = F.array_join(F.transform(F.split(T.blank_to_null(F.try_element_at("fields", F.lit("narrative"))), "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return [
        _part(docs, 0, [F.concat(F.lit("# "), "title"), *_fixed("", "## Presentation Summary", ""), given("summary", NO_SUMMARY), *_fixed("", "## Key Project Metadata", ""), *_field_rows(PROJECT_FIELDS), *_fixed("", "## Slide Index", "", *SLIDE_HEAD)]),
        _part(slides, 1, [row], F.col("slide_number")), _part(docs, 2, _fixed("", "## Topic Outline", "")), _part(topics, 3, [F.concat(F.lit("- "), "topic", F.lit(": "), _text("locator"))], F.col("position")), _instead(docs, topics, 3, _fixed(NO_TOPICS)),
        _part(docs, 4, [*_fixed("", "## Process Development Narrative", ""), narrative, *_fixed("", "## Batch Study Summary", "", *STUDY_HEAD)]), _part(studies, 5, [F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))], F.col("position")),
        _part(docs, 6, [F.lit(""), *_trace(), *_fixed("## Slides", "")]),
        _part(slides, 7, [F.concat(F.lit("### "), F.coalesce("title", F.lit("Untitled Slide"))), F.lit(""), F.concat(F.lit("Source: Slide "), number), F.concat(F.lit("Topic: "), _text("topic")), F.concat(F.lit("Visual evidence needed: "), visual), F.lit(""), _text("text"), F.lit("")], F.col("slide_number")),
        _instead(docs, slides, 7, [*_fixed(CONTENT, ""), _stripped(F.col("markdown")), F.lit("")]),
    ]


def body_lines(docs: DataFrame, pages: DataFrame, toc: DataFrame, drawings: DataFrame, slides: DataFrame, topics: DataFrame, studies: DataFrame) -> DataFrame:
    """doc_id, part, at, k, line: the lines of every body, to be read in the order of these.

    docs: doc_id, title, source_file, source_path, checksum, document_kind, quality_status, extraction_status,
    requires_ocr_or_vision, converter, tags (array), fields (map), markdown; pages: doc_id, page_number, page_title, locator, text,
    image_path; toc: doc_id, position, section_number, title; drawings: doc_id, position and a drawing index's columns; slides:
    doc_id, slide_number, title, topic, visual, text; topics: doc_id, position, topic, locator; studies: doc_id, position, batch_id,
    batch_size, route, parameter, status, confidence, locators, snippet."""
    kind = F.col("document_kind")
    of = lambda kinds: docs.filter(kind.isin(*kinds))
    inside = lambda rows, kinds: rows.join(of(kinds).select("doc_id"), "doc_id", "left_semi")
    parts = [
        *_general(docs.filter(kind.isNull() | ~kind.isin(*MANUALS, *DRAWINGS, *PRESENTATIONS, *RELEASES))), *_manual(of(MANUALS), inside(pages, MANUALS), inside(toc, MANUALS)), *_release(of(RELEASES)),
        *_drawing(of(DRAWINGS), inside(pages, DRAWINGS), inside(drawings, DRAWINGS)), *_presentation(of(PRESENTATIONS), *(inside(x, PRESENTATIONS) for x in (slides, topics, studies))),
    ]
    return reduce(DataFrame.unionByName, parts)


def document_bodies(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """doc_id, markdown: the lines of each document, one below the other. Tables that aren't given are empty."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    schemas = {
        "pages": "page_number int, page_title string, locator string, text string, image_path string", "toc": "position int, section_number string, title string",
        "drawings": "position int, page_code string, page_description string, page_type string, date string, edited_by string, locator string", "slides": "slide_number int, title string, topic string, visual boolean, text string",
        "topics": "position int, topic string, locator string", "studies": "position int, batch_id string, batch_size string, route string, parameter string, status string, confidence string, locators string, snippet string",
    }
    given = {name: tables.get(name, spark.createDataFrame([], f"doc_id {key}, {schema}")) for name, schema in schemas.items()}
    lines = body_lines(docs, **given).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "k", "line"))).alias("_l"))  # a document's own text
    return lines.select("doc_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("markdown"))


#: A record's counts, and the fields that it has only if the document does.
RECORD_COUNTS = (
    "pages_count", "text_pages_count", "rendered_pages_count", "text_chunks_count", "image_chunks_count", "page_chunks_count", "searchable_page_chunks_count", "section_chunks_count", "section_chunks_with_body_count",
    "slide_chunks_count", "table_chunks_count", "topic_chunks_count", "batch_study_chunks_count", "visual_heavy_slides_count", "drawing_index_count", "embedded_images_count", "missing_assets_count",
)
OPTIONAL_FIELDS = (
    "document_type", "project_number", "project_name", "product_name", "mass_code", "formula_structure", "formula_system", "annual_volume", "production_size", "manufacturing_location", "filling_location",
    "equipment", "process_parameters", "batch_ids", "slide_count", "slide_index", "topic_outline", "batch_study_summary", "process_development_narrative", "sheet_names", "table_count", "line", "source_system",
    "languages", "sheets_count", "rows_count", "hmi_text_rows_count", "unique_screen_paths_count", "units_found", "hmi_groups",
)


def knowledge_json(records: DataFrame) -> DataFrame:
    """doc_id, knowledge: a document's record as JSON, its fixed fields in their order, then the optional ones that it has.

    records (knowledge.knowledge_records over documents): title, source_path, checksum, converter, tags, document_kind,
    quality_status, source_file, fields (map), chunks_count, assets_count and whichever of the other fields there are."""
    have, fields = set(records.columns), F.coalesce("fields", F.create_map().cast("map<string,string>"))
    given = lambda name, default: (F.coalesce(F.col(name), default) if name in have else default).alias(name)
    own = F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("checksum"), F.col("checksum"), F.lit("converter"), F.col("converter"))
    count = lambda name: given(name, F.lit(0))
    counts = {name: count(name) for name in RECORD_COUNTS}
    pages = [counts["pages_count"], counts["text_pages_count"], counts["text_pages_count"].alias("pages_with_text_count"), counts["rendered_pages_count"]]
    chunks = [*[counts[n] for n in ("text_chunks_count", "image_chunks_count", "page_chunks_count")], counts["image_chunks_count"].alias("image_only_chunks_count"), *[counts[n] for n in RECORD_COUNTS[6:9]]]
    lists = lambda name: given(name, F.array().cast("array<string>"))
    fixed = F.struct(
        "title", given("summary", F.lit("")), F.map_concat(own, fields).alias("key_metadata"), lists("tags"), "document_kind", "quality_status", given("extraction_status", F.lit("text")), given("requires_ocr_or_vision", F.lit(False)),
        "chunks_count", "assets_count", *pages, *chunks, lists("section_outline"), *[counts[n] for n in RECORD_COUNTS[9:14]], counts["drawing_index_count"], lists("drawing_index"), counts["embedded_images_count"],
        given("embedded_image_detected", F.lit(False)), counts["missing_assets_count"], "source_file",
    )
    optional = F.map_filter(fields, lambda k, _: k.isin(*OPTIONAL_FIELDS))
    ordered = F.map_from_entries(F.filter(F.transform(F.array(*map(F.lit, OPTIONAL_FIELDS)), lambda n: F.struct(n.alias("key"), F.try_element_at(optional, n).alias("value"))), lambda e: F.map_contains_key(optional, e["key"])))
    base, more = F.to_json(fixed, {"ignoreNullFields": "false"}), F.to_json(ordered)
    whole = F.when(F.size(optional) > 0, F.concat(F.regexp_replace(base, r"\}$", ""), F.lit(","), F.substring(more, 2, 1 << 30))).otherwise(base)
    return records.select("doc_id", whole.alias("knowledge"))
