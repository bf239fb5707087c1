"""Per-document knowledge: metadata, outlines, narratives, records and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

OUTLINE_MOST = 40
#: Labels of a title page and the fields they fill.
TITLE_LABELS = {"project": "project", "customer": "customer", "document no.": "document_number", "revision": "revision", "date": "date", "author": "author"}


def title_metadata(lines: DataFrame, labels: dict[str, str] = TITLE_LABELS, ahead: int = 4) -> DataFrame:
    """doc_id, field, value from the lines (doc_id, line_number, line) of a title page: what follows a label in its line, else
    the next of up to four lines that is no label itself."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_number")
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = F.lower(F.regexp_extract("line", r"^\s*([^:]+?)\s*(?::|$)", 1))
    inline = T.blank_to_null(F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)))
    marked = lines.withColumns({"_field": F.try_element_at(names, label), "_inline": inline})
    plain = marked.withColumn("_plain", F.when(F.col("_field").isNull() & (F.trim("line") != ""), F.trim("line")))
    following = F.first("_plain", ignorenulls=True).over(order.rowsBetween(1, ahead))
    found = plain.withColumn("value", F.coalesce("_inline", following)).filter("_field is not null and value is not null")
    return found.groupBy("doc_id", F.col("_field").alias("field")).agg(F.min_by("value", "line_number").alias("value"))


def extract_fields(docs: DataFrame, rules: dict[str, dict[str, list[str]]], kind: str = "document_kind", text: str = "markdown") -> DataFrame:
    """doc_id, fields (map): for each kind its fields, each by the first of its patterns that matches (group 1)."""
    out = F.create_map().cast("map<string,string>")
    for name, fields in rules.items():
        pairs = [x for f, patterns in fields.items() for x in (F.lit(f), T.first_match(F.col(text), patterns))]
        out = F.when(F.col(kind) == name, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())).otherwise(out)
    return docs.select("doc_id", out.alias("fields"))


def outline(toc: DataFrame, most: int = OUTLINE_MOST) -> DataFrame:
    """doc_id, outline: the sections of a table of contents as a Markdown list, indented by depth, each once."""
    depth = F.size(F.split("section_number", r"\.")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), "section_number", F.lit(" "), "title")
    rows = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"])), 1, most)
    return toc.groupBy("doc_id").agg(F.array_join(rows, "\n").alias("outline"))


def narrative(conditions: dict[str, Column], always: str) -> Column:
    """Bullets for what holds, and one that always stands."""
    return F.concat_ws("\n", *[F.when(c, F.lit(f"- {text}")) for text, c in conditions.items()], F.lit(f"- {always}"))


def document_body(docs: DataFrame) -> DataFrame:
    """doc_id, markdown: title, metadata table and body of a document (title, document_kind, fields, markdown)."""
    rows = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), e["value"], F.lit(" |"))), "\n")
    table = F.when(F.size("fields") > 0, F.concat(F.lit("| field | value |\n|---|---|\n"), rows, F.lit("\n\n"))).otherwise("")
    return docs.select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\nKind: "), F.col("document_kind"), F.lit("\n\n"), table, F.coalesce("markdown", F.lit(""))).alias("markdown"))


#: Counts of a record by the kind of evidence.
EVIDENCE_COUNTS = {
    "image_chunks_count": ("image",), "page_chunks_count": ("page", "text_page"), "section_chunks_count": ("section",), "slide_chunks_count": ("slide",),
    "table_chunks_count": ("table",), "topic_chunks_count": ("topic",), "batch_study_chunks_count": ("batch_study",), "drawing_index_count": ("drawing_index",),
}


def knowledge_records(documents: DataFrame, chunks: DataFrame, assets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One record for each document: its fields and the counts of what belongs to it. pages: doc_id, text, image_path."""
    kinds = [F.count_if(F.col("evidence_type").isin(*v)).alias(k) for k, v in EVIDENCE_COUNTS.items()]
    located, filled = F.coalesce("locator", F.lit("")) != "", F.trim(F.coalesce("text", F.lit(""))) != ""
    c = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks_count"), F.count_if(located).alias("located_chunks"), F.count_if(F.col("page_number").isNotNull()).alias("page_chunks"),
        F.count_distinct("evidence_type").alias("evidence_types"), F.sum(F.length("text")).alias("text_chars"), F.count_if(F.col("evidence_type").isin("page", "text_page") & filled).alias("searchable_page_chunks_count"),
        F.count_if((F.col("evidence_type") == "section") & filled).alias("section_chunks_with_body_count"), *kinds,
    )
    a = assets.groupBy("doc_id").agg(F.count("*").alias("assets_count"))
    out, counts = documents.join(c, "doc_id", "left").join(a, "doc_id", "left"), [x for x in (*c.columns, *a.columns) if x != "doc_id"]
    if pages is not None:
        p = pages.groupBy("doc_id").agg(F.count("*").alias("pages_count"), F.count_if(filled).alias("text_pages_count"), F.count_if(F.coalesce("image_path", F.lit("")) != "").alias("rendered_pages_count"))
        out, counts = out.join(p, "doc_id", "left"), counts + [x for x in p.columns if x != "doc_id"]
    return out.na.fill(0, counts).withColumn("text_chunks_count", F.greatest(F.col("chunks_count") - F.col("image_chunks_count"), F.lit(0)))


def page_counters(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("pages_with_text"), F.count_if(F.col("image_path").isNotNull()).alias("pages_with_image"), F.sum(F.coalesce("text_char_count", F.lit(0))).alias("text_chars"))


def page_text_limit(kind: Column, pages: Column, all_pages: bool, most_text: int | None, most_rendered: int | None) -> Column:
    """How many pages' text is read: all if asked for, else the cap, else all of a manual, else as many as are rendered."""
    if all_pages:
        return pages
    if most_text is not None:
        return F.least(pages, F.lit(most_text))
    return F.when(kind == "manual_pdf", pages).otherwise(F.least(pages, F.lit(most_rendered)) if most_rendered is not None else pages)


def semantic_titles(pages: DataFrame, rules: list[tuple[str, str]] | None = None, document_title: str = "document_title") -> DataFrame:
    """Adds semantic_title: what a page's words say (or the first of other rules, (title, needle), that fits); else the document's
    title on its first page only."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")) == 1
    own = R.page_title(F.col("text")) if rules is None else F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(n)), F.lit(t)) for t, n in rules], F.lit(None).cast("string"))
    return pages.withColumn("semantic_title", F.coalesce(own, F.when(first, F.col(document_title))))


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """path, page_number, text, error of PDF files (path, content), where a PDF library is installed; else an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz
        except ImportError:
            fitz = None
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                if fitz is None:
                    rows.append((path, None, None, "no PDF library is installed"))
                    continue
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                        rows += [(path, k, page.get_text(), None) for k, page in enumerate(pdf, 1)]
                except Exception as error:  # a broken file is a row
                    rows.append((path, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")


#: Enrichment of a text by name; none is on by default.
ENRICHERS: dict[str, Callable[[str], str]] = {}


def enrich_text(docs: DataFrame, enricher: str | None) -> DataFrame:
    """Adds enriched and enrich_warning; an enricher that isn't there leaves a warning."""
    none = F.lit(None).cast("string")
    if enricher is None:
        return docs.withColumns({"enriched": none, "enrich_warning": none})
    if enricher not in ENRICHERS:
        return docs.withColumns({"enriched": none, "enrich_warning": F.lit(f"no enricher named {enricher}")})
    run = ENRICHERS[enricher]

    @F.pandas_udf("string")
    def apply(text: pd.Series) -> pd.Series:
        return text.map(lambda t: run(t) if t else None)

    return docs.withColumns({"enriched": apply("markdown"), "enrich_warning": none})
