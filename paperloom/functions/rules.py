"""Ordered rules as data: each becomes one CASE, so the first that fits wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import vocabulary as V

Rules = list[tuple[str, tuple[str, ...]]]

SUPPORTED = ("pdf", "docx", "pptx", "xlsx", "doc", "ppt", "xls", "html", "htm", "txt", "md", "csv", "json")
LEGACY = ("doc", "ppt", "xls")


def first_rule(text: Column, rules: Rules, default: str | None) -> Column:
    """The label of the first rule with a needle in the text (already normalised)."""
    out = None
    for label, needles in rules:
        hit = _any(text, needles)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def all_rules(text: Column, rules: Rules) -> Column:
    """The labels of all rules with a needle in the text, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(_any(text, needles), F.lit(label)) for label, needles in rules])))


def _any(text: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def _path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Folders (parted by spaces), name and suffix of a path, ready to be classified."""
    name = T.classification_text(T.file_name(path))
    folders = T.classification_text(F.translate(F.regexp_extract(path, r"^(.*)[/\\]", 1), "/\\", "  "))
    return folders, name, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def document_kind(path: Column, markdown: Column) -> Column:
    """A PDF's kind by its name, its folders, its content, its name and stem together, a maker's name in it; other files' by
    suffix and words."""
    folders, name, suffix = _path_parts(path)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    content = T.classification_text(F.coalesce(markdown, F.lit("")))
    twice = F.concat(name, F.lit(" "), stem)
    component = F.when(twice.rlike(V.COMPONENT_NAME), F.lit("component_document_pdf"))
    rules = (first_rule(name, V.NAME_KINDS, None), first_rule(folders, V.FOLDER_KINDS, None), first_rule(content, V.CONTENT_KINDS, None), first_rule(twice, V.NAME_KINDS, None))
    return F.when(suffix == "pdf", F.coalesce(*rules, component, F.lit("generic_pdf"))).otherwise(office_kind(path, markdown))


def office_kind(path: Column, markdown: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    text = F.lower(F.concat_ws("\n", T.file_name(path), F.coalesce(markdown, F.lit(""))))

    def kind(t: Column) -> Column:
        out = F.when((suffix == "xlsx") & (translation_score(t) >= V.TRANSLATION_LEAST), F.lit("hmi_translation_xlsx"))
        for own, needles, label in V.OFFICE_KINDS:
            out = out.when((suffix == own) & _any(t, needles), F.lit(label))
        return out.otherwise(F.lit("document"))

    return T.let(text, kind)


def translation_score(text: Column) -> Column:
    """How much speaks for a translation table; text: lower-cased."""
    every = F.lit(True)
    for header in V.TRANSLATION_HEADERS:
        every = every & F.contains(text, F.lit(header))
    marks = F.regexp_count(text, F.lit(V.TRANSLATION_MARK)) >= V.TRANSLATION_MARKS
    weighted = ((_any(text, V.TRANSLATION_NAMES), V.TRANSLATION_NAME_WEIGHT), (every, V.TRANSLATION_HEADERS_WEIGHT), (marks, V.TRANSLATION_MARK_WEIGHT), (_any(text, V.TRANSLATION_PARTS), V.TRANSLATION_PART_WEIGHT))
    return sum((F.when(hit, F.lit(weight)).otherwise(F.lit(0)) for hit, weight in weighted), F.lit(0))


def tags(path: Column, kind: Column, quality: Column) -> Column:
    """array<string>, each once: by the path's words, the suffix, quality and kind, in this order."""
    text = T.classification_text(path)
    by_path = all_rules(text, [(tag, (needle,)) for needle, tag in V.PATH_TAGS])
    mapped = lambda value, names: F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in names.items()])
    suffix = T.blank_to_null(F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))
    none = F.array().cast("array<string>")
    office = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in V.OFFICE_TAGS.items()], none)

    def whole(own: Column) -> Column:
        mechanical = F.when(F.arrays_overlap(own, F.array(*map(F.lit, V.MECHANICAL_TAGS))), F.lit(V.MECHANICAL_TAG))
        return F.array_distinct(F.concat(own, F.array_compact(F.array(mechanical, suffix, mapped(quality, V.QUALITY_TAGS), mapped(kind, V.DRAWING_TAG), mapped(kind, V.KIND_TAGS))), office))

    return T.let(by_path, whole)


def page_title(text: Column) -> Column:
    """What a page is, by its words: title page, contents, revisions, then the first rule that fits; null if none does."""

    def named(t: Column) -> Column:
        words = sum((F.contains(t, F.lit(w)).cast("int") for w in V.TITLE_PAGE_WORDS), F.lit(0))
        manual = F.contains(t, F.lit(V.TITLE_PAGE_MANUAL)) & _any(t, V.TITLE_PAGE_NUMBERS)
        lines = F.filter(F.transform(F.split(t, r"\n|\r\n?"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 120))
        entries = F.size(F.filter(lines, lambda x: x.rlike(r"^\d+(?:\.\d+)*\s+\S+") & (x.rlike(r"\s\d{1,4}$") | F.contains(x, F.lit("...")) | F.contains(x, F.lit(". . .")))))
        return (
            F.when(manual | (words >= 2), F.lit("Title Page"))
            .when(F.contains(t, F.lit("table of contents")) | (entries >= 3), F.lit("Table of Contents"))
            .when(_any(t, V.REVISION_WORDS), F.lit("Revision Overview"))
            .otherwise(first_rule(t, [(title, (needle,)) for needle, title in V.PAGE_TITLES], None))
        )

    return T.let(F.lower(F.coalesce(text, F.lit(""))), named)


def additive_kind(text: Column, weights: list[tuple[str, int]], least: int, kind: str, otherwise: Column) -> Column:
    """A kind that enough weighted needles speak for."""
    score = sum((F.when(F.contains(text, F.lit(n)), F.lit(w)).otherwise(F.lit(0)) for n, w in weights), F.lit(0))
    return F.when(score >= least, F.lit(kind)).otherwise(otherwise)


def refine_generic(kind: Column, source_file: Column, text: Column) -> Column:
    """A generic PDF is classified again by its name and its text's start when a library is built."""
    again = document_kind(source_file, F.substring(text, 1, 4000))
    return F.when((kind == "generic_pdf") & F.lower(source_file).endswith(".pdf"), again).otherwise(kind)


def quality_status(suffix: Column, markdown: Column, fallback: Column, elements: Column, kind: Column, pages: Column, text_pages: Column) -> Column:
    """A PDF without headings, converted by the fallback, or without pages and elements has low structure; drawings have it always,
    translation tables are structured with noise; a PDF with pages and no text on any is visual only."""
    pdf = F.lower(suffix) == "pdf"
    headed = F.coalesce(markdown, F.lit("")).rlike(r"(?m)^\s*#")
    low = pdf & (~headed | F.coalesce(fallback, F.lit(False)) | (F.coalesce(elements, F.lit(0)) == 0))
    return (
        F.when(pdf & (F.coalesce(pages, F.lit(0)) > 0) & (F.coalesce(text_pages, F.lit(0)) == 0), F.lit("visual_only"))
        .when(kind == "hmi_translation_xlsx", F.lit("structured_with_noise"))
        .when((kind == "technical_drawing_pdf") | low, F.lit("low_structure"))
        .otherwise(F.lit("ok"))
    )


def evidence_type(own: Column, page: Column, image: Column, page_text: Column, heading_path: Column | None = None) -> Column:
    """The kind of evidence: kept if it is a known one, else by page, image and the page's text."""
    has_text = F.trim(F.coalesce(page_text, F.lit(""))) != ""
    imaged, metadata = F.coalesce(image, F.lit("")) != "", F.lit(False) if heading_path is None else F.coalesce(heading_path == F.array(F.lit("Key Metadata")), F.lit(False))
    return (
        F.when(own.isin(V.EVIDENCE_TYPES), own)
        .when(imaged, F.when(has_text, F.lit("page")).otherwise(F.lit("image")))
        .when(page.isNotNull(), F.when(has_text, F.lit("text_page")).otherwise(F.lit("page")))
        .when(metadata, F.lit("metadata"))
        .otherwise(F.lit("text"))
    )


def result_status(window: Column, title: Column | None = None) -> Column:
    """The first result that the window states, in its usual name; empty without one, and on slides that assess risks."""

    def named(value: Column) -> Column:
        out = F.when(value == "", F.lit(""))
        for pattern, name in V.RESULT_NAMES:
            out = out.when(value.rlike(f"(?i){pattern}"), F.lit(name))
        return out.otherwise(value)

    def status(text: Column) -> Column:
        found = F.coalesce(*[T.blank_to_null(F.regexp_extract(text, f"(?iU)({p})", 1)) for p in V.RESULTS], F.lit(""))
        return T.let(T.collapse(found), named)

    out = T.let(T.collapse(F.coalesce(window, F.lit(""))), status)
    return out if title is None else F.when(F.coalesce(title, F.lit("")).rlike(f"(?i){V.RISK_TITLE}"), F.lit("")).otherwise(out)


def result_confidence(window: Column, status: Column, title: Column) -> Column:
    """high with a result, medium with a batch's figures or route, else low."""
    risk = F.coalesce(title, F.lit("")).rlike(f"(?i){V.RISK_TITLE}")
    return F.when((status != "") & ~risk, F.lit("high")).when(window.rlike(f"(?iU){V.BATCH_EVIDENCE}"), F.lit("medium")).otherwise(F.lit("low"))


def slide_topic(title: Column, text: Column) -> Column:
    """A slide's topic by its title, else by title and text."""
    whole = F.lower(F.concat(title, F.lit("\n"), text))
    return F.coalesce(first_rule(F.lower(title), V.TITLE_TOPICS, None), T.let(whole, lambda t: first_rule(t, V.TEXT_TOPICS, None)), F.lit(V.NO_TOPIC))


def visual_heavy(title: Column, text: Column) -> Column:
    """Whether a slide says more by pictures than by words."""
    return T.let(F.lower(F.concat(title, F.lit("\n"), text)), lambda t: _any(t, V.VISUAL_WORDS)) | text.rlike(r"!\[[^\]]*\]\([^)]+\)")


def engine(extension: Column, chosen: str = "auto") -> Column:
    """The reader of a file: the one chosen, else by kind."""
    if chosen != "auto":
        return F.lit(chosen)
    return F.when(extension == "pdf", F.lit("layout")).when(extension.isin(*SUPPORTED), F.lit("text")).otherwise(F.lit("layout"))


def unsupported_reason(name: Column, extension: Column) -> Column:
    return (
        F.when(name.startswith("~$"), F.lit("office lock file"))
        .when(name.startswith("."), F.lit("hidden file"))
        .when(extension == "unknown", F.lit("file has no extension"))
        .when(~extension.isin(*SUPPORTED), F.concat(F.lit("unsupported extension ."), extension))
    )
