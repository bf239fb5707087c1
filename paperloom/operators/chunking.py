"""From documents to provenance-tracked chunks.

Sections, packing and pages are column expressions: a document's lines are folded inside its row, so nothing is shuffled and a
long document never meets another one's lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import vocabulary as V

#: Sizes of chunks and of what is read for them.
SECTION_CHARS, PAGE_CHARS, SINGLE_CHARS = 1600, 2500, 1600
BODY_LINES, BODY_CHARS, TOC_MOST, DRAWING_MOST = 24, 2500, 200, 200
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
SLIDE_MARK = r"<!--\s*Slide number:\s*(\d+)\s*-->"
_SECTION = "struct<headings: array<string>, text: string>"


def pack(paragraphs: Column, most: int, between: str = "\n\n") -> Column:
    """array<string>: paragraphs joined greedily up to `most` characters; a longer one is cut hard."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def add(acc: Column, p: Column) -> Column:
        joined = F.when(acc["current"] == "", p).otherwise(F.concat(acc["current"], F.lit(between), p))
        closed = F.when(acc["current"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["current"]))
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / most).cast("int") - 1), lambda k: F.substr(p, k * most + 1, F.lit(most)))
        return (
            F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("current")))
            .when(F.length(p) <= most, F.struct(closed.alias("done"), p.alias("current")))
            .otherwise(F.struct(F.concat(closed, pieces).alias("done"), F.lit("").alias("current")))
        )

    return F.aggregate(paragraphs, empty, add, lambda acc: F.when(acc["current"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["current"])))


def sections(markdown: Column) -> Column:
    """array<struct<headings, text>>. A heading of level n stands below the first n - 1 of the path so far, cut by length, so
    after a skipped level the next heading of the same level is a child of the one before."""
    start = F.struct(
        F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("lines"),
        F.array().cast(f"array<{_SECTION}>").alias("done"),
    )

    def close(acc: Column) -> Column:
        text = F.regexp_replace(F.array_join(acc["lines"], "\n"), r"^\s+|\s+$", "")
        return F.when(text == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["path"].alias("headings"), text.alias("text"))))

    def line(acc: Column, x: Column) -> Column:
        level, title = F.length(F.regexp_extract(x, HEADING, 1)), F.regexp_extract(x, HEADING, 2)
        path = F.array_append(F.slice(acc["path"], 1, level - 1), title)
        new = F.struct(path.alias("path"), F.array(x).alias("lines"), close(acc).alias("done"))
        return F.when(level > 0, new).otherwise(F.struct(acc["path"].alias("path"), F.array_append(acc["lines"], x).alias("lines"), acc["done"].alias("done")))

    return F.aggregate(F.split(markdown, "\r\n|\r|\n"), start, line, close)


def numbered_id(slug: Column, number: Column) -> Column:
    return F.concat(slug, F.lit("_"), F.lpad(number.cast("string"), 4, "0"))


def chunk_markdown(docs: DataFrame, most: int = SECTION_CHARS) -> DataFrame:
    """doc_id, chunk_id (slug and number), position, heading_path, text, char_count from docs (doc_id, slug, markdown, ...)."""

    def parts(section: Column) -> Column:
        text = section["text"]
        packed = F.when(F.length(text) <= most, F.array(text)).otherwise(pack(F.split(text, r"\n\s*\n"), most))
        return F.transform(packed, lambda p: F.struct(section["headings"].alias("headings"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("text")))

    own = F.filter(F.flatten(F.transform(sections(F.coalesce("markdown", F.lit(""))), parts)), lambda x: x["text"] != "")
    cut = docs.select("doc_id", "slug", F.posexplode(own).alias("position", "c"))
    return cut.select(
        "doc_id", numbered_id(F.col("slug"), F.col("position") + 1).alias("chunk_id"), "position",
        F.col("c.headings").alias("heading_path"), F.col("c.text").alias("text"), F.length("c.text").alias("char_count"),
    )


def pack_lines(docs: DataFrame, most: int = SECTION_CHARS) -> DataFrame:
    """doc_id, position, text: a text's lines packed into chunks, for texts without headings or paragraphs."""
    cut = docs.select("doc_id", F.posexplode(pack(F.split(F.coalesce("text", F.lit("")), "\n"), most, "\n")).alias("position", "text"))
    return cut.withColumn("char_count", F.length("text"))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """One chunk for each page (doc_id, slug, page_number, semantic_title, locator, image_path, text, whole_text); a page
    without text takes the whole document's."""
    body = T.clip(T.first_filled(T.collapse("text"), F.col("whole_text")), PAGE_CHARS)
    title = F.coalesce("semantic_title", F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    lines = F.concat_ws("\n", title, F.concat(F.lit("Locator: "), F.col("locator")), F.concat(F.lit("Image: "), F.col("image_path")), F.concat(F.lit("Extracted text: "), body))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    return pages.select("doc_id", numbered_id(F.col("slug"), number).alias("chunk_id"), "page_number", "locator", F.array(title).alias("heading_path"), lines.alias("text"), F.length(lines).alias("char_count"))


def single_chunk(docs: DataFrame) -> DataFrame:
    """For documents without pages: the start of the text as one chunk."""
    text = F.substring("markdown", 1, SINGLE_CHARS)
    return docs.select("doc_id", numbered_id(F.col("slug"), F.lit(1)).alias("chunk_id"), F.array(F.lit("Extracted text")).alias("heading_path"), text.alias("text"), F.length(text).alias("char_count"))


def merge_pages(text_pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Full outer merge on (doc_id, page_number): what is rendered wins, but a text page keeps its text, count and title."""
    t, r = text_pages.alias("t"), rendered.alias("r")
    both = t.join(r, ["doc_id", "page_number"], "full_outer")
    has_text = F.coalesce("t.text", F.lit("")) != ""
    keep = lambda c: F.when(has_text, F.col(f"t.{c}")).otherwise(F.coalesce(f"r.{c}", f"t.{c}")).alias(c)
    win = lambda c: F.coalesce(f"r.{c}", f"t.{c}").alias(c)
    return both.select("doc_id", "page_number", keep("text"), keep("text_char_count"), keep("semantic_title"), win("locator"), win("image_path"))


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_number, line: the filled lines of pages, single-spaced."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    return pages.select("doc_id", "page_number", F.posexplode(lines).alias("line_number", "line"))


def toc_entries(pages: DataFrame, most: int = TOC_MOST) -> DataFrame:
    """doc_id, section_number, title, page_hint of table-of-contents lines; a title and its page may stand on two lines."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("line_number")
    pattern = r"^(\d+(?:\.\d+)*)\.?\s+(.+?)[\s.]+(\d{1,4})$"
    two = F.concat_ws(" ", "line", F.lead("line").over(order))
    entry = F.when(F.col("line").rlike(pattern), F.col("line")).when(F.col("_two").rlike(pattern) & F.col("line").rlike(r"^\d+(?:\.\d+)*\.?\s+\D+$"), F.col("_two"))
    found = page_lines(pages).withColumn("_two", two).withColumn("_e", entry).filter("_e is not null")
    named = found.select(
        "doc_id", "page_number", "line_number", F.regexp_extract("_e", pattern, 1).alias("section_number"),
        F.regexp_extract("_e", pattern, 2).alias("title"), F.regexp_extract("_e", pattern, 3).cast("int").alias("page_hint"),
    )
    first = Window.partitionBy("doc_id", "section_number").orderBy("page_number", "line_number")
    kept = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rank = Window.partitionBy("doc_id").orderBy("page_number", "line_number")
    return kept.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= most)


def section_chunks(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Bodies of the sections that the table of contents names: the lines from the heading on, one body for each section."""
    own = page_lines(pages)
    ahead = Window.partitionBy("doc_id", "page_number").orderBy("line_number").rowsBetween(0, BODY_LINES - 1)
    lines = own.withColumn("body", F.substring(F.array_join(F.collect_list("line").over(ahead), "\n"), 1, BODY_CHARS))
    number, title = F.regexp_extract("line", r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 1), F.lower(F.regexp_extract("line", r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 2))
    headed = lines.withColumns({"section_number": number, "_title": title}).filter("section_number != '' and _title != ''")
    t = toc.select("doc_id", "section_number", F.lower("title").alias("_toc"), F.col("title").alias("section_title"), F.col("page_number").alias("_toc_page"))
    met = headed.join(t, ["doc_id", "section_number"]).filter("page_number != _toc_page and (startswith(_toc, _title) or startswith(_title, _toc))")
    first = Window.partitionBy("doc_id", "section_number").orderBy("page_number", "line_number")
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "section_number", "section_title", "page_number", F.col("body").alias("text"))


def drawing_index(pages: DataFrame, most: int = DRAWING_MOST) -> DataFrame:
    """Records of five lines (code, editor, description, type, date) on contents pages. The cursor goes on by five lines after
    a record, else by one, so it is a fold over a page's lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    heads = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (F.lower(F.get("_l", i)) == "page") & (i + 4 < F.size("_l")))
    begin = F.coalesce(F.get(heads, F.lit(0)) + 1, F.lit(0))
    record = "struct<page_code: string, edited_by: string, page_description: string, page_type: string, date: string>"

    def step(acc: Column, i: Column) -> Column:
        at = [F.get("_l", i + k) for k in range(5)]
        fits = (i >= acc["next"]) & F.coalesce((at[0].startswith("/") | at[0].startswith("+")) & at[4].rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.lit(False))
        own = F.struct(*[x.alias(n) for x, n in zip(at, ("page_code", "edited_by", "page_description", "page_type", "date"))])
        return F.when(fits, F.struct((i + 5).alias("next"), F.array_append(acc["found"], own).alias("found"))).otherwise(acc)

    zero = F.struct(begin.cast("int").alias("next"), F.array().cast(f"array<{record}>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.size("_l") - 1), zero, step, lambda acc: acc["found"])
    own = pages.filter(F.contains(F.lower("text"), F.lit("table of contents"))).withColumn("_l", lines).filter("size(_l) > 4")
    listed = own.select("doc_id", F.col("page_number").alias("source_page"), "locator", F.posexplode(found).alias("_k", "e")).select("doc_id", "source_page", "locator", "_k", "e.*")
    order = Window.partitionBy("doc_id").orderBy("source_page", "_k")
    named = F.concat(F.lit("Table of Contents / "), F.coalesce("locator", F.concat(F.lit("Page "), F.col("source_page").cast("string"))))
    return listed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).withColumn("locator", named).drop("_k")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slide_title(text: Column) -> Column:
    """A slide's title: the first known title among its first lines, else the first line that looks like one; else null."""

    def clean(line: Column) -> Column:
        return F.regexp_replace(T.collapse(F.regexp_replace(line, r"^[\s#]+|[\s#]+$", "")), r"^[ -]+|[ -]+$", "")

    def noise(line: Column) -> Column:
        low = F.lower(line)
        starts = reduce(lambda a, b: a | b, (low.startswith(x) for x in V.SLIDE_NOISE_STARTS))
        return (
            low.rlike(r"^\d*$") | low.isin(*V.SLIDE_NOISE) | low.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$") | starts
            | (F.contains(low, F.lit(V.SLIDE_NOISE_PROJECT)) & (F.length(low) < 90))
        )

    def title(lines: Column) -> Column:
        known = [F.when(F.exists(F.slice(lines, 1, 12), _matches(rf"(?iU)\b{name}\b")), F.lit(name)) for name in V.SLIDE_TITLES]
        likely = F.filter(
            F.slice(lines, 1, 10),
            lambda x: (F.length(x) <= 80) & ~F.contains(x, F.lit("|")) & ~x.startswith("!") & (F.size(F.split(x, " ")) <= 8) & x.rlike("[A-Za-z]"),
        )
        return F.coalesce(*known, F.get(likely, F.lit(0)))

    lines = F.filter(F.transform(F.split(text, r"\r\n?|\n"), clean), lambda x: ~noise(x))
    return T.let(lines, title)


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


#: Where a presentation's project is named.
PROJECT_NAMES = [r"(?i)Project name:\s*([^\n]+)", r"(?i)(LS Daily Rescue Eye Serum)"]


def slides(docs: DataFrame, projects: list[str] = PROJECT_NAMES) -> DataFrame:
    """doc_id, slide_number, title, topic, visual, locator, text of the slides that the marks in `markdown` part; empty ones are
    dropped. A slide without a title takes the project's name, else its number."""
    parts = F.split("markdown", SLIDE_MARK)
    both = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(SLIDE_MARK), F.lit(1)).alias("number"), F.slice(parts, 2, F.size(parts)).alias("text"))
    project = T.first_match(F.col("markdown"), projects)
    found = docs.select("doc_id", T.collapse(project).alias("_project"), F.posexplode(both).alias("_k", "s")).withColumns({"slide_number": F.col("s.number").cast("int"), "text": _stripped(F.col("s.text"))}).filter("text != ''")
    titled = found.withColumn("title", F.coalesce(slide_title(F.col("text")), "_project", F.concat(F.lit("Slide "), F.col("slide_number").cast("string"))))
    return titled.select(
        "doc_id", "slide_number", "title", R.slide_topic(F.col("title"), F.col("text")).alias("topic"), R.visual_heavy(F.col("title"), F.col("text")).alias("visual"),
        F.concat(F.lit("Slide "), F.col("slide_number").cast("string")).alias("locator"), "text",
    )


def topics(slide_rows: DataFrame, topic_order: list[str] = V.TOPIC_ORDER) -> DataFrame:
    """Slides (doc_id, slide_number, topic, text) by topic, in the given order: number range and joined text."""
    place = F.array_position(F.array(*map(F.lit, topic_order)), F.col("topic")) if topic_order else F.lit(0)
    grouped = slide_rows.groupBy("doc_id", "topic").agg(F.array_sort(F.collect_list(F.struct("slide_number", "text"))).alias("s"))
    return grouped.select("doc_id", "topic", place.alias("position"), F.size("s").alias("slide_count"), T.range_locator(F.col("s.slide_number")).alias("locator"), F.array_join("s.text", "\n\n").alias("text"))


def batch_window(text: Column, value: Column) -> Column:
    """The lines from the first one with the value on, six at most; before it, if it is the last line."""

    def window(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.contains(x, value)), True).cast("int")
        after, before = F.slice(lines, F.greatest(at, F.lit(1)), 6), F.slice(lines, F.greatest(at - 3, F.lit(1)), F.least(at, F.lit(4)))
        return F.when(at == 0, F.substring(text, 1, 500)).when(F.size(after) > 1, F.array_join(after, "\n")).otherwise(F.array_join(before, "\n"))

    return _stripped(T.let(F.split(text, r"\r\n?|\n"), window))


def _batch_score(window: Column) -> Column:
    patterns = (r"\b\d+(?:\.\d+)?\s*kg\b", "Symex|M4E|Lee Trimix|Oevel", r"\b\d+\s*L\s*/?\s*min\b|speed|timer", "not feasible|feasible|pass|fail|stable|unstable|approved|challenge|issue")
    return sum((F.when(window.rlike(f"(?iU){p}"), 1).otherwise(0) for p in patterns), F.when(F.length(window) < 900, 1).otherwise(0))


def batch_candidates(slide_rows: DataFrame) -> DataFrame:
    """Mentions of batches on slides: from a slide's table of batches and results, else from the lines around the id."""
    ids = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?U){V.BATCH_ID}"), F.lit(0)))
    rows = F.transform(F.filter(F.transform(F.split("text", r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~F.contains(x, F.lit("---"))), T.row_cells)
    row_of = lambda *names: F.get(F.filter("_rows", lambda r: F.lower(F.get(r, F.lit(0))).isin(*names)), F.lit(0))
    own = slide_rows.withColumn("_rows", rows).withColumns({"_batch": row_of("batch"), "_result": row_of("results", "result"), "_purpose": row_of("batch purpose")})
    cell = lambda name, k: F.coalesce(F.get(F.col(name), k), F.lit(""))
    listed = F.when(
        F.col("_batch").isNotNull() & F.col("_result").isNotNull(),
        F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_batch") - 1, F.lit(1))), lambda k: F.transform(ids(cell("_batch", k)), lambda b: F.struct(b.alias("batch_id"), cell("_batch", k).alias("cell"), cell("_purpose", k).alias("purpose"), cell("_result", k).alias("result"))))),
    ).otherwise(F.array().cast("array<struct<batch_id:string,cell:string,purpose:string,result:string>>"))
    own = own.withColumn("_listed", listed)
    risk = F.col("title").rlike(f"(?i){V.RISK_TITLE}")
    snippet = F.array_join(F.filter(F.array("c.cell", "c.purpose", "c.result"), lambda x: x != ""), " | ")
    known = lambda x, names: F.array_join(T.present(x, list(names)), ", ")
    first = lambda x, *patterns: T.collapse(F.coalesce(*[T.blank_to_null(F.regexp_extract(x, f"(?iU)({p})", 1)) for p in patterns], F.lit("")))
    status = R.result_status(F.col("c.result"), F.col("title"))
    table = own.select("doc_id", "slide_number", "title", "locator", F.posexplode("_listed").alias("_k", "c")).select(
        "doc_id", F.col("c.batch_id").alias("batch_id"), F.struct("slide_number", F.lit(0).alias("part"), F.col("_k").alias("k")).alias("ord"), "slide_number", "locator",
        first(F.col("c.cell"), r"\b\d+(?:\.\d+)?\s*kg\b").alias("batch_size"), known(F.concat_ws(" ", "c.cell", "c.purpose"), V.BATCH_ROUTES).alias("route"),
        first(F.col("c.purpose"), r"\b\d+\s*L\s*/?\s*min\b", r"ventri speed[^|]*").alias("parameter"), status.alias("status"),
        F.when(status != "", "high").otherwise("medium").alias("confidence"), T.clip(snippet, 260).alias("snippet"), (F.lit(4) + _batch_score(snippet)).alias("score"),
    )
    loose = own.select("doc_id", "slide_number", "title", "locator", "text", F.posexplode(F.array_except(ids(F.col("text")), F.col("_listed.batch_id"))).alias("_k", "batch_id"))
    loose = loose.withColumn("w", batch_window(F.col("text"), F.col("batch_id")))
    stated, said = R.result_status(F.col("w"), F.col("title")), F.concat_ws("\n", "title", "w")
    priority = F.when(said.rlike("(?i)m4e pilot scale up|pilot scale up"), 8).when(said.rlike("(?i)batch|pilot summary|feasibility study for pilot"), 3).when(risk, -4).otherwise(0)
    confidence = R.result_confidence(F.col("w"), stated, F.col("title"))
    around = loose.select(
        "doc_id", "batch_id", F.struct("slide_number", F.lit(1).alias("part"), F.col("_k").alias("k")).alias("ord"), "slide_number", "locator",
        first(F.col("w"), r"\b\d+(?:\.\d+)?\s*kg\b").alias("batch_size"), known(F.col("w"), V.BATCH_ROUTES).alias("route"),
        first(F.col("w"), r"\b\d+\s*L\s*/?\s*min\b", r"M4E[^|\n]{0,80}(?:speed|timer)[^|\n]{0,80}", r"(?:Venturi|Ventri)\s*speed[^|\n]{0,80}", r"timer[^|\n]{0,80}").alias("parameter"),
        F.when(confidence != "low", stated).otherwise("").alias("status"), confidence.alias("confidence"), T.clip(F.col("w"), 260).alias("snippet"), (_batch_score(F.col("w")) + priority).alias("score"),
    )
    return table.unionByName(around)


def batch_studies(candidates: DataFrame) -> DataFrame:
    """One study for each (doc_id, batch_id) of batch_candidates(): the best by score and confidence, the first of equals; size,
    route and parameter that it lacks come from the next best; locators and slides are those of all."""
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    back = F.struct((-F.col("ord.slide_number")).alias("a"), (-F.col("ord.part")).alias("b"), (-F.col("ord.k")).alias("c"))
    best, next_best = F.struct("score", level.alias("level"), back.alias("back")), F.struct("score", back.alias("back"))
    filled = lambda name: F.coalesce(T.blank_to_null(F.max_by(name, best)), F.max_by(name, F.when(F.col(name) != "", next_best)), F.lit("")).alias(name)
    taken = [F.max_by(name, best).alias(name) for name in ("status", "confidence", "snippet", "slide_number", "locator")]
    return candidates.groupBy("doc_id", "batch_id").agg(
        *taken, *map(filled, ("batch_size", "route", "parameter")), F.max("score").alias("score"),
        F.transform(F.array_sort(F.collect_set(F.struct("slide_number", "locator"))), lambda x: x["locator"]).alias("locators"), F.array_sort(F.collect_set("slide_number")).alias("evidence_slides"),
    )


def _fits(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.lower(x).rlike(pattern)


def sheet_phases(docs: DataFrame, phases: dict[str, str]) -> DataFrame:
    """doc_id, phase, text: the lines of a sheet's first table that a phase's pattern fits."""
    rows = F.filter(F.split("markdown", "\n"), lambda x: F.trim(x).startswith("|"))
    own = docs.select("doc_id", rows.alias("_r"))
    parts = [own.select("doc_id", F.lit(name).alias("phase"), F.filter("_r", _fits(pattern)).alias("_m")) for name, pattern in phases.items()]
    return reduce(DataFrame.unionByName, parts).filter("size(_m) > 0").select("doc_id", "phase", F.array_join("_m", "\n").alias("text"))


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_number (from 2, the header being 1), cells (map of header to cell) of the first Markdown table."""
    lines = F.filter(F.split("markdown", "\n"), lambda x: F.trim(x).startswith("|"))
    header, body = T.row_cells(F.get("_l", F.lit(0))), F.slice(F.col("_l"), 3, F.size("_l"))
    own = docs.select("doc_id", lines.alias("_l")).filter("size(_l) > 2").select("doc_id", header.alias("_h"), F.posexplode(body).alias("_k", "_x"))
    cells = own.withColumn("_c", T.row_cells("_x")).filter("size(_c) = size(_h)")
    return cells.select("doc_id", (F.col("_k") + 2).alias("row_number"), F.map_from_arrays("_h", "_c").alias("cells"))


def translation_cell(value: Column) -> Column:
    """A cell of a translation table: underscores unescaped, repaired, single spaces, nothing for NaN."""
    clean = T.collapse(T.repaired(F.replace(value, F.lit("\\_"), F.lit("_")), V.SPOILT_CELLS))
    return F.when(F.lower(clean) == "nan", F.lit("")).otherwise(clean)


def path_parts(path: Column) -> Column:
    """The filled parts of a screen path, without the project that it begins with."""
    own = F.regexp_replace(translation_cell(path), r"(?i)^SY\d+_PLC\+HMI_V\d+\\", "")
    return F.filter(F.transform(F.split(own, r"\\"), lambda x: F.regexp_replace(x, "^[_ ]+|[_ ]+$", "")), lambda x: x != "")


def group_path(path: Column, most: int = 2) -> Column:
    """The first meaningful parts of a screen path: structure is left out, and a field ends it once it has begun."""
    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        skipped = x.startswith("SY") | F.contains(x, F.lit("(HMI)")) | F.lower(x).isin(*V.GROUP_STRUCTURE)
        ends = x.rlike(f"(?iU){V.GROUP_FIELDS}") | x.rlike(f"(?iU)^(?:{V.GROUP_ENDS})$")
        over = acc["over"] | (~skipped & ends & (F.size(acc["kept"]) > 0)) | (F.size(acc["kept"]) >= most)
        return F.struct(over.alias("over"), F.when(over | skipped | ends, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"))

    kept = F.aggregate(path_parts(path), start, step, lambda acc: F.array_join(acc["kept"], " / "))
    return F.coalesce(T.blank_to_null(kept), F.lit(V.GROUP_DEFAULT))


def translation_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_number (the rows that count, from 2), group_path, field, path_tail, english, chinese, unit of a translation
    table in `markdown`: rows of screens with a path and a text."""
    lines = F.filter(F.split(F.coalesce("markdown", F.lit("")), r"\r\n?|\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^\|\s*-+"))
    cells = F.transform(lines, lambda x: F.transform(T.row_cells(x), translation_cell))
    own = docs.select("doc_id", cells.alias("_c")).filter("size(_c) > 1")
    header = F.transform(F.get("_c", F.lit(0)), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\\?\*", ""))))
    named = own.select("doc_id", header.alias("_h"), F.posexplode(F.slice(F.col("_c"), 2, F.size("_c"))).alias("_k", "_row")).filter("size(_row) >= 6")

    def cell(name: str) -> Column:
        return F.coalesce(F.get("_row", F.array_position("_h", name).cast("int") - 1), F.lit(""))

    path, english, chinese, category = cell("viewpath"), cell("en-gb"), cell("zh-cn"), F.lower(cell("category"))
    counted = named.filter((path != "") & ((english != "") | (chinese != "")) & ((category == "") | F.contains(category, F.lit(V.TRANSLATION_MARK))))
    field = F.try_element_at(F.filter(path_parts(path), lambda x: ~x.rlike(f"(?iU)^(?:{V.FIELD_NAMELESS})$")), F.lit(-1))
    unit = F.coalesce(*[F.when(F.trim(x).isin(*V.UNITS), F.trim(x)) for x in (english, chinese)], F.lit(""))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_k")) + 1  # rows of one document's table
    parts = path_parts(path)
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 4), " / ")
    return counted.select(
        "doc_id", number.alias("row_number"), group_path(path).alias("group_path"), F.coalesce(field, F.lit(V.FIELD_DEFAULT)).alias("field"), tail.alias("path_tail"),
        english.alias("english"), chinese.alias("chinese"), unit.alias("unit"),
    )


def row_groups(rows: DataFrame, most: int = V.GROUP_LINES) -> DataFrame:
    """doc_id, group_path, row_count, row_start, row_end, text of rows (doc_id, row_number, group_path, line): the first `most`
    lines of each group."""
    rank = Window.partitionBy("doc_id", "group_path").orderBy("row_number")
    kept = rows.withColumn("_n", F.row_number().over(rank))
    return kept.groupBy("doc_id", "group_path").agg(
        F.count("*").alias("row_count"), F.min("row_number").alias("row_start"), F.max("row_number").alias("row_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("row_number", "line")))), lambda x: x["line"]), "\n").alias("text"),
    )


_CHUNK = ["doc_id", "part", "ord", "heading_path", "text", "evidence_type", "provenance_status", "locator"]


def _chunk(part: int, ord: Column, heading: Column, text: Column, kind: str, provenance: str, locator: Column) -> list:
    values = (F.lit(part), ord.cast("long"), heading, text, F.lit(kind), F.lit(provenance), locator)
    return ["doc_id", *[v.alias(n) for n, v in zip(_CHUNK[1:], values)]]


def presentation_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of slides, then of topics, then of batches; docs: doc_id, markdown."""
    own = slides(docs)
    studies = batch_studies(batch_candidates(own)).join(own.select("doc_id", "slide_number", F.col("text").alias("_text")), ["doc_id", "slide_number"], "left")
    said = F.coalesce(T.blank_to_null(batch_window(F.coalesce("_text", F.lit("")), F.col("batch_id"))), "batch_id")
    first = docs.select("doc_id", F.posexplode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(f"(?U){V.BATCH_ID}"), F.lit(0)))).alias("_k", "batch_id"))
    studies = studies.join(first, ["doc_id", "batch_id"])
    return reduce(
        DataFrame.unionByName,
        (
            own.select(*_chunk(0, F.col("slide_number"), F.array("title"), F.col("text"), "slide", "slide_text", F.col("locator"))),
            topics(own).select(*_chunk(1, F.col("position"), F.array("topic"), F.col("text"), "topic", "topic_from_slide_text", F.col("locator"))),
            studies.select(*_chunk(2, F.col("_k"), F.array("batch_id"), said, "batch_study", "batch_from_slide_text", F.col("locator"))),
        ),
    )


def _sheet_name(default: Column) -> Column:
    return F.coalesce(T.blank_to_null(F.trim(F.regexp_extract("markdown", r"(?m)^##?\s+(.+)$", 1))), default)


def sheet_chunks(docs: DataFrame) -> DataFrame:
    """The first table of a sheet as a chunk, then one for each phase with lines; docs: doc_id, markdown, source_file."""
    named = docs.withColumn("_sheet", _sheet_name(F.regexp_replace("source_file", r"\.[^.]*$", "")))
    table = F.coalesce(T.blank_to_null(_stripped(F.regexp_extract("markdown", r"((?:\|.*\|\s*\n)+)", 1))), _stripped(F.col("markdown")))
    parts = [named.select(*_chunk(0, F.lit(0), F.array("_sheet"), table, "table", "sheet_table", F.concat(F.lit("Sheet: "), F.col("_sheet"), F.lit(" / Table 1"))))]
    for k, phase in enumerate(V.SHEET_PHASES):
        lines = F.filter(F.split("markdown", r"\r\n?|\n"), _matches(rf"(?iU)\b{phase}\b"))
        locator = F.concat(F.lit("Sheet: "), F.col("_sheet"), F.lit(f" / Phase: {phase}"))
        parts.append(named.withColumn("_lines", lines).filter("size(_lines) > 0").select(*_chunk(1, F.lit(k), F.array(F.lit(phase)), F.array_join("_lines", "\n"), "table_section", "phase_from_sheet_table", locator)))
    return reduce(DataFrame.unionByName, parts)


def translation_chunks(docs: DataFrame) -> DataFrame:
    """A translation table's summary, its groups in order, and its first ROWS_AS_CHUNKS rows; docs: doc_id, markdown,
    source_file."""
    rows = translation_rows(docs)
    named = docs.select("doc_id", "source_file", _sheet_name(F.lit(V.SHEET_DEFAULT)).alias("_sheet"))
    line = F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "), F.col("field"), F.lit("; en-GB="), F.col("english"), F.lit("; zh-CN="), F.col("chinese"), F.lit("; unit="), F.col("unit"))
    seen = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("row_number", name))), lambda x: x[name])
    summed = named.join(rows.groupBy("doc_id").agg(F.count("*").alias("_n"), seen("unit").alias("_units"), seen("group_path").alias("_groups")), "doc_id", "left")
    units, groups = F.array_distinct(F.filter(F.coalesce("_units", F.array()), lambda x: x != "")), F.slice(F.array_distinct(F.coalesce("_groups", F.array())), 1, V.SUMMARY_GROUPS)
    summary = F.concat_ws(
        "\n", F.concat(F.lit("HMI translation table: "), F.col("source_file")), F.lit(f"Source: Sheet: {V.SHEET_DEFAULT}"), F.concat(F.lit("Rows: "), F.coalesce("_n", F.lit(0)).cast("string")),
        F.lit("Languages: en-GB, zh-CN"), F.concat(F.lit("Units: "), F.array_join(units, ", ")), F.concat(F.lit("Screen groups: "), F.array_join(groups, ", ")),
    )
    sheet = F.concat(F.lit("Sheet: "), F.col("_sheet"))
    grouped = row_groups(rows.withColumn("line", line)).join(named, "doc_id")
    more = F.when(F.col("row_count") > V.GROUP_LINES, F.concat(F.lit("\n... "), (F.col("row_count") - V.GROUP_LINES).cast("string"), F.lit(" additional rows"))).otherwise("")
    group_text = F.concat(F.lit("HMI screen group: "), F.col("group_path"), F.lit("\nRows: "), F.col("row_count").cast("string"), F.lit("\n"), F.col("text"), more)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_path"))
    row_text = F.concat_ws(
        "\n", F.concat(F.lit("HMI screen group: "), F.col("group_path")), F.concat(F.lit("Field: "), F.col("field")), F.concat(F.lit("en-GB: "), F.col("english")), F.concat(F.lit("zh-CN: "), F.col("chinese")),
        F.when(F.col("unit") != "", F.concat(F.lit("Unit: "), F.col("unit"))), F.concat(F.lit("Path tail: "), F.col("path_tail")),
    )
    kept = rows.filter(F.col("row_number") <= V.ROWS_AS_CHUNKS + 1).join(named, "doc_id")
    row_locator = F.concat(sheet, F.lit(" / Row: "), F.col("row_number").cast("string"))
    status = "xlsx_hmi_translation"
    return reduce(
        DataFrame.unionByName,
        (
            summed.select(*_chunk(0, F.lit(0), F.array("_sheet"), summary, "hmi_translation_table", status, sheet)),
            grouped.withColumn("_o", order).select(*_chunk(1, F.col("_o"), F.array("group_path"), group_text, "hmi_translation_group", status, F.concat(sheet, F.lit(" / Group: "), F.col("group_path")))),
            kept.select(*_chunk(2, F.col("row_number"), F.array("group_path", "field"), row_text, "hmi_translation_row", status, row_locator)),
        ),
    )


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, slug, source_file, document_kind, markdown) by their kind: presentations, sheets and
    translation tables by their own builders, all others (and those of which a builder finds nothing) by their headings.
    Numbers go through a document's chunks."""
    of = lambda kind: docs.filter(F.col("document_kind") == kind)
    built = presentation_chunks(of("process_development_presentation")).unionByName(sheet_chunks(of("mpdp_table_xlsx"))).unionByName(translation_chunks(of("hmi_translation_xlsx")))
    kinds = ("process_development_presentation", "mpdp_table_xlsx", "hmi_translation_xlsx")
    without = docs.filter(~F.coalesce(F.col("document_kind").isin(*kinds), F.lit(False))).unionByName(of(kinds[0]).join(built.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns))
    headed = chunk_markdown(without).select("doc_id", F.lit(0).alias("part"), F.col("position").cast("long").alias("ord"), "heading_path", "text", F.lit("text").alias("evidence_type"), F.lit("raw_markdown").alias("provenance_status"), F.lit(None).cast("string").alias("locator"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "ord"))
    numbered = built.unionByName(headed).withColumn("position", number - 1).join(docs.select("doc_id", "slug", "source_file"), "doc_id")
    return numbered.select("doc_id", numbered_id(F.col("slug"), F.col("position") + 1).alias("chunk_id"), "position", "source_file", "heading_path", "text", F.length("text").alias("char_count"), "evidence_type", "provenance_status", "locator")


def enrich(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Document fields, evidence type and provenance added to chunks that lack them."""
    have = set(chunks.columns)
    lacking = {c: F.lit(None).cast(t) for c, t in (("evidence_type", "string"), ("page_number", "int"), ("image_path", "string"), ("locator", "string"), ("provenance_status", "string")) if c not in have}
    own = chunks.withColumns(lacking) if lacking else chunks
    joined = own.join(documents.select("doc_id", "source_file", "source_path", "document_kind", "quality_status", "tags"), "doc_id")
    return joined.withColumns({
        "evidence_type": R.evidence_type(F.col("evidence_type"), F.col("page_number"), F.col("image_path"), F.col("text")),
        "provenance_status": F.coalesce("provenance_status", F.lit("converted_markdown")),
    })


def source_map(chunks: DataFrame) -> DataFrame:
    """chunk_id and where it comes from, as a struct of the provenance columns there are."""
    names = [c for c in ("source_file", "heading_path", "locator", "evidence_type", "provenance_status", "page_number", "slide_number", "sheet_name", "table_name", "section_number", "section_title", "topic_label", "batch_id", "group_path", "row_number", "confidence") if c in chunks.columns]
    return chunks.select("chunk_id", F.struct(*names).alias("source"))


def html_outline(html: Column) -> Column:
    """Markdown of a page: its heading, then its list items and paragraphs."""
    plain = lambda x: T.collapse(F.regexp_replace(x, "<[^>]+>", " "))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    titles = F.regexp_extract_all(body, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))
    items = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)>"), F.lit(1)), plain)
    listed = F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit("- "), x))
    return F.concat(F.array_join(F.transform(titles, lambda x: F.concat(F.lit("# "), plain(x))), "\n"), F.lit("\n"), F.array_join(listed, "\n"))
