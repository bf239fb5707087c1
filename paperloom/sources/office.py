"""Office files (docx, xlsx, pptx) as Markdown with their headings, lists, tables, sheets and slides, by joins over their parts.

A small helper unpacks the XML members of each file into rows; everything else is DataFrames: paragraphs meet their file's styles,
cells its shared strings, sheets their members through the workbook's relations, each by a join, and lines are put together in
order. Files with very many cells are split over tasks, as a cell is a row of its own. Elements are found by patterns, so a table
inside a table's cell counts as text of the outer cell's row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import written

KINDS = ("docx", "xlsx", "pptx")
_WANTED = re.compile(r"word/(?:document|styles)\.xml|ppt/slides/slide\d+\.xml|xl/(?:sharedStrings|workbook)\.xml|xl/_rels/workbook\.xml\.rels|xl/worksheets/[^/]+\.xml|docProps/core\.xml")
_MEDIA = re.compile(r"(?:word|ppt|xl)/media/.+")
_LINE = "path string, part long, line long, text string"


def members(files: DataFrame) -> DataFrame:
    """path, member, xml, error for the XML members of files (path, content) that are read, in rows of their own; media have a row
    without xml. A file that can't be read is one row with its error."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer() or b"")) as z:
                        for name in z.namelist():
                            if _WANTED.fullmatch(name):
                                rows.append((path, name, z.read(name).decode("utf-8-sig", "replace"), None))
                            elif _MEDIA.fullmatch(name):
                                rows.append((path, name, None, None))
                except Exception as error:  # a broken file is a row, not the end of the job
                    rows = [(path, None, None, f"{type(error).__name__}: {error}")]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "member", "xml", "error"])

    return files.select("path", "content").mapInArrow(unpack, "path string, member string, xml string, error string")


def _elements(xml: Column, tag: str) -> Column:
    """The elements of a tag, whole, in order; those that hold nothing too."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?: [^>]*)?/>|<{tag}(?: [^>]*)?(?<!/)>.*?</{tag}>"), F.lit(0))


def _plain(xml: Column) -> Column:
    """Text of an element as it was before it was escaped."""
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#39;", "'"), ("&amp;", "&")):
        xml = F.replace(xml, F.lit(mark), F.lit(char))
    return xml


def _said(xml: Column, tag: str, breaks: str) -> Column:
    """The texts of an element's runs, one after the other; breaks and tabs are spaces."""
    marked = F.regexp_replace(xml, rf"<(?:{breaks})(?: [^>]*)?/>", f"<{tag}> </{tag}>")
    return T.collapse(_plain(F.array_join(F.regexp_extract_all(marked, F.lit(rf"(?s)<{tag}(?: [^>]*)?(?<!/)>(.*?)</{tag}>"), F.lit(1)), "")))


def _attribute(xml: Column, name: str) -> Column:
    return _plain(F.regexp_extract(xml, rf'^<[^>]*? {name}="([^"]*)"', 1))


def _row(cells: Column) -> Column:
    escaped = F.transform(cells, lambda c: F.replace(T.collapse(c), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def _rule(width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))


def _table(xml: Column, row: str, cell: str, text: str, breaks: str) -> Column:
    """A table's rows as Markdown lines; the first is its head."""
    rows = F.transform(_elements(xml, row), lambda r: F.transform(_elements(r, cell), lambda c: _said(c, text, breaks)))
    width = F.greatest(F.lit(1), F.array_max(F.transform(rows, lambda r: F.size(r))))
    lines = F.transform(rows, lambda r: _row(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
    return F.when(F.size(rows) > 0, F.concat(F.slice(lines, 1, 1), F.array(_rule(width.cast("int"))), F.slice(lines, 2, F.size(lines)))).otherwise(F.array().cast("array<string>"))


def documents(parts: DataFrame) -> DataFrame:
    """The lines (path, part, line, text) of docx files: headings by their styles' names, list items, tables, other paragraphs."""
    blocks = F.regexp_extract_all("xml", F.lit(r"(?s)<w:tbl(?: [^>]*)?>.*?</w:tbl>|<w:p(?: [^>]*)?(?<!/)>.*?</w:p>"), F.lit(0))
    own = parts.filter("member = 'word/document.xml'").select("path", F.posexplode(blocks).alias("part", "xml"))
    own = own.withColumn("style", F.regexp_extract("xml", r'<w:pStyle w:val="([^"]*)"', 1))
    styles = parts.filter("member = 'word/styles.xml'").select("path", F.explode(_elements(F.col("xml"), "w:style")).alias("s"))
    name = F.lower(F.regexp_extract("s", r'<w:name w:val="([^"]*)"', 1))
    level = F.when(name == "title", F.lit("1")).otherwise(F.regexp_extract(name, r"^heading ([1-6])$", 1))
    styles = styles.select("path", F.regexp_extract("s", r'w:styleId="([^"]*)"', 1).alias("style"), level.alias("level")).filter("level <> ''")
    text = _said(F.col("xml"), "w:t", "w:br|w:tab|w:cr")
    plain = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), text)).when(F.contains("xml", F.lit("<w:numPr>")), F.concat(F.lit("- "), text)).otherwise(text)
    table = _table(F.col("xml"), "w:tr", "w:tc", "w:t", "w:br|w:tab|w:cr")
    lines = F.when(F.startswith("xml", F.lit("<w:tbl")), table).when(text == "", F.array().cast("array<string>")).otherwise(F.array(plain))
    return own.join(styles, ["path", "style"], "left").select("path", F.col("part").cast("long").alias("part"), F.posexplode(lines).alias("line", "text")).selectExpr("path", "part", "cast(line AS long) AS line", "text")


def presentations(parts: DataFrame) -> DataFrame:
    """The lines of pptx files: a mark for each slide, its title as a heading, its paragraphs, its tables."""
    number = F.regexp_extract("member", r"ppt/slides/slide(\d+)\.xml", 1).cast("long")
    own = parts.filter("member LIKE 'ppt/slides/slide%'").select("path", number.alias("part"), "xml")
    shapes = F.regexp_extract_all("xml", F.lit(r"(?s)<p:sp(?: [^>]*)?>.*?</p:sp>|<a:tbl(?: [^>]*)?>.*?</a:tbl>"), F.lit(0))
    title = lambda s: s.rlike(r'<p:ph(?: [^>]*)? type="(?:title|ctrTitle)"')
    said = lambda s: F.filter(F.transform(_elements(s, "a:p"), lambda p: _said(p, "a:t", "a:br|a:tab")), lambda t: t != "")
    shape = lambda s: F.when(F.startswith(s, F.lit("<a:tbl")), _table(s, "a:tr", "a:tc", "a:t", "a:br|a:tab")).when(title(s), F.transform(F.slice(F.array(F.array_join(said(s), " ")), 1, F.least(F.lit(1), F.size(said(s)))), lambda t: F.concat(F.lit("# "), t))).otherwise(said(s))
    mark = F.array(F.concat(F.lit("<!-- Slide number: "), F.col("part").cast("string"), F.lit(" -->")))
    lines = F.concat(mark, F.flatten(F.transform(shapes, shape)))
    return own.select("path", "part", F.posexplode(lines).alias("line", "text")).selectExpr("path", "part", "cast(line AS long) AS line", "text")


def cells(parts: DataFrame) -> DataFrame:
    """path, sheet (its place), name, row, column (from 1), value: the cells of xlsx files that hold something."""
    listed = parts.filter("member = 'xl/workbook.xml'").select("path", F.posexplode(_elements(F.col("xml"), "sheet")).alias("sheet", "s"))
    listed = listed.select("path", "sheet", _attribute(F.col("s"), "name").alias("name"), _attribute(F.col("s"), "r:id").alias("id"))
    relations = parts.filter("member = 'xl/_rels/workbook.xml.rels'").select("path", F.explode(_elements(F.col("xml"), "Relationship")).alias("r"))
    target = F.regexp_replace(_attribute(F.col("r"), "Target"), "^/?(?:xl/)?", "xl/")
    relations = relations.select("path", _attribute(F.col("r"), "Id").alias("id"), target.alias("member"))
    shared = parts.filter("member = 'xl/sharedStrings.xml'").select("path", F.posexplode(_elements(F.col("xml"), "si")).alias("_index", "si"))
    shared = shared.select("path", "_index", _said(F.col("si"), "t", "none").alias("_shared"))
    rows = parts.filter("member LIKE 'xl/worksheets/%'").select("path", "member", F.posexplode(_elements(F.col("xml"), "row")).alias("_k", "x"))
    rows = rows.select("path", "member", F.coalesce(F.expr("try_cast(nullif(regexp_extract(x, '^<row[^>]*? r=\"([0-9]+)\"', 1), '') AS long)"), F.col("_k") + 1).alias("row"), F.posexplode(_elements(F.col("x"), "c")).alias("_c", "c"))
    letters = F.regexp_extract("c", r'^<c[^>]*? r="([A-Z]+)', 1)
    place = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)
    kind, value = _attribute(F.col("c"), "t"), _plain(F.regexp_extract("c", r"(?s)<v>(.*?)</v>", 1))
    own = rows.select("path", "member", "row", F.when(letters == "", F.col("_c") + 1).otherwise(place).alias("column"), kind.alias("_t"), value.alias("_v"), _said(F.col("c"), "t", "none").alias("_inline"))
    own = own.withColumn("_index", F.when(F.col("_t") == "s", F.expr("try_cast(_v AS int)"))).join(shared, ["path", "_index"], "left")
    shown = F.when(F.col("_t") == "s", F.coalesce("_shared", F.lit(""))).when(F.col("_t") == "inlineStr", F.col("_inline")).when(F.col("_t") == "b", F.when(F.col("_v") == "1", "TRUE").otherwise("FALSE")).otherwise(F.col("_v"))
    return own.join(relations, ["path", "member"]).join(listed, ["path", "id"]).select("path", "sheet", "name", "row", "column", shown.alias("value")).filter("value <> ''")


def workbooks(parts: DataFrame) -> DataFrame:
    """The lines of xlsx files: a heading for each sheet, and its rows as a table, from the first column and row that hold something."""
    held = written(cells(parts), "cells")
    size = held.groupBy("path", "sheet").agg(F.min("row").alias("_first"), F.min("column").alias("_left"), F.max("column").alias("_right"))
    rows = held.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_cells")).join(size, ["path", "sheet"])  # a row's cells: 2^14 at most
    values = F.transform(F.sequence("_left", "_right"), lambda c: F.coalesce(F.try_element_at("_cells", c), F.lit("")))
    own = rows.select("path", F.col("sheet").cast("long").alias("part"), (F.col("row") * 2).alias("line"), _row(values).alias("text"))
    rules = size.select("path", F.col("sheet").cast("long").alias("part"), (F.col("_first") * 2 + 1).alias("line"), _rule(F.col("_right") - F.col("_left") + 1).alias("text"))
    heads = held.select("path", "sheet", "name").distinct().select("path", F.col("sheet").cast("long").alias("part"), F.lit(-1).cast("long").alias("line"), F.concat(F.lit("## "), "name").alias("text"))
    return own.unionByName(rules).unionByName(heads)


def properties(parts: DataFrame) -> DataFrame:
    """path, title, creator, subject (null where there is none), media: how many there are."""
    core = F.when(F.col("member") == "docProps/core.xml", F.col("xml"))
    own = parts.groupBy("path").agg(F.max(core).alias("_core"), F.count_if(F.col("member").rlike("^(?:word|ppt|xl)/media/")).alias("media"))
    name = lambda n: T.blank_to_null(T.collapse(_plain(F.regexp_extract("_core", rf"(?s)<dc:{n}>(.*?)</dc:{n}>", 1)))).alias(n)
    return own.select("path", *[name(n) for n in ("title", "creator", "subject")], "media")


def markdown(files: DataFrame) -> DataFrame:
    """path, markdown, title, creator, subject, media, error of office files (path, extension, content). A file that can't be read
    has its error and nothing else, an empty one an empty text. Repeated paths count as one file's parts."""
    parts = written(members(files.filter(F.col("extension").isin(*KINDS))), "office-members")
    lines = documents(parts).unionByName(presentations(parts)).unionByName(workbooks(parts))
    whole = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "line", "text"))).alias("_l")).select("path", _joined(F.col("_l")).alias("markdown"))  # a file's own text
    bad = parts.filter("error is not null").select("path", "error")
    read = properties(parts).join(bad, "path", "left").join(whole, "path", "left")
    return read.select("path", F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"), "title", "creator", "subject", "media", "error")


def _joined(lines: Column) -> Column:
    """Lines of a table follow one another; before and after them, and between others, there is an empty line."""
    in_table = lambda x: F.startswith(x["text"], F.lit("|"))
    between = lambda i: F.when(i == 0, F.lit("")).when(in_table(F.get(lines, i - 1)) & in_table(F.get(lines, i)) & (F.get(lines, i - 1)["part"] == F.get(lines, i)["part"]), F.lit("\n")).otherwise(F.lit("\n\n"))
    return F.concat(F.array_join(F.transform(lines, lambda x, i: F.concat(between(i), x["text"])), ""), F.lit("\n"))
