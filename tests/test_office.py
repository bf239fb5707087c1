"""Office files that are made here, as Markdown."""

import io
import zipfile

from pyspark.sql import functions as F

from paperloom.operators import chunking
from paperloom.sources import files, office


def zipped(members: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def run(text, style="", more=""):
    return f'<w:p w:rsidR="0"><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{more}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


STYLES = '<w:styles><w:style w:type="paragraph" w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="Body"><w:name w:val="Body Text"/></w:style></w:styles>'
CELL = "<w:tc><w:tcPr/><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
DOCX = {
    "word/styles.xml": STYLES,
    "word/document.xml": "<w:document><w:body>" + run("Scope &amp; aim", "berschrift1") + "<w:p/>" + run("Two", "H2") + '<w:p><w:r><w:t>one</w:t></w:r><w:r><w:tab/><w:t xml:space="preserve">two </w:t></w:r></w:p>' + run("item", "", "<w:numPr><w:ilvl/></w:numPr>")
    + "<w:tbl><w:tblPr/><w:tr>" + CELL.format("A") + CELL.format("B|C") + "</w:tr><w:tr><w:trPr/>" + CELL.format("1") + "</w:tr></w:tbl>" + run("end", "Body") + "</w:body></w:document>",
    "word/media/image1.png": "x", "docProps/core.xml": "<cp:coreProperties><dc:title>A &lt;plan&gt;</dc:title><dc:creator></dc:creator></cp:coreProperties>",
}
SHEET = '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>0</v></c></row><row r="4" spans="1:3"><c r="B4"><v>2.5</v></c><c r="C4" s="3"/><c r="D4" t="b"><v>1</v></c></row><row r="5"><c r="AA5" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>'
XLSX = {
    "xl/workbook.xml": '<workbook><sheets><sheet name="Data &amp; more" sheetId="7" r:id="rId9"/><sheet name="Other" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>Value</t></si><si><r><t>Na</t></r><r><t xml:space='preserve'>me </t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>', "xl/worksheets/sheet2.xml": SHEET,
}
SHAPE = "<p:sp><p:nvSpPr>{}</p:nvSpPr><p:txBody>{}</p:txBody></p:sp>"
PARAGRAPH = "<a:p><a:r><a:rPr/><a:t>{}</a:t></a:r></a:p>"
SLIDE = "<p:sld>" + SHAPE.format('<p:ph type="title"/>', PARAGRAPH.format("Process Flow")) + SHAPE.format("", PARAGRAPH.format("first") + "<a:p/>" + PARAGRAPH.format("second")) + "<a:tbl><a:tr h='1'><a:tc><a:txBody>" + PARAGRAPH.format("x") + "</a:txBody></a:tc></a:tr></a:tbl></p:sld>"
PPTX = {"ppt/slides/slide10.xml": SLIDE.replace("first", "tenth"), "ppt/slides/slide2.xml": SLIDE}


def test_office_markdown(spark):
    rows = [("a.docx", "docx", zipped(DOCX)), ("b.xlsx", "xlsx", zipped(XLSX)), ("c.pptx", "pptx", zipped(PPTX)), ("d.docx", "docx", bytearray(b"no zip")), ("e.xlsx", "xlsx", zipped({"a": "b"})), ("f.docx", "docx", None), ("g.docx", "docx", zipped({"word/document.xml": "<w:p/>"}))]
    found = {r["path"]: r for r in office.markdown(spark.createDataFrame(rows, "path string, extension string, content binary")).collect()}
    a = found["a.docx"]
    assert a["markdown"] == "# Scope & aim\n\n## Two\n\none two\n\n- item\n\n| A | B\\|C |\n| --- | --- |\n| 1 |  |\n\nend\n"
    assert (a["title"], a["creator"], a["media"], a["error"]) == ("A <plan>", None, 1, None)
    assert found["b.xlsx"]["markdown"].startswith("## Data & more\n\n| Name | Value |") and "| 2.5 |  | TRUE |" in found["b.xlsx"]["markdown"] and found["b.xlsx"]["markdown"].endswith("| far |\n\n## Other\n\n| 7 |\n| --- |\n")
    slide = "# Process Flow\n\nfirst\n\nsecond\n\n| x |\n| --- |"
    assert found["c.pptx"]["markdown"] == "<!-- Slide number: 2 -->\n\n" + slide + "\n\n<!-- Slide number: 10 -->\n\n" + slide.replace("first", "tenth") + "\n"
    assert found["d.docx"]["error"] and found["d.docx"]["markdown"] is None and found["f.docx"]["error"] and found["g.docx"]["markdown"] == ""


def test_converted_files_are_cut_into_their_chunks(spark):
    rows = [("a.docx", "docx", zipped(DOCX)), ("c.pptx", "pptx", zipped(PPTX)), ("b.xlsx", "xlsx", zipped(XLSX)), ("x.docx", "docx", bytearray(b"")), ("n.txt", "txt", bytearray(b"# N\n\nb"))]
    read = files.convert(spark.createDataFrame(rows, "path string, extension string, content binary"))
    out = {r["path"]: r for r in read.collect()}
    assert out["x.docx"]["error"] and out["n.txt"]["markdown"] == "# N\n\nb" and out["a.docx"]["warnings"] == ["1 embedded media"] and len(out) == 5
    docs = read.filter("markdown is not null").withColumnRenamed("path", "doc_id").withColumn("source_file", F.col("doc_id")).cache()
    slides = chunking.slides(docs.filter("doc_id = 'c.pptx'")).orderBy("slide_number").collect()
    assert [(r["slide_number"], r["title"]) for r in slides] == [(2, "Process Flow"), (10, "Process Flow")]
    sections = chunking.chunk_markdown(docs.filter("doc_id = 'a.docx'").withColumn("slug", F.col("doc_id"))).collect()
    assert ["Scope & aim", "Two"] in [r["heading_path"] for r in sections]
    sheets = chunking.sheet_chunks(docs.filter("doc_id = 'b.xlsx'")).collect()
    assert any("| Name | Value |" in r["text"] for r in sheets)
