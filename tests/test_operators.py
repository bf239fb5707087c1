"""Semantics that the driver's tables don't show, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions import text as T
from paperloom.functions import vocabulary as V
from paperloom.operators import changes, chunking, concepts, library, reports, search
from paperloom.sinks import exports
from paperloom.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def docs(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_id long, slug string, markdown string")


def test_skipped_levels_nest_siblings(spark):
    rows = chunking.chunk_markdown(docs(spark, "# A\n\nx\n\n### C\ny\n### D\nz")).orderBy("position").collect()
    assert [r["heading_path"] for r in rows] == [["A"], ["A", "C"], ["A", "C", "D"]]
    assert rows[0]["chunk_id"] == "d0_0001" and rows[0]["text"] == "# A\n\nx"


def test_long_section_is_cut(spark):
    rows = chunking.chunk_markdown(docs(spark, "# A\n\n" + "word " * 500), 100).collect()
    assert len(rows) > 1 and all(r["char_count"] <= 100 for r in rows)
    assert chunking.chunk_markdown(docs(spark, "", None)).count() == 0


def test_drawing_index_cursor(spark):
    text = "Table of contents\nPage\n+A1\nMe\nPump\nPlan\n01.02.2020\nnoise\n/B\nYou\nValve\nList\n03.04.2021"
    pages = spark.createDataFrame([(1, 2, None, text), (1, 3, "p3", "nothing")], "doc_id long, page_number int, locator string, text string")
    rows = chunking.drawing_index(pages).orderBy("position").collect()
    assert [(r["page_code"], r["date"]) for r in rows] == [("+A1", "01.02.2020"), ("/B", "03.04.2021")]
    assert rows[0]["locator"] == "Table of Contents / Page 2"


def test_toc_and_sections(spark):
    pages = spark.createDataFrame([(1, 1, "1 Safety 5\n2 Operation\n9"), (1, 5, "1 Safety\nbody one\nmore"), (1, 9, "2 Operation\nbody two")], "doc_id long, page_number int, text string")
    toc = chunking.toc_entries(pages)
    assert {(r["section_number"], r["title"], r["page_hint"]) for r in toc.collect()} >= {("1", "Safety", 5), ("2", "Operation", 9)}
    found = {r["section_number"]: r["text"] for r in chunking.section_chunks(pages, toc.filter("page_number = 1")).collect()}
    assert found["1"].startswith("1 Safety\nbody one")


def test_slides_topics_and_tables(spark):
    md = "<!-- Slide number: 1 -->\n# Plan\nbody\n<!-- Slide number: 2 -->\n\n<!-- Slide number: 3 -->\nResult"
    own = chunking.slides(docs(spark, md)).orderBy("slide_number").collect()
    assert [(r["slide_number"], r["title"]) for r in own] == [(1, "Plan"), (3, "Result")]
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 5 | 6 |"
    rows = chunking.table_rows(docs(spark, table)).orderBy("row_number").collect()
    assert [(r["row_number"], r["cells"]) for r in rows] == [(2, {"a": "1", "b": "2"}), (4, {"a": "5", "b": "6"})]
    assert value(spark, T.key_values(F.lit("| k | 1 |\n|---|---|\n| k | 2 |\n| x | y |"))) == {"k": "2", "x": "y"}
    slides = spark.createDataFrame([(1, 1, "t", "a"), (1, 2, "t", "b"), (1, 5, "u", "c")], "doc_id long, slide_number int, topic string, text string")
    assert {r["topic"]: r["locator"] for r in chunking.topics(slides, ["t", "u"]).collect()} == {"t": "Slides 1-2", "u": "Slide 5"}


def test_text_functions(spark):
    assert value(spark, T.clean_markdown(F.lit("a\r\n# B\n\n\n\n\nc  "))) == "a\n\n# B\n\n\nc\n"
    assert value(spark, T.clip(F.lit("a  b c d e f"), 8)) == "a b c..."
    assert value(spark, T.searchable(F.lit("x NaN y " + "A" * 70))) == "x y [base64]"
    assert value(spark, T.searchable(F.lit("NaN | NaN | NaN | z"))) == "[ omitted] | z"
    assert value(spark, T.path_tail(F.lit("a\\b\\c\\d"))) == ".../b/c/d"
    assert value(spark, T.chunk_title({"batch_id": F.lit("")}, F.array(F.lit("h1"), F.lit("h2")), F.lit("id"))) == "h2"
    assert value(spark, T.limitation(F.lit(None).cast("string"), F.lit(True))) == "missing locator; chunk marked noisy"
    assert value(spark, T.limitation(F.lit("p"), F.lit(False))) is None
    assert value(spark, T.note_name(F.lit('a/b:"c"'))) == "a b c"
    assert value(spark, T.line_window(F.lit("1\n2\n3x\n4\n5\n6"), "3x", 1)) == "2\n3x\n4"
    assert value(spark, T.json_list(F.lit("{bad"))) == []
    assert value(spark, T.extension(F.lit("a/B.PDF"))) == "pdf" and value(spark, T.extension(F.lit("noext"))) == "unknown"
    assert value(spark, T.normal_entity(F.lit("  Straße  X "))) == "strasse x"
    assert T.query_tokens("The Alarm of pump the ALARM 12 冷却") == ["alarm", "pump", "alarm"]
    assert value(spark, T.noise(F.lit("NaN | " * 30), F.lit(None).cast("string")))["is_noisy"]
    assert not value(spark, T.noise(F.lit("plain words of a text"), F.lit("p 1")))["is_noisy"]


def test_rules(spark):
    assert value(spark, R.first_rule(F.lit("an operating manual"), V.NAME_KINDS, "x")) == "manual_pdf"
    assert value(spark, R.additive_kind(F.lit("a b"), [("a", 2), ("b", 1), ("c", 5)], 3, "k", F.lit("o"))) == "k"
    status = lambda *x: value(spark, R.quality_status(*map(F.lit, x)))
    assert status("pdf", "# A", False, 3, "x", 2, 0) == "visual_only" and status("pdf", "no head", False, 3, "x", 2, 1) == "low_structure" and status("docx", "", True, 0, "x", 0, 0) == "ok"
    assert value(spark, R.evidence_type(F.lit(None).cast("string"), F.lit(1), F.lit("i"), F.lit(""))) == "image"
    assert value(spark, R.result_status(F.lit("Batch 3: Stability: PASS, approved"))) == "Approved" and value(spark, R.result_status(F.lit("failure"))) == ""
    assert value(spark, R.unsupported_reason(F.lit("~$a.docx"), F.lit("docx"))) == "office lock file"


def rows_of(spark, *texts, **columns):
    data = [(str(k), k, "", t, None, "text", False, 0.0, "generic_pdf", f"f{k}", f"/f{k}", "o") for k, t in enumerate(texts)]
    own = spark.createDataFrame(data, "chunk_id string, chunk_ord long, title string, text string, locator string, evidence_type string, is_noisy boolean, noise_score double, document_kind string, source_file string, source_path string, output_dir string")
    empty = F.array().cast("array<string>")
    return own.withColumns({"doc_id": F.col("chunk_ord"), "heading_path": empty, "headings": F.lit(""), "entities": F.lit(""), "noise_reasons": empty, "document_title": F.lit("")} | columns)


def ids(found):
    return {int(r["chunk_id"]) for r in found.collect()}


def test_match_expressions(spark):
    rows = rows_of(spark, "Alpha motor one", "Beta valve", "alpha beta", "älpha gamma", "motor alpha x x x x x x x x x x x x beta")
    hits = lambda q: ids(search.match_rows(rows, q))
    assert hits("alpha") == {0, 2, 3, 4}
    assert hits("alpha beta") == {2, 4} and hits("alpha OR valve") == {0, 1, 2, 3, 4}
    assert hits("alpha NOT beta") == {0, 3} and hits('"alpha beta"') == {2} and hits("va*") == {1}
    assert hits("NEAR(alpha beta, 3)") == {2} and hits("title:alpha") == set()
    for bad in ("S7-300", "", "a/b", "x AND", "what's", "pump, fault"):
        with pytest.raises(search.QuerySyntaxError):
            search.parse(bad)
    assert ids(search.match_rows(rows_of(spark, "see S7-300 here", "none"), "s7-300")) == {0}


def test_cascade(spark):
    rows = rows_of(spark, "Alpha motor 2M2001", "Beta valve 1V2005", "cooling water pump")
    found = search.search(rows, "alpha beta").collect()
    assert {r["chunk_id"] for r in found} == {"0", "1"} and found[0]["mode"] == "token_fallback" and found[0]["total_hits"] == 2
    alias = search.search(rows, "冷却水").collect()
    assert alias[0]["alias_used"] == "冷却水 -> cooling water" and alias[0]["mode"] == "fts"
    prefix = search.search(rows, "2M2001XX").collect()
    assert prefix and prefix[0]["query_used"].endswith("*") and prefix[0]["normalized_used"]
    assert search.search(rows, "nothing here").count() == 0
    assert search.identifier_variants("12TH-AB") == ["12THAB", "12THAB*", "12THA*", "12TH*", "12TH*"]
    info = search.diagnostics(search.search(rows, "alpha beta"), "alpha beta")
    assert info["token_fallback_used"] and info["shown_count"] == 2 and "shown results have no locators" in info["hints"][-1]


def test_more_tokens_win_and_pool_is_wide(spark):
    rows = rows_of(spark, *["alpha"] * 30, *["beta"] * 30, *["gamma"] * 30, "alpha beta gamma delta")
    best = search.token_rows(rows, "alpha beta gamma", 1).orderBy("_order").first()
    assert best["chunk_id"] == "90" and best["matched_tokens"] == ["alpha", "beta", "gamma"]
    kinds = rows_of(spark, "pump fault", "pump fault").withColumn("document_kind", F.when(F.col("chunk_ord") == 1, "fault_catalog_pdf").otherwise("manual_pdf"))
    assert search.token_rows(kinds, "pump fault", 2).orderBy("_order").first()["chunk_id"] == "1"


def test_entities_and_library(spark):
    documents = spark.createDataFrame([("a", 0, "Pump", "a.pdf"), ("b", 1, "Valve", "b.pdf")], "doc_id string, doc_ord long, title string, source_file string")
    chunks = spark.createDataFrame([("c1", "a", 0, "t", "uses KX12 and QY99", "p1", ["h"]), ("c2", "b", 1, "t", "kx12 again", None, ["h"])], "chunk_id string, doc_id string, chunk_ord long, title string, text string, locator string, heading_path array<string>")
    entities = spark.createDataFrame([("a", "part", "KX12", 0), ("b", "part", "QY99", 0), ("b", "part", "kx12", 1)], "doc_id string, entity_type string, entity_text string, position long")
    assets = spark.createDataFrame([("x1", "a", "i.png"), ("x2", "a", "i.png")], "asset_id string, doc_id string, path string")
    lib = library.build(documents, chunks, entities, assets)
    assert {(r["entity_text"], r["mention_count"]) for r in lib.entities.collect()} == {("KX12", 2), ("QY99", 1)}
    names = {r["entity_id"]: r["entity_text"] for r in lib.entities.collect()}
    inside = {(r["chunk_id"], names[r["entity_id"]]) for r in lib.mentions.filter("chunk_id is not null").collect()}
    assert inside == {("c1", "KX12"), ("c2", "KX12")}  # QY99 is first seen after document a
    assert lib.assets.count() == 1
    assert reports.documents_without(documents, lib.mentions).count() == 0
    packs = spark.createDataFrame([("a", json.dumps({"part": ["X", " ", "Y"], "n": 3, "o": [{"k": 1}]}))], "doc_id string, entities_json string")
    assert {r["entity_text"] for r in library.flatten_entities(packs).collect()} == {"X", "Y"}


def test_change_plan_pairs_moves_once(spark):
    schema = "path string, size long, mtime long, sha256 string"
    current = spark.createDataFrame([("new1", 1, 1, "h"), ("new2", 1, 1, "h"), ("same", 2, 2, "s"), ("mod", 3, 3, "m2"), ("old", 1, 1, "o")], schema)
    registry = spark.createDataFrame([("gone1", 1, 1, "h", True), ("same", 2, 2, "s", True), ("mod", 3, 3, "m", True), ("lost", 9, 9, "z", True), ("old", 1, 1, "o", False)], schema + ", manifest_there boolean")
    plan = {r["path"]: (r["status"], r["previous_path"]) for r in changes.change_plan(current, registry).collect()}
    assert plan == {"new1": ("moved_or_renamed_candidate", "gone1"), "new2": ("new", None), "same": ("unchanged", "same"), "mod": ("modified", "mod"), "lost": ("deleted_missing", "lost"), "old": ("stale", "old")}
    assert changes.library_status(0) == "current" and changes.library_status(2) == "stale" and changes.library_status(None) == "unknown"
    assert changes.library_status(0, {"new": 1}) == "stale" and changes.library_status(None, None, "current") == "current" and changes.library_status(0, {"unchanged": 3}) == "current"
    with pytest.raises(ValueError):
        changes.linked_version([], None, False)


def test_concepts(spark):
    rows = spark.createDataFrame([(1, 1, "Vacuum pump fault of the vacuum pump, see user@mail.com"), (2, 2, "vacuum pump")], "doc_id long, chunk_id long, text string")
    found = concepts.candidates(rows, F.col("text"), ["doc_id", "chunk_id"], 24, "text_phrase")
    index = {r["label"]: r for r in concepts.concept_index(found).collect()}
    assert index["vacuum pump"]["doc_count"] == 2 and "of" not in index
    assert value(spark, concepts.noisy_label(F.lit("cover sheet"))) and not value(spark, concepts.noisy_label(F.lit("risk sheet")))
    pairs = concepts.cooccurrence(found, "chunk_id", "label")
    nodes, edges = concepts.concept_graph(concepts.concept_index(found), pairs, 2)
    assert nodes.count() == 2 and edges.count() == 1


def test_files_and_packs(spark, tmp_path):
    (tmp_path / "in/.hid").mkdir(parents=True)
    for name, text in (("in/b.txt", "# B\n\nbody"), ("in/a.html", "<h1>T</h1><p>x &lt; y</p><li>one</li>"), ("in/~$c.docx", "z"), ("in/.hid/d.txt", "h"), ("in/e.docx", "broken")):
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path / "in"))
    kept = found.filter(files.supported(F.col("name")))
    assert [r["name"] for r in files.in_order(kept).orderBy("doc_ord").collect()] == ["a.html", "b.txt", "e.docx"]
    assert files.filter_globs(kept, ["*.txt", "*.html"], ["b*"]).count() == 1
    out = {r["path"].rpartition("/")[2]: r for r in files.convert(kept).collect()}
    assert out["a.html"]["markdown"].startswith("# T\n- ") and out["e.docx"]["error"] and out["b.txt"]["engine"] == "text"
    pack = tmp_path / "packs/p1"
    pack.mkdir(parents=True)
    (pack / "manifest.json").write_text('{\n  "source_file": "a.pdf",\n  "status": "success"\n}\n')
    (pack / "chunks.jsonl").write_text('{"chunk_id": "c1", "text": "x"}\nbad\n')
    bad = tmp_path / "packs/p2"
    bad.mkdir()
    (bad / "manifest.json").write_text('{"status": "failed"}')
    packs = files.read_packs(spark, str(tmp_path / "packs"))
    assert packs["manifests"].count() == 1 and packs["chunks"].count() == 1 and packs["warnings"].count() == 2


def test_stream_updates_a_table(spark, tmp_path):
    from paperloom.streaming import updates

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    run = lambda: updates.into_table(updates.arriving(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (tmp_path / "in/b.txt").write_text("two")
    run()
    assert {r["markdown"] for r in spark.read.parquet(str(tmp_path / "t/version=1")).collect()} == {"one", "two"}


def test_exports(spark, tmp_path):
    rows = rows_of(spark, "one", "two")
    for kind in exports.FORMATS:
        assert exports.interop(rows, kind).count() == 2
    text = exports.json_contract(rows, "1.0", ["chunk_id", "locator"]).first()["value"]
    assert list(json.loads(text)) == ["schema_version", "chunk_id", "locator"]
    notes = exports.vault_notes(spark.createDataFrame([(1, "A", "k"), (2, "a", "k")], "doc_id long, title string, document_kind string"), spark.createDataFrame([(1, "p")], "doc_id long, preview string"))
    assert len({r["name"].lower() for r in notes.collect()}) == 2
    exports.write_vault(notes, f"file://{tmp_path}/v")
    with pytest.raises(ValueError):
        exports.write_vault(notes, f"file://{tmp_path}/v")


def test_knowledge(spark):
    from paperloom.operators import knowledge

    lines = spark.createDataFrame([(1, 1, "Project: Alpha"), (1, 2, "Author"), (1, 3, "Date"), (1, 4, "Jane Doe")], "doc_id long, line_number int, line string")
    assert {(r["field"], r["value"]) for r in knowledge.title_metadata(lines).collect()} == {("project", "Alpha"), ("author", "Jane Doe"), ("date", "Jane Doe")}
    own = docs(spark, "Serial: X7").withColumn("document_kind", F.lit("m"))
    assert knowledge.extract_fields(own, {"m": {"serial": [r"No: (\S+)", r"Serial: (\S+)"], "none": ["(zzz)"]}}).first()["fields"] == {"serial": "X7"}
    toc = spark.createDataFrame([(1, 1, "1", "A"), (1, 2, "1.1", "B"), (1, 3, "1", "A")], "doc_id long, position int, section_number string, title string")
    assert knowledge.outline(toc).first()["outline"] == "- 1 A\n  - 1.1 B"
    assert knowledge.enrich_text(own, "none").first()["enrich_warning"] == "no enricher named none"
    pdf = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    assert knowledge.read_pdf_pages(pdf).first()["error"]


def test_workspace(spark, tmp_path):
    from paperloom.operators import workspace

    path = f"file://{tmp_path}/ws"
    assert workspace.init_workspace(spark, path) == {"library_versions": 0, "output_versions": 0, "catalog": 0}
    with pytest.raises(ValueError):
        workspace.register_library(spark, path, "/l", "/s", "h", 1, 2, dirty=True)
    first = workspace.register_library(spark, path, "/l", "/s", "h", 1, 2, dirty=False)
    output, warnings = workspace.register_output(spark, path, "/o", "vault")
    assert output["library_version_id"] == first["library_version_id"] and not warnings
    assert workspace.workspace_status(spark, path)["output_versions"]["count"] == 1
    workspace.add_to_catalog(spark, path, "b", "B", "/b")
    workspace.add_to_catalog(spark, path, "a", "A", "/a")
    rows = workspace.add_to_catalog(spark, path, "b", "B2", "/b2").orderBy("library_id").collect()
    assert [(r["library_id"], r["library_name"]) for r in rows] == [("a", "A"), ("b", "B2")]
    assert [r["library_id"] for r in changes.select_libraries(workspace.read_catalog(spark, path), ["b", "a"]).collect()] == ["b", "a"]
    plan = spark.createDataFrame([("p", "new")], "path string, status string")
    assert workspace.update_library(spark, plan, None, None, path, plan)["status"] == "planned"
    failing = lambda df: df.withColumn("error", F.lit("x"))
    assert workspace.update_library(spark, plan, failing, None, path, plan, dry_run=False)["status"] == "conversion_failed"
    assert workspace.artifact_status(spark, {"x": f"file://{tmp_path}/none"}).first()["status"] == "missing"
    assert workspace.output_type(["a", "_index.json"]) == "packs"
    tool = workspace.run_tool(spark.createDataFrame([("a.txt", bytearray(b"x"))], "path string, content binary"), {"cat": ["cat"], "no": ["no-such-program"]})
    assert {r["command"]: r["status"] for r in tool.collect()} == {"cat": "ok", "no": "missing"}
    from paperloom import api

    assert set(api.COMMANDS) >= {"search-library", "update-library"}


def test_conversion_results(spark):
    from paperloom.operators import knowledge, workspace

    schema = "path string, markdown string, engine string, warnings array<string>, error string"
    first = spark.createDataFrame([("a", None, "layout", [], "boom"), ("b", "text", "layout", [], None)], schema)
    second = spark.createDataFrame([("a", "plain", "text", ["w"], None)], schema)
    rows = {r["path"]: r for r in files.with_fallback(first, second).collect()}
    assert rows["a"]["fallback_used"] and rows["a"]["warnings"] == ["w", "fallback after boom"] and rows["b"]["engine"] == "layout"
    sources = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, sha256 string")
    manifests = workspace.failure_manifests(sources, first)
    assert {r["source_path"]: (r["status"], r["markdown"], r["errors"]) for r in manifests.collect()} == {"a": ("failed", "", ["boom"]), "b": ("success", "text", [])}
    index = workspace.output_index(manifests, spark.createDataFrame([("b", "Title")], "source_path string, title string"))
    assert {r["markdown"] for r in index.collect()} == {"| [a](a/document.md) | document | ok |  | 0 | 0 |", "| [b](Title/document.md) | document | ok |  | 0 | 0 |"}
    assert len(manifests.columns) == 18  # 17 fields and the text
    pages = spark.createDataFrame([(1, 1, "intro", "Doc"), (1, 2, "see the alarm list", "Doc"), (1, 3, "x", "Doc")], "doc_id long, page_number int, text string, document_title string")
    titles = [r["semantic_title"] for r in knowledge.semantic_titles(pages, [("Alarms", "alarm list")]).orderBy("page_number").collect()]
    assert titles == ["Doc", "Alarms", None]
    limit = knowledge.page_text_limit
    assert [value(spark, limit(F.lit(k), F.lit(9), *x)) for k, x in (("m", (True, 2, 3)), ("m", (False, 2, 3)), ("manual_pdf", (False, None, 3)), ("m", (False, None, 3)), ("m", (False, None, None)))] == [9, 2, 9, 3, 9]


def test_office_files():
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>")
        z.writestr("word/media/i.png", "x")
    assert files.embedded_media(data.getvalue()) == 1 and files.embedded_media(b"broken") == 0
    assert files.READERS["office"](data.getvalue(), "docx").split() == ["one", "two"]
    with pytest.raises(NotImplementedError):
        files.READERS["marker"](b"", "pdf")


def test_core_properties(spark):
    found = value(spark, files.core_properties(F.lit("<dc:title>T</dc:title><dc:creator></dc:creator>")))
    assert (found["title"], found["creator"], found["subject"]) == ("T", None, None)


def test_page_chunks_and_enrichment(spark):
    pages = spark.createDataFrame(
        [(1, "d", 1, "Start", "p. 1", None, "own text", "whole"), (1, "d", 2, None, None, "i.png", "", "whole")],
        "doc_id long, slug string, page_number int, semantic_title string, locator string, image_path string, text string, whole_text string",
    )
    rows = chunking.chunk_pages(pages).orderBy("chunk_id").collect()
    assert rows[0]["text"] == "Start\nLocator: p. 1\nExtracted text: own text" and rows[1]["text"].endswith("Extracted text: whole") and rows[1]["heading_path"] == ["Page 2"]
    documents = spark.createDataFrame([(1, "f", "/f", "k", "ok", ["t"])], "doc_id long, source_file string, source_path string, document_kind string, quality_status string, tags array<string>")
    rich = chunking.enrich(chunking.chunk_pages(pages), documents)
    assert {r["evidence_type"] for r in rich.collect()} == {"text_page"}
    assert chunking.source_map(rich).first()["source"]["page_number"] in (1, 2)
    assert chunking.single_chunk(docs(spark, "x" * 3000)).first()["char_count"] == 1600


def test_packs_are_assembled(spark):
    manifests = spark.createDataFrame([("a", "success"), ("b", "failed")], "doc_dir string, status string")
    knowledge = spark.createDataFrame([("a", "T")], "doc_dir string, title string")
    assert [r["title"] for r in library.assemble_packs(manifests, knowledge=knowledge).collect()] == ["T"]
    schema = "doc_id string, chunk_id string, locator string, page_number int"
    chunks = spark.createDataFrame([("a", "c", "", 0)], schema)
    sources = spark.createDataFrame([("a", "c", "p. 3", 3)], schema)
    row = library.with_source(chunks, sources, ["locator", "page_number"]).first()
    assert (row["locator"], row["page_number"]) == ("p. 3", 3)


def test_index_json(spark):
    documents = spark.createDataFrame([("a", "A"), ("b", "B")], "doc_id string, title string")
    chunks = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    mentions = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, "x")], "doc_id string, ord int, entity_text string")
    rows = {r["doc_id"]: (r["chunk_count"], r["entities"]) for r in exports.index_json(documents, chunks, mentions).collect()}
    assert rows == {"a": (2, ["x", "y"]), "b": (0, [])}
    assert exports.manifest(1, 2, 3, [], "/in")["exports_count"] == 4


def test_batches_and_phases(spark):
    md = (
        "<!-- Slide number: 2 -->\nBatch\n| Batch | VL123456 50 kg | TC000001 |\n|---|---|---|\n| Batch purpose | M4E 5 L/min | x |\n| Results | Shake stability fail | Stability ok |\n"
        "<!-- Slide number: 5 -->\nM4E pilot scale up\nVL123456 with Symex\napproved\n<!-- Slide number: 7 -->\nFormula technical risk assessment\nVL999999 fail"
    )
    slides = chunking.slides(docs(spark, md))
    found = {r["batch_id"]: r for r in chunking.batch_studies(chunking.batch_candidates(slides)).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"VL123456": "Approved", "TC000001": "Stability ok", "VL999999": ""}
    best = found["VL123456"]
    assert (best["slide_number"], best["confidence"], best["locators"], best["batch_size"], best["parameter"]) == (5, "high", ["Slide 2", "Slide 5"], "50 kg", "5 L/min")
    own = docs(spark, md).withColumns({"source_file": F.lit("a.pptx"), "document_kind": F.lit("process_development_presentation")})
    chunks = chunking.chunk_documents(own).orderBy("position").collect()
    assert [r["evidence_type"] for r in chunks] == ["slide"] * 3 + ["topic"] * 3 + ["batch_study"] * 3
    assert [r["chunk_id"] for r in chunks] == [f"d0_{k:04d}" for k in range(1, 10)]
    sheet = docs(spark, "# Plan\n| phase | v |\n|---|---|\n| Pilot | 1 |\n| Production | 2 |\n", "# A\n\ntext")
    kinds = F.when(F.col("doc_id") == 0, "mpdp_table_xlsx").otherwise("document")
    rows = chunking.chunk_documents(sheet.withColumns({"source_file": F.lit("a.xlsx"), "document_kind": kinds})).orderBy("doc_id", "position").collect()
    assert [(r["evidence_type"], r["locator"]) for r in rows] == [
        ("table", "Sheet: Plan / Table 1"), ("table_section", "Sheet: Plan / Phase: Pilot"), ("table_section", "Sheet: Plan / Phase: Production"), ("text", None),
    ]
    assert {r["phase"] for r in chunking.sheet_phases(sheet, {"p": r"\bpilot\b", "mix": r"\bmixing\b"}).collect()} == {"p"}
    assert value(spark, chunking.group_path(F.lit("SY1_PLC+HMI_V2\\Bilder\\Plant\\Unit\\Textfeld 3"))) == "Plant / Unit"
    rows = spark.createDataFrame([(1, 2, "g", "a"), (1, 3, "g", "b")], "doc_id long, row_number int, group_path string, line string")
    assert chunking.row_groups(rows, 1).first()["text"] == "a"


def test_words_of_documents(spark):
    text = "Symex  CML  125 with HMI; commission no. A-17 and commission: make\n- revision:  B\nsee ENG-1234567"
    own = spark.createDataFrame([(1, "/in/SY1234567.pdf", text, "manual_pdf"), (2, "/in/b.pdf", None, None)], "doc_id long, source_path string, markdown string, document_kind string")
    found = {(r["entity_type"], r["entity_text"]) for r in library.group_entities(own).filter("doc_id = 1").collect()}
    assert found == {
        ("organization", "Symex"), ("line", "CML125"), ("equipment", "HMI"), ("commission_number", "A-17"), ("revision", "B"), ("drawing_number", "ENG-1234567"),
        ("project_number", "SY1234567"), ("order_number", "SY1234567"), ("document_type", "operating manual"),
    }
    kind = lambda path, text="": value(spark, R.document_kind(F.lit(path), F.lit(text)))
    assert kind("/a/data.pdf") == "datasheet_pdf" and kind("/P_and_ID/Wiring-Diagram/x.PDF") == "technical_drawing_pdf" and kind("/a/EATON 5.pdf") == "component_document_pdf"
    assert kind("/a/x.docx", "the PPPBC release") == "release_rationale_docx" and kind("x.txt") == "document" and kind("/a/x.pdf", "") == "generic_pdf"
    assert value(spark, R.tags(F.lit("/a/Flowsheet P&ID.pdf"), F.lit("technical_drawing_pdf"), F.lit("low_structure"))) == ["flowsheet", "p-id", "mechanical-design", "pdf", "low-structure", "technical-drawing"]
    assert value(spark, T.section_title(F.lit(" Media  supply. "))) == "Media Supply" and value(spark, T.section_title(F.lit("pump data"))) == "Pump data"
    assert value(spark, T.repaired(F.lit("Est茅e "))) == "Esteé"
    assert value(spark, T.front_matter({"a": F.lit('x: "y" # z'), "n": F.lit(3), "none": F.lit(None).cast("string")}, F.lit("b"))) == '---\na: "x: \\"y\\" # z"\nn: 3\nnone: null\n---\n\nb'
    label = lambda x, base, kind="manual_pdf", title="t": value(spark, concepts.source_type(F.lit(x), F.lit(base), F.lit(kind), F.lit(title)))
    assert label("Risk study", "heading") == "structured_header" and label("pump", "heading", "generic_pdf") == "weak_page_title" and label("pump", "entity", "generic_pdf") == "entity"
    mentions = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (2, "a", "A"), (2, "c", "C")], "doc_id long, entity_id string, label string")
    nodes, edges = concepts.entity_graph(mentions, 2)
    assert [r["entity_id"] for r in nodes.collect()] == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("a", "b", 1)]


def test_records_of_a_library(spark, tmp_path):
    from paperloom.operators import workspace

    folder, path = f"file://{tmp_path}/lib", f"file://{tmp_path}/ws"
    assert workspace.load_record(spark, f"{folder}/x", {"a": 1}) == {"a": 1} and workspace.load_registry(spark, folder).count() == 0
    registry = spark.createDataFrame([("a", 1, 1, "h", "registered"), ("b", 1, 1, "g", "registered")], workspace.REGISTRY_SCHEMA)
    workspace.save_registry(registry, folder)
    assert workspace.save_state(spark, folder)["status"] == "current" and workspace.load_record(spark, f"{folder}/library_state")["counts"]["registered_sources"] == 2
    workspace.add_to_catalog(spark, path, "one", "One", folder, "/src")
    workspace.add_to_catalog(spark, path, "two", "Two", folder)
    now = registry.drop("status").filter("path = 'a'").unionByName(spark.createDataFrame([("c", 2, 2, "z")], "path string, size long, mtime long, sha256 string"))
    review = workspace.kb_review(spark, path, "one", lambda root: now)
    assert (review["change_counts"]["new"], review["change_counts"]["deleted_missing"], review["library_status"]["status"]) == (1, 1, "stale")
    assert workspace.kb_review(spark, path, "two")["warnings"] == [workspace.NO_ROOT]
    with pytest.raises(ValueError):
        workspace.kb_review(spark, path, "three")
    for _ in range(3):
        last = workspace.register_library(spark, path, "/l", "/s", "h", 1, 2, dirty=False)
    assert workspace.register_output(spark, path, "/o", "vault", last["library_version_id"])[0]["library_version_id"] == last["library_version_id"]


def test_packs_and_vault(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    documents = spark.createDataFrame([(1, "one", "# A", "raw", '{"m": 1}'), (2, "two", "# B", "raw", '{"m": 2}')], "doc_id long, output_dir string, markdown string, raw_markdown string, manifest string")
    documents = documents.withColumns({c: F.struct(F.col("doc_id").alias("k")) for c in ("knowledge", "entities", "document")})
    chunks = spark.createDataFrame([(1, 1, "one_2", "second", "p. 2"), (1, 0, "one_1", "first", "p. 1")], "doc_id long, chunk_ord int, chunk_id string, text string, locator string")
    exports.write_packs(documents, chunks, folder)
    lines = [json.loads(x) for x in (tmp_path / "out/one/chunks.jsonl").read_text().splitlines()]
    assert [x["chunk_id"] for x in lines] == ["one_1", "one_2"] and json.loads((tmp_path / "out/one/source_map.json").read_text())["one_2"]["locator"] == "p. 2"
    assert json.loads((tmp_path / "out/two/manifest.json").read_text()) == {"m": 2} and (tmp_path / "out/two/chunks.jsonl").read_text() == "" and json.loads((tmp_path / "out/two/source_map.json").read_text()) == {}
    notes = exports.vault_notes(spark.createDataFrame([(1, "A: b", "k"), (2, "a/ b", "k")], "doc_id long, title string, document_kind string"), spark.createDataFrame([(1, "p")], "doc_id long, preview string"))
    ideas = spark.createDataFrame([("pump", 5.0, 2), ("valve", 4.0, 1)], "label string, weight double, doc_count long")
    evidence = spark.createDataFrame([("pump", "A b", "p. 1", 1), ("pump", "A b", None, 2)], "label string, document_title string, locator string, ord int")
    concept = exports.concept_notes(ideas, evidence, 1, 1)
    assert "- [[A b]] p. 1" in concept.first()["markdown"] and concept.count() == 1
    vault = f"file://{tmp_path}/vault"
    assert exports.export_vault(notes, concept, vault, dry_run=True)["documents_exported"] == 2 and not (tmp_path / "vault").exists()
    exports.export_vault(notes, concept, vault, "fine")
    assert len(list((tmp_path / "vault/Documents").iterdir())) == 2 and "[[pump]]" in (tmp_path / "vault/00_Index.md").read_text()


def test_reuse_and_staging(spark):
    packs = spark.createDataFrame([("p", "n", "success", "h", "h", True, True), ("q", "n", "success", "h", "x", True, True), ("r", "m", None, None, None, None, None)], "path string, name string, manifest_status string, manifest_checksum string, sha256 string, has_chunks boolean, has_document boolean")
    assert {r["path"]: r["refusal"] for r in changes.reuse_refusal(packs).collect()} == {"p": None, "q": "checksum differs", "r": "manifest missing"}
    assert {r["path"]: r["staged"] for r in changes.staged_names(packs).collect()} == {"p": "n", "q": "n-2", "r": "m"}
    scan = "source_id string, source_root string, size_bytes long, modified_time long, sha256 string"
    known = spark.createDataFrame([("a", "/r", 1, 1, None, "active"), ("b", "/r", 1, 1, None, "active"), ("c", "/other", 1, 1, None, "active")], scan + ", status string")
    now = spark.createDataFrame([("a", "/r", 2, 1, None), ("d", "/r", 1, 1, None)], scan)
    assert {r["source_id"]: r["status"] for r in changes.workspace_scan(known, now, ["/r"]).collect()} == {"a": "changed", "b": "missing", "c": "active", "d": "new"}
    assert {r["source_id"]: r["status"] for r in changes.workspace_scan(known, now, ["/r"], limited=True).collect()}["b"] == "active"


def test_greedy_edges_and_neighbourhood(spark):
    edges = spark.createDataFrame([("d1", "x", 5), ("d2", "y", 4), ("d1", "y", 3)], "source string, target string, count long")
    assert {tuple(r) for r in concepts.admit_edges(edges, 3).collect()} == {("d1", "x", 5), ("d1", "y", 3)}
    many = [(f"d{k % 40}", f"c{k * 7 % 90}", 1000 - k) for k in range(400)]
    kept, nodes = [], set()
    for a, b, n in sorted(many, key=lambda x: (-x[2], x[0], x[1])):
        if len(nodes | {a, b}) <= 11:
            nodes |= {a, b}
            kept.append((a, b, n))
    found = concepts.admit_edges(spark.createDataFrame(many, "source string, target string, count long"), 11)
    assert {tuple(r) for r in found.collect()} == set(kept)
    chunks = spark.createDataFrame([(1, 2, "b" * 600), (1, 1, "a")], "doc_id long, chunk_ord int, text string")
    assert concepts.document_preview(chunks).first()["preview"] == "a\n\n" + "b" * 500


def test_located_documents_and_whole_previews_have_no_limit(spark):
    text = "a b " * 300_000 + "end"
    assert value(spark, T.preview(F.lit(text), "", None)) == text and len(value(spark, T.preview(F.lit(text)))) == 222
    own = spark.range(30).select(F.col("id").alias("doc_id"), *[F.concat(F.lit("src1-"), "id").alias(c) for c in ("title", "source_file", "source_path")])
    chunks = spark.range(30).select(F.col("id").alias("doc_id"))
    assert search.located(own, chunks, "src1").count() == 30 and search.locate(own, chunks, "src1").count() == 20


def test_a_ranked_search_scans_its_rows_once(spark):
    """Terms are cut once: statistics come from the scan that keeps the matching rows."""
    df = rows_of(spark, "pump seal", "pump", "other words")
    node = search.parse("pump")
    for found in (search.match_rows(df, "pump"), search.bm25(search.with_terms(df), node, search.predicate(node))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "subquery" not in plan and found.count() == 2


def test_a_build_looks_for_entities_once(spark):
    """What a library's tables share of the texts is kept: none of them looks through the texts for entities again."""
    texts = spark.createDataFrame([(0, "mail a@b.de"), (1, "A@b.de, c@d.fr")], "doc_id long, text string")
    documents = texts.select("doc_id", F.col("doc_id").alias("doc_ord"), F.lit("t").alias("title"), F.lit("s").alias("source_file"))
    chunks = texts.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_ord"), F.lit("t").alias("title"), "text", F.lit("p").alias("locator"), F.array().cast("array<string>").alias("heading_path"))
    assets = spark.createDataFrame([], "asset_id string, doc_id long, path string")
    built = library.build(documents, chunks, library.extract_entities(texts, {"email": library.ENTITY_RULES["email"]}), assets)
    for rows in (built.entities, built.mentions, built.relations):
        assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert built.entities.count() == 2 and built.mentions.count() == 6


def test_noise_goes_through_a_text_once(spark):
    """Each count is taken once a row, whatever is made of it."""
    marked = rows_of(spark, "a b").withColumn("_n", T.noise(F.col("text"), F.col("locator"))).select("_n.is_noisy", F.round("_n.noise_score", 3), "_n.noise_reasons")
    assert marked._jdf.queryExecution().optimizedPlan().toString().count(r"\S+") == 1
    odd = ["<ab> <a> <abc\n> < >", "C:\\x PLC+HMI \\Textfeld", "plc+hmi", "NaN;nan", "+" + "c" * 60, "1 " * 300, "", None]
    found = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, t string").select("k", T.noise(F.col("t"), F.lit("p")).alias("n")).orderBy("k").collect()
    assert [r["n"]["noise_reasons"] for r in found] == [["xml_html_tag_density"], ["windows_or_hmi_path_density"], [], ["nan_density"], ["base64_like"], ["low_natural_language_ratio"], [], []]


def test_texts_without_a_mark_that_matches_hold_are_not_searched(spark):
    """The mark is one that no match can lack; what is found stays the same."""
    email = library.ENTITY_RULES["email"]
    marks = {email: "@", r"a@?b": None, r"a@|b": None, r"(a@)b": None, r"[@]b": None, r"x[]@]y": None, r"(?!@)a:b": ":", r"a@*:+": ":", r"\Qa@\E": None, r"(?x)a # b:\nc": None, r"[\]@]=": "=", r"[a[@]]b": None, r"\@b": None}
    assert {p: T.needed(p) for p in marks} == marks
    assert value(spark, T.distinct_matches(F.lit("a@b.de c@d.fr a@b.de"), email)) == ["a@b.de", "c@d.fr"] and value(spark, T.distinct_matches(F.lit("none"), email)) == []
    assert value(spark, T.distinct_matches(F.lit(None).cast("string"), email)) is None
    plan = library.extract_entities(spark.createDataFrame([(0, "x")], "doc_id long, text string"), {"email": email})._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan.lower()


def test_terms_are_those_of_the_text_that_is_shown(spark):
    odd = ["a  b\tc\n\nd", "NaN | NaN | NaN | z nan", "finance\u00a0\u2003 x", "A" * 70 + "\nB", "C:\\a\\b\\c\\" + "d" * 50 + "\\e f", "ΑΣ\n ΑΣ Β", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    assert df.filter(~T.search_terms(T.searchable(F.col("t"))).eqNullSafe(T.search_terms(T.cleaned(F.col("t"))))).count() == 0
