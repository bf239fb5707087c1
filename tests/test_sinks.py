"""Sinks that appear whole or not at all, portal pages, and digests of folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import reports
from paperloom.sinks import exports, folders
from paperloom.sources import files


def _packs(spark, n=30):
    documents = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("output_dir"), F.lit("# é\n").alias("markdown"), F.lit(None).cast("string").alias("raw_markdown"),
        F.to_json(F.struct(F.concat(F.lit("f"), F.col("id").cast("string")).alias("source_file"), F.lit("success").alias("status"))).alias("manifest"),
        *[F.struct(F.col("id").alias("k")).alias(c) for c in ("knowledge", "entities", "document")],
    )
    chunks = spark.range(200).select((F.col("id") % (n - 1)).alias("doc_id"), F.col("id").alias("chunk_ord"), F.concat(F.lit('c"'), F.col("id").cast("string")).alias("chunk_id"), F.concat(F.lit("line\n"), F.col("id").cast("string")).alias("text"), F.lit("p. 1").alias("locator"))
    return documents, chunks.repartition(5)


def test_packs_are_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    documents, chunks = _packs(spark)
    exports.write_packs(documents, chunks, folder)
    back = files.read_packs(spark, folder)
    assert back["manifests"].count() == 30 and back["warnings"].count() == 0
    got = {(r["chunk_id"], r["text"]) for r in back["chunks"].select("chunk_id", "text").collect()}
    assert got == {(f'c"{k}', f"line\n{k}") for k in range(200)}
    places = json.loads((tmp_path / "out/d3/source_map.json").read_text())
    assert list(places) == [f'c"{k}' for k in range(3, 200, 29)] and places['c"3'] == {"chunk_id": 'c"3', "locator": "p. 1"}
    assert json.loads((tmp_path / "out/d29/source_map.json").read_text()) == {} and (tmp_path / "out/d29/chunks.jsonl").read_text() == ""
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"d{k}" for k in range(30))


def test_reading_packs_sends_no_list_of_files(spark, tmp_path):
    from paperloom.sources import files as sources

    root = tmp_path / "a b%é"
    for k in range(60):
        own = root / f"d {k}" / ("deep/er" if k % 7 == 0 else "")
        own.mkdir(parents=True)
        (own / "manifest.json").write_bytes(b'{"source_file": "f%d",\r\n "status": "success"}' % k)
        (own / "chunks.jsonl").write_bytes("\ufeff{\"chunk_id\": \"a\u2028é\"}\r\n\n{\"chunk_id\": \"b\"}\rbad".encode() + b"\n\xff" * (k == 5))
        (own / "knowledge.json").write_text("{}")
    for name in ("_left/x", ".left"):
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text('{"source_file": "none"}')
    (root / "manifest.json").write_text('{"source_file": "top"}')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("packs", "read")
    back = sources.read_packs(spark, str(root))
    assert not tracker.getJobIdsForGroup("packs")  # 63 folders are no job of the driver's index
    got = {name: sorted(map(str, back[name].collect())) for name in back}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got["manifests"]) == 61 and len(got["chunks"]) == 120 and len(got["warnings"]) == 61
    kept, sources._texts_below = sources._texts_below, lambda *_: None
    try:
        back = sources.read_packs(spark, f"file://{root}")  # as Spark's own readers do it
        assert got == {name: sorted(map(str, back[name].collect())) for name in back}
        few = {name: sorted(map(str, x.collect())) for name, x in sources.read_packs(spark, str(root / "d 7")).items()}
    finally:
        sources._texts_below = kept
    assert few == {name: sorted(map(str, x.collect())) for name, x in sources.read_packs(spark, str(root / "d 7")).items()}


def test_a_failed_job_leaves_nothing_and_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    documents, chunks = _packs(spark)
    exports.write_packs(documents.filter("doc_id < 3"), chunks, folder)
    before = {p: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    with pytest.raises(Exception, match="not empty"):
        exports.write_packs(documents, chunks, folder)  # d0 is there
    broken = documents.withColumn("markdown", F.when(F.col("doc_id") == 17, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        exports.write_packs(broken, chunks, folder, replace=True)
    bad = folders._Writer(folder, 1, True)

    def rows():
        yield {"path": "x/a", "glue": None, "text": "1"}
        raise OSError("gone")

    with pytest.raises(OSError):
        bad.write(rows())
    bad.abort([])
    assert {p: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == before and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    exports.write_packs(documents.withColumn("markdown", F.lit("new")), chunks, folder, replace=True)
    assert (tmp_path / "out/d2/document.md").read_text() == "new" and len(list((tmp_path / "out").iterdir())) == 30


def test_a_second_attempt_of_a_task_is_left_out(spark, tmp_path):
    writer = folders._Writer(f"file://{tmp_path}/out", 1, False)
    row = lambda path, text, glue=None: {"path": path, "glue": glue, "text": text}
    lost = writer.write(iter([row("a/x", "half")]))  # its executor is lost: no message reaches the driver
    one = writer.write(iter([row("a/x", "whole"), row("a/y", "1", ","), row("a/y", "2", ","), row("a/y", "!", None)]))
    writer.commit([one, None])
    assert lost.folder != one.folder and (tmp_path / "out/a/x").read_text() == "whole" and (tmp_path / "out/a/y").read_text() == "1,2!"
    assert folders.listed(f"file://{tmp_path}/out") == ["a"] and folders.listed(f"file://{tmp_path}/none") == []


def test_vault_is_whole(spark, tmp_path):
    notes = spark.createDataFrame([("b", "B"), ("a", "A")], "name string, markdown string")
    concepts = spark.createDataFrame([("c", "C")], "name string, markdown string")
    vault = f"file://{tmp_path}/v"
    with pytest.raises(Exception, match="lost"):
        exports.export_vault(notes, concepts.withColumn("markdown", F.raise_error(F.lit("lost"))), vault)
    assert folders.listed(vault) == []
    exports.export_vault(notes, concepts, vault, "fine")
    assert (tmp_path / "v/00_Index.md").read_text() == "# Documents\n\n- [[a]]\n- [[b]]\n\n# Concepts\n\n- [[c]]\n\n"
    assert (tmp_path / "v/Documents/a.md").read_text() == "A" and json.loads((tmp_path / "v/export_manifest.json").read_text())["concepts_exported"] == 1
    with pytest.raises(ValueError, match="not empty"):
        exports.export_vault(notes, concepts, vault)
    exports.export_vault(notes.limit(1), concepts, vault, overwrite=True)


def _library(spark):
    documents = spark.createDataFrame(
        [(1, 1, "Pump", "a.pdf", "pump", "manual_pdf", "ok", 2), (2, 2, "Valve", "b.pdf", "valve", "manual_pdf", "low_structure", 0), (3, 3, "Sheet", "c.xlsx", "sheet", "hmi", "visual_only", None), (4, 4, "Alarm", "d.pdf", "alarm", "fault_pdf", "low_structure", 0)],
        "doc_id long, doc_ord long, title string, source_file string, output_dir string, document_kind string, quality_status string, missing_assets_count int",
    )
    chunks = spark.createDataFrame(
        [(1, "1a", 0, "t", "text x", "text", None, False, "raw_markdown", "Mixing", "B1"), (1, "1b", 1, "t", "more", "page", "p. 2", False, "page", "Mixing", None), (2, "2a", 0, "t", "z", "page", "p. 1", False, "page", "Mixing", "B1"),
         (3, "3a", 0, "Rows", "z", "table_section", "S!1", True, "page", None, None), (4, "4a", 0, "t", "z", "page", "p. 9", False, "page", "", None)],
        "doc_id long, chunk_id string, chunk_ord long, title string, text string, evidence_type string, locator string, is_noisy boolean, provenance_status string, topic_label string, batch_id string",
    )
    entities = spark.createDataFrame([("e1", "part", "Pump", "pump", 3, 1), ("e2", "part", "axle", "axle", 1, 2), ("e3", "kind", "Pump", "pump", 1, 3)], "entity_id string, entity_type string, entity_text string, normalized_text string, mention_count long, first_ord long")
    mentions = spark.createDataFrame([("e1", 1, None), ("e1", 2, None), ("e1", 3, None), ("e2", 1, None), ("e3", 4, None), ("e2", 4, "4a")], "entity_id string, doc_id long, chunk_id string")
    assets = spark.createDataFrame([(2, "x"), (4, "y")], "doc_id long, path string")
    return documents, chunks, entities, mentions, assets


PAGES = {
    "_library.md": "# Knowledge Library\n\n## Library Summary\n\n- documents_count: 4\n- chunks_count: 5\n- entities_count: 3\n\n## Document Kind Distribution\n\n- manual_pdf: 2\n- hmi: 1\n- fault_pdf: 1\n\n## Documents by Type\n\n"
    "### fault_pdf\n\n- [Alarm](alarm/document.md)\n\n### hmi\n\n- [Sheet](sheet/document.md)\n\n### manual_pdf\n\n- [Pump](pump/document.md)\n- [Valve](valve/document.md)\n\n## Key Entities\n\n- Pump (kind, part): 4\n- axle (part): 1\n\n"
    "## Key Topics\n\n- Mixing\n\n## Batch IDs\n\n- B1\n\n## Quality Issues\n\n",
    "_documents.md": "# Documents\n\n## fault_pdf\n\n| Title | Source File | Quality | Output |\n|---|---|---|---|\n| Alarm | d.pdf | low_structure | alarm |\n\n## hmi\n\n| Title | Source File | Quality | Output |\n|---|---|---|---|\n| Sheet | c.xlsx | visual_only | sheet |\n\n"
    "## manual_pdf\n\n| Title | Source File | Quality | Output |\n|---|---|---|---|\n| Pump | a.pdf | ok | pump |\n| Valve | b.pdf | low_structure | valve |\n",
    "_entities.md": "# Entities\n\n## kind\n\n- Pump: Alarm\n\n## part\n\n- axle: Pump\n- Pump: Pump, Sheet, Valve\n",
    "_topics.md": "# Topics\n\n- Mixing: 3 chunks; p. 1, p. 2\n- Rows: 1 chunks; S!1\n",
    "_batches.md": "# Batches\n\n## B1\n\n- Pump: ; confidence=; text x\n- Valve: p. 1; confidence=; z\n",
    "_quality_report.md": "# Quality Report\n\n## Failed Documents\n\n- x: failed\n\n## Page-Level Searchable PDFs\n\n- page_level_pdf_count: 2\n- Valve: manual_pdf, low_structure, locators=1, assets=1\n- Alarm: fault_pdf, low_structure, locators=1, assets=1\n\n## Low Structure\n\n_None._\n\n"
    "## Visual Only / Image Only\n\n- Sheet\n\n## Missing / Embedded Assets\n\n- Pump: missing_assets_count=2, embedded_images_count=0\n\n## Chunks Without Locator\n\n- chunks_without_locator: 1\n" + exports.LOCATOR_NOTE + "\n\n### By Document Kind\n\n- manual_pdf: 1\n\n"
    "### By Evidence Type\n\n- text: 1\n\n### By Source Extension\n\n- .pdf: 1\n",
}


def test_portal_pages(spark, tmp_path):
    lines = exports.portal(*_library(spark), warnings=["x: failed", "other"])
    exports.write_portal(lines, f"file://{tmp_path}/portal")
    for name, text in PAGES.items():
        own = (tmp_path / "portal" / name).read_text()
        assert own.startswith(text) if name == "_library.md" else own == text, own
    empty = [x.limit(0) for x in _library(spark)]
    exports.write_portal(exports.portal(*empty), f"file://{tmp_path}/portal")
    assert "_No quality issues detected._" in (tmp_path / "portal/_library.md").read_text() and "_None._" in (tmp_path / "portal/_quality_report.md").read_text()


def test_long_files_are_put_together_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "BLOCK_BYTES", 300)
    rows = spark.range(5000).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("path"), F.struct((F.col("id") * 7919 % 5000).alias("a"), F.lit("x").alias("b")).alias("place"),
        F.when(F.col("id") * 7919 % 5000 % 40 > 2, F.lit(", ")).alias("glue"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = folders._blocks(rows.repartition(6)).select("path", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) < 2500 and len({r["place"]["range"] for r in found}) > 1  # a page's task had all of its 2,500 rows before
    folders.write_files(rows, f"file://{tmp_path}/one")
    folders.write_files(rows.repartition(6), f"file://{tmp_path}/two", long=True)
    for name in ("f0", "f1"):
        own = (tmp_path / "one" / name).read_text()
        assert own == (tmp_path / "two" / name).read_text() and own.count("é") > 2000
    found = {r["name"]: r["digest"] for r in files.file_digests(spark, [f"file://{tmp_path}/two/f{k}" for k in (0, 1)]).collect()}
    assert found == {f"f{k}": hashlib.md5((tmp_path / f"one/f{k}").read_bytes()).hexdigest() for k in (0, 1)}


def test_folder_digest_is_a_fold(spark):
    rows = [(g, f"{'A' if k % 3 else 'b'}{k}", str(k * 7)) for g in ("x", None, "y") for k in range(40)]
    df = spark.createDataFrame(rows, "g string, p string, s string").repartition(6)
    found = reports.folder_digest(df, "g", F.col("p"), F.col("s"))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        own = sorted((p.lower(), p, s) for g, p, s in rows if g == r["g"])
        assert r["file_count"] == 40 and r["digest"] == hashlib.sha256("".join(f"{p}\n{s}\n" for _, p, s in own).encode()).hexdigest()
    assert reports.folder_digest(df.limit(0), "g", F.col("p"), F.col("s")).count() == 0
