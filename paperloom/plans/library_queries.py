"""Queries over libraries that are written and read back, and over several libraries at once."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodies, concepts, kb, knowledge, library, reports, workspace
from ..sinks import exports
from ..sinks.folders import write_files
from ..sources import files, office
from ..tables import fresh_path, written
from .queries import _ADJUST, _BUILD_SQL, _EMAIL, _INDEXED_TEXT, _LIB, _RULES, _TERMS, _WORDS_SQL, lib, query, searchable_lib, table

# --- what is written and read back ----------------------------------------------------------------------------------------


@query("SELECT concat('conv_', conv_id, '_', turn) AS chunk_id, concat('conv_', conv_id, '.pdf') AS source_file, concat('t. ', turn) AS locator, md5(text) AS digest FROM conversations")
def packs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packs: the files of all of them are written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    manifest = F.struct(F.concat(name, F.lit(".pdf")).alias("source_file"), F.lit("success").alias("status"))
    documents = turns.select("conv_id").distinct().select(F.col("conv_id").alias("doc_id"), name.alias("output_dir"), F.concat(F.lit("# "), name).alias("markdown"), F.lit("").alias("raw_markdown"), *[manifest.alias(c) for c in ("manifest", "knowledge", "entities", "document")])
    turn = F.col("turn").cast("string")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_ord"), F.concat(name, F.lit("_"), turn).alias("chunk_id"), "text", F.concat(F.lit("t. "), turn).alias("locator"))
    folder = fresh_path(spark, "packs")
    exports.write_packs(documents, chunks, folder)
    back = files.read_packs(spark, folder)
    found = back["chunks"].select("doc_dir", "chunk_id", "locator", "text").join(back["manifests"].select("doc_dir", "source_file"), "doc_dir")
    return found.select("chunk_id", "source_file", "locator", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT part, n FROM (" + _BUILD_SQL + ") WHERE part <> 'indexed_entities' UNION ALL SELECT 'indexed', count(*) FROM documents UNION ALL SELECT 'assets', count(*) FROM pages")
def library_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library with assets (pages), written with its index; rows of the tables that are read back."""
    rows = lib(spark, sf_dir).withColumns({"doc_ord": F.col("doc_id"), "heading_path": F.array().cast("array<string>")})
    entities = library.extract_entities(table(spark, sf_dir, "documents"), _RULES)
    assets = table(spark, sf_dir, "pages").select(F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("asset_id"), F.col("page_id").alias("doc_id"), F.col("url").alias("path"))
    shown = ["doc_id", "doc_ord", "title", "source_file", "source_path", "document_kind", "output_dir"]
    built = library.build(rows.select(*shown), rows.drop(*shown[1:2], *shown[3:]), entities, assets)
    folder = workspace.build_library(built, fresh_path(spark, "libraries"))
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    parts = {name: read(name) for name in ("documents", "chunks", "entities", "mentions", "assets")} | {"relations": read("relations").filter("relation_type <> 'document_has_asset'"), "indexed": read("index")}
    return reduce(DataFrame.unionByName, (r.groupBy().agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, r in parts.items()))


_NOTE = "concat('---', chr(10), 'doc_id: ', item_id, chr(10), 'document_kind: \"k', item_id % 3, '\"', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), text)"


@query(
    "WITH n AS (SELECT item_id, text, concat('Item ', item_id % 40) AS title FROM benchmark), m AS (SELECT title, min(item_id) AS first FROM n GROUP BY title) "
    f"SELECT concat('Documents/', n.title, CASE WHEN n.item_id = m.first THEN '' ELSE concat('-', sha1(CAST(n.item_id AS VARCHAR))[1:8]) END, '.md') AS path, md5({_NOTE.replace('title', 'n.title')}) AS digest FROM n JOIN m USING (title)"
)
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as notes of a vault, which is written and read back; names are unique."""
    items = table(spark, sf_dir, "benchmark")
    documents = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Item "), (F.col("item_id") % 40).cast("string")).alias("title"), F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string")).alias("document_kind"))
    notes = exports.vault_notes(documents, items.select(F.col("item_id").alias("doc_id"), F.col("text").alias("preview")))
    concepts = spark.createDataFrame([], "name string, markdown string")
    folder = fresh_path(spark, "vault")
    exports.export_vault(notes, concepts, folder)
    back = spark.read.text(f"{folder}/Documents", wholetext=True).select("value", F.concat(F.lit("Documents/"), F.col("_metadata.file_name")).alias("path"))
    return back.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.md5(F.col("value").cast("binary")).alias("digest"))


_PAGES = (
    _LIB + ", d AS (SELECT lib.*, CASE WHEN quality = 0 THEN 'low_structure' ELSE 'ok' END AS quality_status FROM lib LEFT JOIN labels USING (doc_id)), "
    "k AS (SELECT document_kind, string_agg(concat('| ', title, ' | ', source_file, ' | ', quality_status, ' | ', output_dir, ' |', chr(10)), '' ORDER BY doc_id) AS t FROM d GROUP BY document_kind), "
    f"e AS (SELECT lower(entity_text) AS norm, arg_min(entity_text, doc_id) AS name FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS entity_text FROM documents) GROUP BY lower(entity_text)), "
    f"m AS (SELECT DISTINCT lower(x.entity_text) AS norm, d.title FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS entity_text FROM documents) x JOIN d USING (doc_id)), "
    "l AS (SELECT e.name, e.norm, string_agg(m.title, ', ' ORDER BY m.title) AS t FROM e JOIN m USING (norm) GROUP BY e.name, e.norm), "
    "c AS (SELECT role, concat('t. ', turn) AS locator FROM conversations), "
    "o AS (SELECT role, count(*) AS n, array_to_string(list_sort(list(DISTINCT locator))[1:10], ', ') AS t FROM c GROUP BY role) "
    r"SELECT '_documents.md' AS page, md5(concat('# Documents', chr(10), chr(10), (SELECT string_agg(concat('## ', document_kind, chr(10), chr(10), '| Title | Source File | Quality | Output |', chr(10), '|---|---|---|---|', chr(10), t), chr(10) ORDER BY document_kind) FROM k))) AS digest "
    "UNION ALL SELECT '_entities.md', md5(concat('# Entities', chr(10), chr(10), '## email', chr(10), chr(10), (SELECT string_agg(concat('- ', name, ': ', t, chr(10)), '' ORDER BY norm) FROM l))) "
    "UNION ALL SELECT '_topics.md', md5(concat('# Topics', chr(10), chr(10), (SELECT string_agg(concat('- ', role, ': ', n, ' chunks; ', t, chr(10)), '' ORDER BY role) FROM o))) UNION ALL SELECT '_batches.md', md5(concat('# Batches', chr(10)))"
)


@query(_PAGES)
def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the portal, written and read back: documents, e-mail addresses as entities, roles as topics."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    shown = lib(spark, sf_dir).select("doc_id", "title", "source_file", "output_dir", "document_kind").join(labels, "doc_id", "left")
    documents = written(shown.withColumns({"doc_ord": F.col("doc_id"), "quality_status": F.when(F.col("quality") == 0, "low_structure").otherwise("ok")}), "portal-documents")  # pages read them many times
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_ord"), "text", F.col("role").alias("topic_label"), F.concat(F.lit("t. "), F.col("turn").cast("string")).alias("locator"))
    chunks = turns.withColumns({"chunk_id": F.col("locator"), "title": F.lit("t"), "evidence_type": F.lit("text"), "is_noisy": F.lit(False), "provenance_status": F.lit("page_text")})
    found = written(library.extract_entities(table(spark, sf_dir, "documents"), {"email": _EMAIL}), "portal-entities").withColumn("ord", F.struct("doc_id", "position"))
    entities = library.dedupe_entities(found)
    mentions = found.withColumn("normalized_text", F.lower("entity_text")).join(entities.select("normalized_text", "entity_id"), "normalized_text").select("entity_id", "doc_id", F.lit(None).cast("string").alias("chunk_id"))
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    folder = fresh_path(spark, "portal")
    lines = exports.portal(documents, chunks, entities, mentions, assets)
    exports.write_portal(lines.withColumn("page", F.ltrim("page", F.lit("_"))), folder)  # readers skip names that begin so
    shown = [f"{folder}/{name.lstrip('_')}" for name in exports.PORTAL[1:5]]
    return files.file_digests(spark, shown).select(F.concat(F.lit("_"), "name").alias("page"), "digest")


_RECORDS = _LIB + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, chunk_id AS id, md5(text) AS digest, concat_ws('|', doc_id, source_file, source_path, document_kind, evidence_type, locator) AS metadata, {more} AS more FROM lib"
    for kind, more in (("llamaindex", "''"), ("haystack", "''"), ("txtai", "document_kind"), ("graphrag", "concat_ws('|', title, source_file)"))
)


@query(_RECORDS)
def interop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four formats, written as JSON lines and read back."""
    folder = fresh_path(spark, "interop")
    exports.write_interop(lib(spark, sf_dir), folder)
    out = []
    for kind, (ident, text, metadata) in exports.FORMATS.items():
        own = spark.read.json(f"{folder}/{kind}", schema=exports.interop(lib(spark, sf_dir), kind).schema)
        more = {"txtai": F.array_join("tags", "|"), "graphrag": F.concat_ws("|", "title", "source")}.get(kind, F.lit(""))
        fields = [F.col(f"{metadata}.{c}").cast("string") for c in exports.METADATA]
        out.append(own.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.md5(F.col(text).cast("binary")).alias("digest"), F.concat_ws("|", *fields).alias("metadata"), more.alias("more")))
    return reduce(DataFrame.unionByName, out)


_INDEX_SQL = (
    _LIB + f", m AS (SELECT DISTINCT doc_id, lower(x) AS norm FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS x FROM documents)), "
    "c AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id), e AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) "
    "SELECT 'documents_count' AS key, '' AS value, count(*) AS n FROM lib UNION ALL SELECT 'chunks_count', '', count(*) FROM conversations UNION ALL SELECT 'entities_count', '', count(DISTINCT norm) FROM m "
    "UNION ALL SELECT 'document_kind', document_kind, count(*) FROM lib GROUP BY document_kind UNION ALL SELECT 'evidence_type', role, count(*) FROM conversations GROUP BY role "
    "UNION ALL SELECT * FROM (SELECT 'top', norm, count(*) AS n FROM m GROUP BY norm ORDER BY n DESC, norm LIMIT 25) "
    "UNION ALL SELECT 'document', concat(lib.doc_id, '|', output_dir, '|', coalesce(e.n, 0)), coalesce(c.n, 0) FROM lib LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)"
)


@query(_INDEX_SQL)
def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a library as one JSON file, written and read back: documents, turns as chunks, e-mail addresses as entities."""
    documents = lib(spark, sf_dir).withColumn("doc_ord", F.col("doc_id"))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_ord"), F.col("role").alias("evidence_type"))
    found = library.extract_entities(table(spark, sf_dir, "documents"), {"email": _EMAIL}).withColumn("ord", F.struct("doc_id", "position"))
    entities = library.dedupe_entities(found)
    keyed = found.withColumn("normalized_text", F.lower("entity_text")).groupBy("doc_id", "normalized_text").agg(F.min("ord").alias("ord"))
    mentions = keyed.join(entities.select("normalized_text", "entity_id"), "normalized_text").select("entity_id", "doc_id", F.lit(None).cast("string").alias("chunk_id"), "ord")
    folder = fresh_path(spark, "index-json")
    write_files(exports.library_index(documents, chunks, entities, mentions), folder)
    counts = ("documents_count", "chunks_count", "entities_count")
    schema = ", ".join(f"{c} long" for c in counts) + ", document_kind_distribution map<string,long>, evidence_type_distribution map<string,long>, top_entities array<struct<normalized_text: string, count: long>>, documents array<struct<doc_id: long, output_dir: string, chunks_count: long, entities: array<string>>>"
    read = spark.read.json(f"{folder}/library_index.json", schema=schema, multiLine=True)
    shown = lambda rows, key, value, n: rows.select(F.lit(key).alias("key"), value.alias("value"), n.cast("long").alias("n"))
    each = lambda column, *names: read.select(F.explode(column).alias(*names))
    parts = [shown(read, c, F.lit(""), F.col(c)) for c in counts]
    parts += [shown(each(f"{c}_distribution", "k", "v"), c, F.col("k"), F.col("v")) for c in ("document_kind", "evidence_type")]
    parts.append(shown(each("top_entities", "t"), "top", F.col("t.normalized_text"), F.col("t.count")))
    of_document = F.concat_ws("|", F.col("d.doc_id").cast("string"), "d.output_dir", F.size("d.entities").cast("string"))
    parts.append(shown(each("documents", "d"), "document", of_document, F.col("d.chunks_count")))
    return reduce(DataFrame.unionByName, parts)


def _word_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (conv_id, turns) as docx files: a heading, a paragraph for each turn, and a table of the turns' roles."""
    for batch in batches:
        paths, contents = [], []
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t["text"] or "")}</w:t></w:r></w:p>' for t in turns)
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(str(x))}</w:t></w:r></w:p></w:tc>" for x in row) + "</w:tr>" for row in [("turn", "role"), *((t["turn"], t["role"]) for t in turns)])
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/styles.xml", '<w:styles><w:style w:styleId="One"><w:name w:val="heading 1"/></w:style></w:styles>')
                z.writestr("word/document.xml", f'<w:body><w:p><w:pPr><w:pStyle w:val="One"/></w:pPr><w:r><w:t>Conversation {conv_id}</w:t></w:r></w:p>{said}<w:tbl>{rows}</w:tbl></w:body>')
            paths.append(f"conv_{conv_id}.docx")
            contents.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(["docx"] * len(paths), pa.string()), pa.array(contents, pa.binary())], names=["path", "extension", "content"])


_TRIMMED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    f"WITH c AS (SELECT conv_id, turn, role, {_TRIMMED} AS t FROM conversations), n AS (SELECT chr(10) AS l) SELECT concat('conv_', conv_id, '.docx') AS path, md5(concat('# Conversation ', conv_id, l, l, "
    "string_agg(concat(t, l, l), '' ORDER BY turn) FILTER (t <> ''), '| turn | role |', l, '| --- | --- |', l, string_agg(concat('| ', turn, ' | ', role, ' |', l), '' ORDER BY turn))) AS digest FROM c, n GROUP BY conv_id, l"
)
def office_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as office files, and the Markdown that those are converted to."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # a conversation is a file
    made = turns.mapInArrow(_word_file, "path string, extension string, content binary")
    return office.markdown(made).select("path", F.md5(F.col("markdown").cast("binary")).alias("digest"))


# --- several libraries ----------------------------------------------------------------------------------------------------

_SCORE = "(-sum(greatest(ln((s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.dl / s.mean))))"
_CONTEXT_SQL = (
    _LIB + ", t AS (SELECT *, " + _TERMS.format("concat_ws(' ', title, " + _INDEXED_TEXT + ", locator)") + " AS w FROM lib), "
    "s AS (SELECT lang, count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS mean FROM t GROUP BY lang), x AS (SELECT lang, doc_id, unnest(w) AS term, len(w)::DOUBLE AS dl FROM t), "
    "tf AS (SELECT lang, doc_id, term, dl, count(*)::DOUBLE AS tf FROM x WHERE term IN ('tion', 'reed', 'eou') GROUP BY ALL), df AS (SELECT lang, term, count(*)::DOUBLE AS df FROM tf GROUP BY lang, term), "
    f"b AS (SELECT tf.lang, tf.doc_id, tf.term, {_SCORE} AS bm25 FROM tf JOIN df USING (lang, term) JOIN s USING (lang) GROUP BY tf.lang, tf.doc_id, tf.term), "
    f"a AS (SELECT b.*, {_ADJUST} AS adjustment FROM b JOIN lib USING (doc_id)), "
    "one AS (SELECT lang, doc_id, 0 AS stage, [round(sum(bm25) + any_value(adjustment), 9)] AS o FROM a WHERE term IN ('tion', 'reed') GROUP BY lang, doc_id HAVING count(*) = 2), "
    "two AS (SELECT lang, doc_id, 1 AS stage, [round(bm25 + adjustment, 9)] AS o FROM a WHERE term = 'eou'), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY lang, term ORDER BY round(bm25 + adjustment, 9), doc_id) AS k FROM a WHERE term IN ('tion', 'reed')), "
    "three AS (SELECT lang, doc_id, 3 AS stage, [-count(*)::DOUBLE, any_value(adjustment), min(k)::DOUBLE] AS o FROM p WHERE k <= 250 GROUP BY lang, doc_id), "
    "u AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three), f AS (SELECT lang, min(stage) AS stage FROM u GROUP BY lang), "
    "r AS (SELECT u.*, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total_hits FROM u JOIN f USING (lang, stage)) "
    "SELECT lang AS library_id, CASE lang WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS library_order, stage, rank, doc_id, total_hits FROM r WHERE rank <= 4 AND lang <> 'de'"
)


@query(_CONTEXT_SQL)
def kb_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the languages as libraries that end in different stages of one cascade: the query, its alias, its tokens."""
    rows = searchable_lib(spark, sf_dir).withColumn("library_id", F.col("lang"))
    found = kb.evidence(rows, "tion reed", 4, ["es", "en", "fr"], aliases={"tion reed": ["eou"]})
    return found.select("library_id", "library_order", "stage", "rank", F.col("chunk_id").cast("long").alias("doc_id"), "total_hits")


# --- reports and graphs ---------------------------------------------------------------------------------------------------

_REPORT_DOCUMENTS = """SELECT d.doc_id, concat('T', CAST(d.doc_id AS STRING)) AS title, concat(source, CASE lang WHEN 'en' THEN '.docx' WHEN 'de' THEN '.XLSX' WHEN 'fr' THEN '.pdf' ELSE '' END) AS source_file,
CASE lang WHEN 'en' THEN 'manual_pdf' WHEN 'de' THEN 'generic_pdf' WHEN 'fr' THEN 'hmi_translation_xlsx' ELSE 'document' END AS document_kind, source AS output_dir,
CASE WHEN quality = 0 THEN 'low_structure' WHEN toxic = 1 THEN 'visual_only' ELSE 'ok' END AS quality_status, CAST(d.doc_id % 4 AS INT) AS missing_assets_count FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
_REPORT_CHUNKS = """SELECT conv_id AS doc_id, CASE WHEN turn < 2 THEN 'page' WHEN role = 'user' THEN 'text_page' ELSE 'text' END AS evidence_type, CASE WHEN role = 'user' OR conv_id % 3 = 0 THEN 'p. 1' END AS locator,
turn > 5 AND conv_id % 2 = 0 AS is_noisy, CASE WHEN turn < 3 THEN concat('B', CAST(conv_id % 15 AS STRING)) END AS batch_id, CASE WHEN turn < 4 THEN 'raw_markdown' ELSE 'page_text' END AS provenance_status FROM {conversations}"""
_REPORT_SQL = (
    "WITH d AS (" + _REPORT_DOCUMENTS.format(documents="documents", labels="labels") + "), c AS (" + _REPORT_CHUNKS.format(conversations="conversations") + "), "
    f"e AS (SELECT lower(x) AS norm, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS x FROM documents) GROUP BY lower(x)), "
    r"j AS (SELECT c.*, d.title, d.source_file, d.output_dir, coalesce(d.document_kind, '') AS document_kind, d.quality_status, CASE WHEN regexp_matches(coalesce(d.source_file, ''), '\.[^.]+$') THEN lower(regexp_extract(d.source_file, '\.([^.]+)$', 1)) ELSE 'unknown' END AS extension FROM c LEFT JOIN d USING (doc_id)), "
    "m AS (SELECT * FROM j WHERE locator IS NULL), "
    "g AS (SELECT doc_id, any_value(title) AS title, any_value(source_file) AS source_file, count(*) FILTER (evidence_type IN ('page', 'text_page')) AS pages, count(locator) FILTER (evidence_type IN ('page', 'text_page')) AS located, count(*) FILTER (is_noisy) AS noisy, count(*) FILTER (locator IS NULL) AS missing, count(*) FILTER (locator IS NULL AND provenance_status = 'raw_markdown') AS raw, array_to_string(list_sort(list(DISTINCT evidence_type) FILTER (locator IS NULL)), ',') AS kinds FROM j GROUP BY doc_id), "
    "a AS (SELECT page_id AS doc_id, count(*) AS n FROM pages GROUP BY page_id), "
    r"p AS (SELECT d.doc_id, d.title, g.pages, g.located, a.n FROM d JOIN g USING (doc_id) JOIN a USING (doc_id) WHERE quality_status = 'low_structure' AND ends_with(document_kind, '_pdf') AND pages > 0 AND located > 0 AND noisy = 0) "
    "SELECT 'documents_count' AS part, '' AS key, count(*) AS n FROM d UNION ALL SELECT 'chunks_count', '', count(*) FROM c UNION ALL SELECT 'entities_count', '', count(*) FROM e "
    "UNION ALL SELECT 'document_kind_distribution', document_kind, count(*) FROM d GROUP BY document_kind UNION ALL SELECT 'evidence_type_distribution', evidence_type, count(*) FROM c GROUP BY evidence_type "
    "UNION ALL SELECT 'top_entities', CAST(n AS VARCHAR), count(*) FROM (SELECT n FROM e ORDER BY n DESC LIMIT 10) GROUP BY n "
    "UNION ALL SELECT * FROM (SELECT 'top_batches', batch_id, count(*) AS n FROM c WHERE batch_id IS NOT NULL GROUP BY batch_id ORDER BY n DESC, batch_id LIMIT 10) "
    "UNION ALL SELECT 'missing_assets_summary', title, missing_assets_count FROM d WHERE missing_assets_count > 0 "
    "UNION ALL SELECT 'low_quality_documents', concat(title, '|', quality_status), doc_id FROM d WHERE quality_status IN ('low_structure', 'visual_only') AND doc_id NOT IN (SELECT doc_id FROM p) "
    "UNION ALL SELECT 'page_level_pdf_documents', concat(title, '|', pages, '|', located), n FROM p UNION ALL SELECT 'noisy_chunks_count', '', count(*) FROM c WHERE is_noisy UNION ALL SELECT 'chunks_without_locator', '', count(*) FROM m "
    "UNION ALL SELECT 'chunks_without_locator_by_document_kind', document_kind, count(*) FROM m GROUP BY document_kind UNION ALL SELECT 'chunks_without_locator_by_evidence_type', evidence_type, count(*) FROM m GROUP BY evidence_type "
    "UNION ALL SELECT 'chunks_without_locator_by_extension', extension, count(*) FROM m GROUP BY extension "
    "UNION ALL SELECT * FROM (SELECT 'chunks_without_locator_top_sources', concat(title, '|', raw, '|', kinds), missing FROM g WHERE missing > 0 AND source_file IS NOT NULL ORDER BY missing DESC, source_file, doc_id LIMIT 20) "
    "UNION ALL SELECT 'office_raw_markdown_missing_locator_summary', extension, count(*) FROM m WHERE provenance_status = 'raw_markdown' AND extension IN ('docx', 'xlsx', 'pptx', 'doc', 'xls', 'ppt') GROUP BY extension "
    "UNION ALL SELECT 'noisy_documents', title, noisy FROM g WHERE noisy > 0 AND title IS NOT NULL UNION ALL SELECT 'hmi_translation_documents', concat(title, '|', source_file), 1 FROM d WHERE document_kind = 'hmi_translation_xlsx' UNION ALL SELECT 'export_files_generated', unnest(['a.md', 'b.md']), 1"
)
_NAMED = {
    "top_entities": ("cast(mention_count AS string)", "1"), "missing_assets_summary": ("title", "missing"), "low_quality_documents": ("concat(title, '|', quality_status)", "doc_id"),
    "page_level_pdf_documents": ("concat(title, '|', page_level_chunks, '|', locator_chunks)", "asset_count"), "noisy_documents": ("title", "noisy_chunks_count"), "hmi_translation_documents": ("concat(title, '|', source_file)", "1"),
    "chunks_without_locator_top_sources": ("concat(title, '|', raw_markdown_chunks, '|', array_join(evidence_types, ','))", "chunks_without_locator"),
}


@query(_REPORT_SQL)
def library_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twenty parts of the report: documents, turns as their chunks, e-mail addresses as entities, pages as assets."""
    documents = spark.sql(_REPORT_DOCUMENTS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    chunks = spark.sql(_REPORT_CHUNKS, conversations=table(spark, sf_dir, "conversations"))
    entities = library.dedupe_entities(library.extract_entities(table(spark, sf_dir, "documents"), {"email": _EMAIL}).withColumn("ord", F.struct("doc_id", "position")))
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    found = reports.library_report(documents, chunks, entities, assets, ["b.md", "a.md"])
    out = []
    for part, rows in found.items():
        if isinstance(rows, list):
            rows = spark.createDataFrame([(x, 1) for x in rows], "value string, count long")
        key, n = _NAMED.get(part) or ("value" if "value" in rows.columns else "''", next(c for c in ("n", "count", "missing") if c in rows.columns))
        own = rows.selectExpr(f"'{part}' AS part", f"{key} AS key", f"cast({n} AS long) AS n")
        out.append(own.groupBy("part", "key").agg(F.sum("n").alias("n")) if part == "top_entities" else own)
    return reduce(DataFrame.unionByName, out)


def _greedy_sql(edges: str, most: int) -> str:
    """The edges (k: their place, source, target) that are admitted one after another, until the nodes are full."""
    both = "list_distinct(list_concat(r.nodes, [e.source, e.target]))"
    return (
        f"e AS MATERIALIZED ({edges}), r(k, nodes) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT e.k, CASE WHEN len({both}) <= {most} THEN {both} ELSE r.nodes END FROM r JOIN e ON e.k = r.k + 1 WHERE len(r.nodes) < {most}), "
        "z AS (SELECT k, nodes FROM r ORDER BY k DESC LIMIT 1) SELECT e.source, e.target FROM e, z WHERE e.k <= z.k AND list_contains(z.nodes, e.source) AND list_contains(z.nodes, e.target) ORDER BY e.k LIMIT "
    )


_MENTIONS = f"SELECT doc_id, lower(x) AS norm, min(k) AS k FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '{_EMAIL}')) AS l FROM documents)) GROUP BY doc_id, lower(x)"


@query("WITH RECURSIVE " + _greedy_sql(f"SELECT row_number() OVER (ORDER BY doc_id, norm) AS k, CAST(doc_id AS VARCHAR) AS source, norm AS target FROM ({_MENTIONS})", 40) + str(concepts.edge_limit(40)))
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of documents and the e-mail addresses in them, of forty nodes."""
    found = library.extract_entities(table(spark, sf_dir, "documents"), {"email": _EMAIL}).withColumn("entity_id", F.lower("entity_text"))
    mentions = found.select("doc_id", "entity_id").distinct().withColumn("ord", F.struct("doc_id", "entity_id"))
    entities = mentions.groupBy("entity_id").agg(F.min("ord").alias("first_ord")).withColumn("entity_text", F.col("entity_id"))
    documents = lib(spark, sf_dir).select("doc_id", "title", F.col("doc_id").alias("doc_ord"))
    return concepts.document_entity_graph(documents, entities, mentions, 40)[1].select("source", "target")


_CONCEPT_EDGES = (
    "SELECT row_number() OVER (ORDER BY w DESC, label, CAST(item_id AS VARCHAR)) AS k, CAST(item_id AS VARCHAR) AS source, concat('concept:', label) AS target FROM "
    "(SELECT DISTINCT item_id, label FROM p) JOIN (SELECT label, round(4.0::DOUBLE + least(count(*), 8) * 0.45::DOUBLE + least(count(DISTINCT item_id), 5) * 0.8::DOUBLE + 2 * count(DISTINCT item_id), 2) AS w FROM p GROUP BY label) USING (label)"
)


@query(_WORDS_SQL.replace("WITH w AS", "WITH RECURSIVE w AS") + ", p AS (SELECT item_id, unnest(words) AS label FROM t), " + _greedy_sql(_CONCEPT_EDGES, 60) + str(concepts.edge_limit(60)))
def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of benchmark items and the concepts in them, of sixty nodes."""
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("chunk_id"), F.explode(concepts.tokens(F.col("text"))).alias("label"), F.lit("heading").alias("source"))
    documents = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"))
    return concepts.document_concept_graph(own, concepts.concept_index(own), documents, 60)[1].select("source", "target")


# --- bodies and records ---------------------------------------------------------------------------------------------------

_BODY_DOCUMENTS = """SELECT doc_id, concat('T', CAST(doc_id AS STRING)) AS title, concat(source, '.pdf') AS source_file, concat('/in/', source, '.pdf') AS source_path, concat('h', CAST(doc_id AS STRING)) AS checksum,
CASE lang WHEN 'en' THEN 'manual_pdf' WHEN 'de' THEN 'technical_drawing_pdf' WHEN 'fr' THEN 'release_rationale_docx' ELSE 'generic_pdf' END AS document_kind, 'ok' AS quality_status, 'text' AS extraction_status, doc_id % 2 = 0 AS requires_ocr_or_vision, 'c' AS converter, text AS markdown FROM {documents}"""
_TRIM = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
_L = "chr(10)"
_LINES = lambda *parts: "concat_ws(chr(10), " + ", ".join(parts) + ")"
_SQL_META = ["concat('- source_file: ', source_file)", "concat('- document_kind: ', document_kind)", "'- quality_status: ok'", "'- extraction_status: text'", "concat('- requires_ocr_or_vision: ', requires_ocr_or_vision)"]
_SQL_TRACE = ["'## Source Traceability'", "''", "concat('- source_path: ', source_path)", "concat('- checksum: ', checksum)", "''"]
_SQL_TOP = ["''", "'## Document Summary'", "''", "'_No summary generated._'", "''"]
_SQL_FIELDS = ["'| Field | Value |'", "'|---|---|'", *[f"'| {n} |  |'" if n != "document_title" else "concat('| document_title | ', title, ' |')" for n in ("document_title", "project_number", "product_name", "pathfinder_mass_code", "manufacturing_location", "filling_location", "formula_system", "release_phase", "annual_volume")]]
_BODY_SQL = (
    "WITH d AS (" + _BODY_DOCUMENTS.format(documents="documents") + "), "
    "p AS (SELECT conv_id AS doc_id, string_agg(concat('- Page ', turn, ': p. ', turn), chr(10) ORDER BY turn) AS overview, "
    + "string_agg(" + _LINES("concat('### Page ', turn)", "''", "concat('Source page: ', turn)", "''", f"CASE WHEN {_TRIM.format('text')} = '' THEN '_No text extracted for this page._' ELSE {_TRIM.format('text')} END", "''") + ", chr(10) ORDER BY turn) AS manual, "
    + "string_agg(concat('- Page ', turn, ': p. ', turn, ' - i', turn, '.png'), chr(10) ORDER BY turn) AS links, "
    + "string_agg(" + _LINES("concat('## Page ', turn)", "''", "concat('Source page: ', turn)", "''", "concat('![Page ', turn, '](i', turn, '.png)')", "''", "'### Extracted Text'", "''", f"CASE WHEN {_TRIM.format('coalesce(nullif(c.text, chr(0)), chr(0))')} = '' THEN '_No text extracted._' ELSE {_TRIM.format('c.text')} END", "''", "'### Notes'", "''", "''") + ", chr(10) ORDER BY turn) AS drawn FROM conversations c GROUP BY conv_id) "
    + "SELECT doc_id, md5(CASE document_kind WHEN 'manual_pdf' THEN "
    + _LINES("concat('# ', title)", *_SQL_TOP, "'## Key Metadata'", "''", *_SQL_META, "'- converter: c'", "'- tags: '", "concat('- document_title: ', title)", "''", *_SQL_TRACE, "'## Revision History'", "''", "'_No revision history detected._'", "''", "'## Table of Contents'", "''", "'_No table of contents detected._'", "''", "'## Page Overview'", "''", "coalesce(overview, '_No page overview available._')", "''", "'## Section Outline'", "''", "'_No section outline detected._'", "''", "'## Content'", "''", f"coalesce(manual, {_TRIM.format('markdown')})")
    + " WHEN 'technical_drawing_pdf' THEN "
    + _LINES("concat('# ', replace(source_file, '.pdf', ''))", *_SQL_TOP, "'## Document Classification'", "''", *_SQL_META[1:], "CASE WHEN requires_ocr_or_vision THEN '- note: No text was extracted; page image preserved for visual review.' END", "''", "'## Key Metadata'", "''", _SQL_META[0], "'- converter: c'", "'- tags: '", "''", *_SQL_TRACE, "'## Page Index'", "''",
             "CASE WHEN links IS NOT NULL THEN " + _LINES("links", "''", "drawn") + " ELSE " + _LINES("'No page images rendered. Re-run with --render-pdf-pages.'", "''", "'## Extracted Text'", "''", f"coalesce(nullif({_TRIM.format('markdown')}, ''), '_No text extracted._')", "''") + " END")
    + " WHEN 'release_rationale_docx' THEN "
    + _LINES("concat('# ', title)", "''", "'## Release Summary'", "''", "'_No summary generated._'", "''", "'## Key Release Metadata'", "''", *_SQL_FIELDS, "''", "'## Key Process Parameters'", "''", "'_No key process parameters detected._'", "''", "'## Recommendation'", "''", "'_No recommendation detected._'", "''", *_SQL_TRACE, "'## Content'", "''", _TRIM.format("markdown"), "''")
    + " ELSE " + _LINES("concat('# ', title)", *_SQL_TOP, "'## Key Metadata'", "''", *_SQL_META, "'- converter: c'", "''", *_SQL_TRACE, "'## Content'", "''", _TRIM.format("markdown"), "''")
    + " END) AS digest FROM d LEFT JOIN p USING (doc_id)"
)


@query(_BODY_SQL)
def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of four kinds; turns of conversations are the pages of the documents with their numbers."""
    docs = spark.sql(_BODY_DOCUMENTS, documents=table(spark, sf_dir, "documents")).withColumns({"tags": F.array().cast("array<string>"), "fields": F.create_map(F.lit("document_title"), F.col("title"))})
    number = F.col("turn").cast("string")
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.lit(None).cast("string").alias("page_title"), F.concat(F.lit("p. "), number).alias("locator"), "text", F.concat(F.lit("i"), number, F.lit(".png")).alias("image_path"))
    return bodies.document_bodies(docs, pages=pages).select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query(
    "WITH d AS (SELECT doc_id, source, lang FROM documents), c AS (SELECT conv_id AS doc_id, count(*) AS n, count(*) FILTER (role = 'user') AS pages, count(*) FILTER (role <> 'user') AS images FROM conversations GROUP BY conv_id), a AS (SELECT page_id AS doc_id, count(*) AS n FROM pages GROUP BY page_id) "
    "SELECT d.doc_id, concat('T', d.doc_id) AS title, coalesce(c.n, 0) AS chunks_count, coalesce(a.n, 0) AS assets_count, coalesce(c.n, 0) - coalesce(c.images, 0) AS text_chunks_count, coalesce(c.pages, 0) AS page_chunks_count, concat('h', d.doc_id) AS checksum, CASE WHEN lang = 'en' THEN concat('P', d.doc_id) END AS project_number, 33 + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n_fields FROM d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)"
)
def knowledge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of documents as JSON, read back: fixed fields, and an optional one that some documents have."""
    docs = spark.sql(_BODY_DOCUMENTS, documents=table(spark, sf_dir, "documents")).withColumn("tags", F.array().cast("array<string>"))
    docs = docs.withColumn("fields", F.when(F.col("document_kind") == "manual_pdf", F.create_map(F.lit("project_number"), F.concat(F.lit("P"), F.col("doc_id").cast("string")), F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("role") == "user", "page").otherwise("image").alias("evidence_type"), F.lit("l").alias("locator"), F.col("turn").alias("page_number"))
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    found = bodies.knowledge_json(knowledge.knowledge_records(docs, chunks, assets))
    read = F.from_json("knowledge", "title string, chunks_count long, assets_count long, text_chunks_count long, page_chunks_count long, key_metadata map<string,string>, project_number string")
    fields = F.size(F.json_object_keys("knowledge")).cast("long").alias("n_fields")
    return found.select("doc_id", read.alias("r"), fields).select("doc_id", "r.title", "r.chunks_count", "r.assets_count", "r.text_chunks_count", "r.page_chunks_count", F.col("r.key_metadata.checksum").alias("checksum"), "r.project_number", "n_fields")
