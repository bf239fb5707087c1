"""Queries of the document rules over the driver's tables.

The tables hold prose without plant documents' words, so paths and texts are made from them by SQL that both engines read: each
document gets a path and a beginning by its number, and every rule has documents that it fits and others that it doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import chunking, library
from .queries import query, table

_NAMES = ["Operating_Manual", "Fault-Catalog", "Functional_Description", "price list", "x data", "data", "schematic p and id", "EATON 1234567", "Montage", "Project_Book", "Datenblatt", "safety cip", "Flowsheet", "cable_overview", "note abb 5"]
_FOLDERS = ["Wiring-Diagram", "Symex_CML125", "P&ID", "CML 125/Temperature_Control", "in", "Mechanical Design"]
_STARTS = [
    "Table of contents", "1 Safety 5\n1.1 Power ... 7\n2 Pump 9", "Operating manual, machine no 7", "Manufacturer: A\nCustomer: B", "Revision history", "Terminal line-up", "technical data",
    "Wiring of the PLC and HMI of Symex CML 125, CIP pump, drawing ENG-123456, project SY1234567, commission no. A77-1, commission: make", "Cover sheet of the schematic multi-line",
    "fault messages and measures catalog", "- manufacturer: Symex GmbH\n- revision: 3\n- customer:  Plant One ", "MPDP and scaleup phase", "daily rescue eye serum M4E", "Release Rationale",
    "Category | ViewPath | Internal ID | en-GB | zh-CN <HMI Screen> plc+hmi", "control panel, motor, valve, terminal, Siemens touch panel, temperature control", "nothing",
]


def _case(values: list[str]) -> str:
    """A value by the document's number, as SQL of both engines."""
    quoted = lambda v: " || chr(10) || ".join(f"'{x}'" for x in v.replace("'", "''").split("\n"))
    return f"CASE doc_id % {len(values) + 1} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " ELSE 'plain' END"


PLANT = (
    f"SELECT doc_id, concat('/plant/', {_case(_FOLDERS)}, '/', {_case(_NAMES)}, '-', CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.PPTX' WHEN 2 THEN '.docx' ELSE '.pdf' END) AS source_path, "
    f"concat({_case(_STARTS)}, chr(10), text) AS markdown, CASE doc_id % 4 WHEN 0 THEN 'low_structure' WHEN 1 THEN 'visual_only' ELSE 'ok' END AS quality_status, "
    "CASE doc_id % 9 WHEN 0 THEN 'manual_pdf' WHEN 1 THEN 'technical_drawing_pdf' WHEN 2 THEN 'hmi_translation_xlsx' WHEN 3 THEN 'mpdp_table_xlsx' WHEN 4 THEN 'release_rationale_docx' WHEN 5 THEN 'process_development_presentation' ELSE 'generic_pdf' END AS document_kind FROM {documents}"
)
_PLANT = "WITH d AS (" + PLANT.format(documents="documents") + "), "


def plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLANT, documents=table(spark, sf_dir, "documents"))


def _any(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def _first(text: str, rules: list) -> str:
    return "CASE " + " ".join(f"WHEN {_any(text, needles)} THEN '{label}'" for label, needles in rules) + " END"


_PLAIN = "replace(replace(lower({}), '_', ' '), '-', ' ')"
_SUFFIX = r"lower(regexp_extract(source_path, '\.([^./]+)$', 1))"
_KIND_SQL = (
    _PLANT
    + f"""p AS (SELECT *, {_SUFFIX} AS suffix, {_PLAIN.format("regexp_extract(source_path, '([^/]*)$', 1)")} AS name,
{_PLAIN.format("replace(regexp_extract(source_path, '^(.*)/', 1), '/', ' ')")} AS folders, {_PLAIN.format("markdown")} AS content,
lower(regexp_extract(source_path, '([^/]*)$', 1) || chr(10) || markdown) AS office FROM d),
q AS (SELECT *, name || ' ' || regexp_replace(name, '\\.[^.]+$', '') AS twice,
CASE WHEN {_any("office", V.TRANSLATION_NAMES)} THEN 2 ELSE 0 END + CASE WHEN {" AND ".join(f"contains(office, '{h}')" for h in V.TRANSLATION_HEADERS)} THEN 3 ELSE 0 END
+ CASE WHEN len(regexp_extract_all(office, '<hmi screen>')) >= 3 THEN 2 ELSE 0 END + CASE WHEN {_any("office", V.TRANSLATION_PARTS)} THEN 1 ELSE 0 END AS translation FROM p)
SELECT doc_id, CASE WHEN suffix = 'pdf' THEN coalesce({_first("name", V.NAME_KINDS)}, {_first("folders", V.FOLDER_KINDS)}, {_first("content", V.CONTENT_KINDS)}, {_first("twice", V.NAME_KINDS)},
CASE WHEN regexp_matches(twice, '{V.COMPONENT_NAME}') THEN 'component_document_pdf' END, 'generic_pdf')
WHEN suffix = 'xlsx' AND translation >= 3 THEN 'hmi_translation_xlsx' {" ".join(f"WHEN suffix = '{s}' AND {_any('office', n)} THEN '{k}'" for s, n, k in V.OFFICE_KINDS)} ELSE 'document' END AS kind FROM q"""
)


@query(_KIND_SQL)
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(spark, sf_dir).select("doc_id", R.document_kind(F.col("source_path"), F.col("markdown")).alias("kind"))


def _mapped(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_OFFICE_LIST = "CASE document_kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in V.OFFICE_TAGS.items()) + " ELSE [] END"
_TAGS_SQL = (
    _PLANT
    + f"p AS (SELECT *, {_PLAIN.format('source_path')} AS t FROM d), q AS (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN contains(t, '{needle}') THEN '{tag}' END" for needle, tag in V.PATH_TAGS)
    + f"], lambda x: x IS NOT NULL) AS own FROM p) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(own, [CASE WHEN list_has_any(own, ['flowsheet', 'p-id', 'piping-instrumentation-diagram']) THEN 'mechanical-design' END, {_SUFFIX}, {_mapped('quality_status', V.QUALITY_TAGS)}, {_mapped('document_kind', V.DRAWING_TAG)}, {_mapped('document_kind', V.KIND_TAGS)}], {_OFFICE_LIST}), lambda x: x IS NOT NULL))), ',') AS tags FROM q"
)


@query(_TAGS_SQL)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tags(F.col("source_path"), F.col("document_kind"), F.col("quality_status"))
    return plant(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(found), ",").alias("tags"))


_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 120)"
_PAGE_SQL = (
    _PLANT
    + f"p AS (SELECT doc_id, lower(markdown) AS t FROM d), q AS (SELECT *, len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\\d+(?:\\.\\d+)*\\s+\\S+') AND (regexp_matches(x, '\\s\\d{{1,4}}$') OR contains(x, '...') OR contains(x, '. . .')))) AS entries FROM p) "
    + "SELECT doc_id, CASE WHEN (contains(t, 'operating manual') AND "
    + _any("t", V.TITLE_PAGE_NUMBERS)
    + ") OR "
    + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in V.TITLE_PAGE_WORDS)
    + " >= 2 THEN 'Title Page' WHEN contains(t, 'table of contents') OR entries >= 3 THEN 'Table of Contents' WHEN "
    + _any("t", V.REVISION_WORDS)
    + " THEN 'Revision Overview' "
    + " ".join(f"WHEN contains(t, '{needle}') THEN '{title}'" for needle, title in V.PAGE_TITLES)
    + " END AS title FROM q"
)


@query(_PAGE_SQL)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(spark, sf_dir).select("doc_id", R.page_title(F.col("markdown")).alias("title"))


_STATUS = "SELECT doc_id, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'PDF' ELSE 'docx' END AS suffix, CASE WHEN doc_id % 3 = 0 THEN concat('  # Head', chr(10), text) ELSE text END AS markdown, doc_id % 5 = 0 AS fallback, doc_id % 7 AS elements, CASE doc_id % 11 WHEN 0 THEN 'technical_drawing_pdf' WHEN 1 THEN 'hmi_translation_xlsx' ELSE 'x' END AS kind, doc_id % 2 AS pages, doc_id % 4 AS text_pages FROM {documents}"


@query("WITH s AS (" + _STATUS.format(documents="documents") + r") SELECT doc_id, CASE WHEN lower(suffix) = 'pdf' AND pages > 0 AND text_pages = 0 THEN 'visual_only' WHEN kind = 'hmi_translation_xlsx' THEN 'structured_with_noise' WHEN kind = 'technical_drawing_pdf' OR (lower(suffix) = 'pdf' AND (NOT regexp_matches(markdown, '(?m)^[ 	]*#') OR fallback OR elements = 0)) THEN 'low_structure' ELSE 'ok' END AS status FROM s")
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_STATUS, documents=table(spark, sf_dir, "documents"))
    return own.select("doc_id", R.quality_status(*map(F.col, ("suffix", "markdown", "fallback", "elements", "kind", "pages", "text_pages"))).alias("status"))


_FINDINGS = ["Shake stability pass after 3 days", "Stability: pass", "batch VL123456 F/TH fail", "50kg pilot scale up: Success", "Approved by all", "Stability ok", "PASS", "not feasible", "it will fail. Stability ok", "pass Fth 3cyc & Shaker", "failure", "Risk VL999999 50 kg"]
_BATCHES = f"SELECT doc_id, {_case(['Batch history', 'Formula technical risk assessment', 'Timeline', 'Pilot'])} AS title, concat({_case(_FINDINGS)}, chr(10), text) AS w FROM {{documents}}"
_RISK = f"regexp_matches(lower(title), '{V.RISK_TITLE}')"
_RESULT_SQL = (
    "WITH d AS (" + _BATCHES.format(documents="documents") + r"), t AS (SELECT *, trim(regexp_replace(w, '\s+', ' ', 'g')) AS c FROM d), f AS (SELECT *, coalesce("
    + ", ".join(f"nullif(regexp_extract(c, '(?i)({p})', 1), '')" for p in V.RESULTS)
    + ", '') AS r FROM t), s AS (SELECT *, CASE WHEN "
    + _RISK
    + " OR r = '' THEN '' "
    + " ".join(f"WHEN regexp_matches(r, '(?i){p}') THEN '{name}'" for p, name in V.RESULT_NAMES)
    + " ELSE trim(r) END AS status FROM f) SELECT doc_id, status, CASE WHEN status <> '' THEN 'high' WHEN regexp_matches(w, '(?i)"
    + V.BATCH_EVIDENCE
    + "') THEN 'medium' ELSE 'low' END AS confidence FROM s"
)


@query(_RESULT_SQL)
def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_BATCHES, documents=table(spark, sf_dir, "documents")).withColumn("status", R.result_status(F.col("w"), F.col("title")))
    return own.select("doc_id", "status", R.result_confidence(F.col("w"), F.col("status"), F.col("title")).alias("confidence"))


_EVIDENCE = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'section' WHEN 1 THEN 'table_section' WHEN 2 THEN 'page' WHEN 3 THEN 'topic' END AS own, CASE WHEN doc_id % 3 = 0 THEN 1 END AS page, CASE WHEN doc_id % 5 = 0 THEN 'p.png' END AS image, CASE WHEN doc_id % 2 = 0 THEN text ELSE '  ' END AS page_text, CASE WHEN doc_id % 4 = 0 THEN 'Key Metadata' ELSE 'A' END AS heading FROM {documents}"


@query("WITH e AS (" + _EVIDENCE.format(documents="documents") + f") SELECT doc_id, CASE WHEN own IN ({', '.join(repr(x) for x in V.EVIDENCE_TYPES)}) THEN own WHEN image IS NOT NULL AND trim(page_text) <> '' THEN 'page' WHEN image IS NOT NULL THEN 'image' WHEN page IS NOT NULL AND trim(page_text) <> '' THEN 'text_page' WHEN page IS NOT NULL THEN 'page' WHEN heading = 'Key Metadata' THEN 'metadata' ELSE 'text' END AS kept FROM e")
def evidence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_EVIDENCE, documents=table(spark, sf_dir, "documents"))
    return own.select("doc_id", R.evidence_type(F.col("own"), F.col("page"), F.col("image"), F.col("page_text"), F.array("heading")).alias("kept"))


def _entity_sql() -> str:
    parts = []
    for group, patterns in V.ENTITY_GROUPS.items():
        for p in patterns:
            bare = p.replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "")
            grouped = 1 if group == "commission_number" else 0
            parts.append(f"SELECT doc_id, document_kind, '{group}' AS entity_type, unnest(regexp_extract_all(t, '(?i){bare}', {grouped})) AS x FROM d")
    names = " ".join(f"WHEN lower(y) = '{n.lower()}' THEN '{n}'" for n in V.ENTITY_NAMES)
    spelled = r"(SELECT *, trim(regexp_replace(x, '\s+', ' ', 'g')) AS y FROM m)"
    implied = " UNION ALL ".join(f"SELECT doc_id, 'document_type', unnest([{', '.join(repr(x) for x in v)}]) FROM d WHERE document_kind = '{k}'" for k, v in V.KIND_DOCUMENT_TYPES.items())
    fields = " UNION ALL ".join(rf"SELECT doc_id, '{f}', trim(regexp_extract(markdown, '(?im)^-\s+{f}:\s*(.+)$', 1)) FROM d WHERE regexp_extract(markdown, '(?im)^-\s+{f}:\s*(.+)$', 1) <> ''" for f in V.TITLE_FIELDS)
    kinds = ", ".join(repr(k) for k in V.KIND_DOCUMENT_TYPES)
    return (
        "WITH p AS (" + PLANT.format(documents="documents") + "), d AS (SELECT *, source_path || chr(10) || markdown AS t FROM p), m AS (" + " UNION ALL ".join(parts) + "), "
        + f"c AS (SELECT doc_id, document_kind, entity_type, CASE WHEN regexp_matches(y, '(?i)^cml\\s*125$') THEN 'CML125' {names} ELSE y END AS entity_text FROM {spelled}), "
        + "k AS (SELECT doc_id, entity_type, entity_text FROM c WHERE NOT (entity_type = 'commission_number' AND (lower(entity_text) IN ('make', 'control', 'panel') OR NOT regexp_matches(entity_text, '[0-9]'))) "
        + f"AND NOT (entity_type = 'document_type' AND document_kind IN ({kinds})) AND NOT (entity_type = 'manual_topic' AND document_kind = 'manual_pdf' AND entity_text = 'functional description') "
        + "AND NOT (entity_type = 'document_type' AND document_kind = 'technical_drawing_pdf' AND entity_text <> 'wiring diagram' AND EXISTS (SELECT 1 FROM d WHERE d.doc_id = c.doc_id AND contains(lower(d.t), 'wiring diagram'))) "
        + "UNION ALL SELECT doc_id, 'equipment', unnest(['PLC', 'HMI']) FROM d WHERE document_kind = 'hmi_translation_xlsx' UNION ALL SELECT doc_id, 'document_type', 'wiring diagram' FROM d WHERE document_kind = 'technical_drawing_pdf' AND contains(lower(t), 'wiring diagram') "
        + f"UNION ALL {implied} UNION ALL {fields}) SELECT DISTINCT doc_id, entity_type, entity_text FROM k"
    )


@query(_entity_sql())
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.group_entities(plant(spark, sf_dir)).select("doc_id", "entity_type", "entity_text")


# --- presentations and translation tables ---------------------------------------------------------------------------------

_HEADS = ["Pilot Summary", "Process flowchart", "confidential\nM4E Study", "A recommendation for the next step and for everything else that may still be open", "12", "Our venturi plan", "1/2/2024\nSpec of all", "![x](y.png)", "Micro issue"]
_SLIDES = "SELECT conv_id AS doc_id, turn, concat(" + _case(_HEADS).replace("doc_id %", "(conv_id + turn) %") + ", chr(10), text) AS body FROM {conversations}"


def _decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_SLIDES, conversations=table(spark, sf_dir, "conversations"))
    marked = F.struct("turn", F.concat(F.lit("<!-- Slide number: "), F.col("turn").cast("string"), F.lit(" -->\n"), F.col("body")).alias("s"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["s"]), "\n").alias("markdown"))


_CLEAN = r"list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(trim(x), '\s+', ' ', 'g'), ' -')), lambda x: NOT regexp_matches(lower(x), '^\d*$|^confidential$|^\d{1,2}/\d{1,2}/\d{2,4}$'))"
_DECK_SQL = (
    "WITH s AS (" + _SLIDES.format(conversations="conversations") + f"), l AS (SELECT doc_id, turn, trim(body, ' ' || chr(10)) AS text, {_CLEAN} AS lines FROM s), "
    + "t AS (SELECT *, coalesce("
    + ", ".join(f"CASE WHEN len(list_filter(lines[1:12], lambda x: regexp_matches(x, '(?i)\\b{name}\\b'))) > 0 THEN '{name}' END" for name in V.SLIDE_TITLES)
    + ", list_filter(lines[1:10], lambda x: length(x) <= 80 AND NOT contains(x, '|') AND NOT starts_with(x, '!') AND len(string_split(x, ' ')) <= 8 AND regexp_matches(x, '[A-Za-z]'))[1], 'Slide ' || turn) AS title FROM l) "
    + "SELECT doc_id, turn AS slide_number, title, coalesce(" + _first("lower(title)", V.TITLE_TOPICS) + ", " + _first("lower(title || chr(10) || text)", V.TEXT_TOPICS) + ", 'Project Overview') AS topic, "
    + _any("lower(title || chr(10) || text)", V.VISUAL_WORDS) + r" OR regexp_matches(text, '!\[[^\]]*\]\([^)]+\)') AS visual, length(text) AS n_chars FROM t"
)


@query(_DECK_SQL)
def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.slides(_decks(spark, sf_dir)).select("doc_id", "slide_number", "title", "topic", "visual", F.length("text").alias("n_chars"))


@query(_DECK_SQL.replace("SELECT doc_id, turn AS slide_number, title,", ", u AS (SELECT doc_id, turn, text,") + ") SELECT doc_id, topic, count(*) AS slide_count, length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS n_chars, CASE WHEN min(turn) = max(turn) THEN 'Slide ' || min(turn) WHEN max(turn) - min(turn) + 1 = count(*) THEN 'Slides ' || min(turn) || '-' || max(turn) ELSE 'Slides ' || string_agg(turn, ', ' ORDER BY turn) END AS locator FROM u GROUP BY doc_id, topic")
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.topics(chunking.slides(_decks(spark, sf_dir))).select("doc_id", "topic", "slide_count", F.length("text").alias("n_chars"), "locator")


_PATHS = [r"SY12_PLC+HMI_V3\Bilder\Pump\Level\Textfeld 1\Text", r"Bilder\Group_1\Valve\Template_Schaltfläche\Text aus", r"Menu\GUID_12-3", r"Textfeld 2\Text", "Screen"]
_WORDS = ["kg", "°C", "Start", "NaN", "Stop\\_now"]
_CELLS = (
    "SELECT conv_id AS doc_id, turn, CASE turn % 3 WHEN 0 THEN '<HMI Screen>' WHEN 1 THEN '' ELSE CASE WHEN conv_id % 4 = 0 THEN 'Other' ELSE '<HMI Screen>' END END AS category, "
    + "CASE (conv_id + turn) % 6 " + " ".join("WHEN {} THEN {}".format(k, "concat(" + ", chr(92), ".join(f"'{x}'" for x in p.split("\\")) + ", '')") for k, p in enumerate(_PATHS)) + " ELSE '' END AS path, "
    + "CASE (conv_id + 2 * turn) % 6 " + " ".join("WHEN {} THEN {}".format(k, "concat(" + ", chr(92), ".join(f"'{x}'" for x in w.split("\\")) + ", '')") for k, w in enumerate(_WORDS)) + " ELSE '' END AS english, role AS chinese FROM {conversations}"
)


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_CELLS, conversations=table(spark, sf_dir, "conversations"))
    line = F.concat_ws(" | ", F.lit("|  x"), "category", "path", F.lit("id"), "english", "chinese", F.lit(" |"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    head = "| x | Category | ViewPath | Internal ID | en-GB\\* | zh-CN | y |\n|---|---|---|---|---|---|---|\n"
    return own.groupBy("doc_id").agg(F.concat(F.lit(head), listed).alias("markdown")).withColumns({"source_file": F.lit("texts.xlsx"), "slug": F.concat(F.lit("t"), F.col("doc_id").cast("string")), "document_kind": F.lit("hmi_translation_xlsx")})


_GROUPS_OF = {0: ("Pump / Level", "Textfeld 1"), 1: ("Valve", "Template_Schaltfläche"), 2: ("Menu", "Menu"), 3: ("HMI Screens", "Textfeld 2"), 4: ("Screen", "Screen")}
_ROWS_SQL = (
    "WITH c AS (" + _CELLS.format(conversations="conversations") + r"), r AS (SELECT doc_id, turn, category, (doc_id + turn) % 6 AS p, CASE WHEN lower(english) = 'nan' THEN '' ELSE replace(english, '\_', '_') END AS english, chinese FROM c), "
    + "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) + 1 AS row_number FROM r WHERE p < 5 AND category <> 'Other') "
    + "SELECT doc_id, row_number, CASE p " + " ".join(f"WHEN {k} THEN '{g}'" for k, (g, _) in _GROUPS_OF.items()) + " END AS group_path, CASE p " + " ".join(f"WHEN {k} THEN '{f}'" for k, (_, f) in _GROUPS_OF.items())
    + " END AS field, english, CASE WHEN english IN ('kg', '°C') THEN english ELSE '' END AS unit FROM k"
)


@query(_ROWS_SQL)
def translation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.translation_rows(_sheets(spark, sf_dir)).select("doc_id", "row_number", "group_path", "field", "english", "unit")


@query("WITH t AS (" + _ROWS_SQL + "), g AS (SELECT doc_id, group_path, count(*) AS n FROM t GROUP BY ALL), a AS (SELECT DISTINCT conv_id AS doc_id FROM conversations) SELECT doc_id, 'hmi_translation_table' AS evidence_type, 1 AS n FROM a UNION ALL SELECT doc_id, 'hmi_translation_group', count(*) FROM g GROUP BY doc_id UNION ALL SELECT doc_id, 'hmi_translation_row', least(count(*), 250) FROM t GROUP BY doc_id")
def translation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatch's chunks of translation tables, by kind of evidence."""
    return chunking.chunk_documents(_sheets(spark, sf_dir)).groupBy("doc_id", "evidence_type").agg(F.count("*").alias("n"))


# --- noise and text -------------------------------------------------------------------------------------------------------

_NOISY = (
    "SELECT doc_id, concat(CASE doc_id % 8 WHEN 0 THEN repeat('NaN | ', 30) WHEN 1 THEN concat(repeat('aB3+', 20), '== ') WHEN 2 THEN repeat(concat('C:', chr(92), 'Bilder', chr(92), 'x '), 40) "
    "WHEN 3 THEN repeat('<tag a> ', 60) WHEN 4 THEN repeat('SY1_PLC+HMI ', 30) WHEN 5 THEN repeat('12 34 a1 ', 90) WHEN 6 THEN concat(chr(92), 'Textfeld nan ') ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END) AS text, "
    "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'p. 1' END AS locator FROM {documents}"
)
#: RE2's \b knows ASCII words only: letters beyond ASCII become _, other signs a space.
_WORDLIKE = r"regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_NOISE_SQL = (
    "WITH d AS (" + _NOISY.format(documents="documents") + "), "
    + rf"""c AS (SELECT doc_id, length(text) AS chars, coalesce(locator, '') = '' AS unlocated, greatest(len(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F\x85]+')), 1)::DOUBLE AS tokens,
len(regexp_extract_all({_WORDLIKE}, '(?i)\bNaN\b'))::DOUBLE AS nans, len(regexp_extract_all({_WORDLIKE}, '\b[A-Za-z0-9+/]{{60,}}={{0,2}}\b'))::DOUBLE AS base64,
len(regexp_extract_all(text, '[A-Za-z]:\\|\\\\|PLC\+HMI|\\Bilder\\|\\Textfeld'))::DOUBLE AS paths, len(regexp_extract_all(text, '<[^>\n]{{2,40}}>'))::DOUBLE AS tags,
len(regexp_extract_all({_WORDLIKE}, '\b[A-Za-z]{{3,}}\b'))::DOUBLE AS alpha FROM d),
f AS (SELECT doc_id, nans / tokens > 0.08::DOUBLE AS a, base64 > 0 AS b, paths / tokens > 0.03::DOUBLE AS p, tags / tokens > 0.05::DOUBLE AS t, unlocated AS l, alpha / tokens < 0.15::DOUBLE AND chars > 200 AS w, * FROM c),
s AS (SELECT *, CASE WHEN a THEN least(nans / tokens * 5, 3) ELSE 0 END + CASE WHEN b THEN least(base64 * 1.5::DOUBLE, 4) ELSE 0 END + CASE WHEN p THEN least(paths / tokens * 5, 2.5::DOUBLE) ELSE 0 END
+ CASE WHEN t THEN least(tags / tokens * 4, 2) ELSE 0 END + CASE WHEN l THEN 1 ELSE 0 END + CASE WHEN w THEN 1 ELSE 0 END AS score FROM f)
SELECT doc_id, score >= 2 AS is_noisy, round(score, 3) AS noise_score, concat_ws(',', CASE WHEN a THEN 'nan_density' END, CASE WHEN b THEN 'base64_like' END, CASE WHEN p THEN 'windows_or_hmi_path_density' END,
CASE WHEN t THEN 'xml_html_tag_density' END, CASE WHEN l THEN 'missing_locator' END, CASE WHEN w THEN 'low_natural_language_ratio' END) AS reasons FROM s"""
)


@query(_NOISE_SQL)
def noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_NOISY, documents=table(spark, sf_dir, "documents")).select("doc_id", T.noise(F.col("text"), F.col("locator")).alias("n"))
    return own.select("doc_id", "n.is_noisy", "n.noise_score", F.array_join("n.noise_reasons", ",").alias("reasons"))


_SHOWN = "SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'NaN | NaN | NaN, and NaN ' WHEN 1 THEN concat(repeat('aB3+', 20), ' ') ELSE '' END, text, CASE WHEN doc_id % 3 = 0 THEN ' License' ELSE '' END) AS text FROM {documents}"
_PREVIEW_SQL = (
    "WITH d AS (" + _SHOWN.format(documents="documents") + r"), c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9+/]{60,}={0,2}\b', '[base64]', 'g'), "
    r"'(?i)\bNaN\b(?:\s*[|,;]\s*\bNaN\b){2,}', '[NaN omitted]', 'g'), '(?i)\bNaN\b', '', 'g'), '\s+', ' ', 'g')) AS c FROM d), "
    "i AS (SELECT doc_id, c, strpos(lower(c), 'license') AS i FROM c), x AS (SELECT doc_id, CASE WHEN i > 41 THEN '...' || c[i - 40:] ELSE c END AS s FROM i) "
    "SELECT doc_id, rtrim(s[1:220]) || CASE WHEN length(s) > 220 THEN '...' ELSE '' END AS shown FROM x"
)


@query(_PREVIEW_SQL)
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_SHOWN, documents=table(spark, sf_dir, "documents"))
    return own.select("doc_id", T.preview(F.col("text"), "license").alias("shown"))
