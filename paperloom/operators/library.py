"""The library: documents, chunks, entities, mentions, assets, relations, and the graph over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vocabulary as V
from ..tables import written
from .ranks import numbered
from .search import SHOWN

#: Letters of entities that one automaton holds, about.
MOST_LETTERS = 1_000_000
#: Bytes of chunks that several automata go through one after the other.
MOST_BYTES = 1 << 27
#: Default patterns of entities; callers with their own vocabulary pass their own.
ENTITY_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "long_number": r"[0-9]{13,19}",
}


@dataclass
class Library:
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    assets: DataFrame
    relations: DataFrame
    #: chunks with what a search shows of their documents (search.SHOWN), where these have it
    rows: DataFrame | None = None


def extract_entities(docs: DataFrame, rules: dict[str, str] = ENTITY_RULES, text: str = "text") -> DataFrame:
    """doc_id, entity_type, entity_text, position: different matches of each rule, in the order first seen."""
    found = F.array(*[F.struct(F.lit(k).alias("entity_type"), T.distinct_matches(F.col(text), p).alias("texts")) for k, p in rules.items()])
    kinds = docs.select("doc_id", F.posexplode(found).alias("_k", "e")).select("doc_id", "_k", "e.entity_type", F.posexplode("e.texts").alias("_p", "entity_text"))
    return kinds.select("doc_id", "entity_type", "entity_text", (F.shiftleft(F.col("_k").cast("long"), 32) + F.col("_p")).alias("position"))


def canonical(text: Column) -> Column:
    """An entity's usual spelling, if it is a known name."""
    clean = T.collapse(text)
    spelled = F.when(clean.rlike(r"(?i)^cml\s*125$"), F.lit("CML125"))
    for name in V.ENTITY_NAMES:
        spelled = spelled.when(F.lower(clean) == name.lower(), F.lit(name))
    return spelled.otherwise(clean)


def group_entities(docs: DataFrame) -> DataFrame:
    """doc_id, entity_type, entity_text, position from docs (doc_id, source_path, markdown, document_kind): the entities of
    each group in path and text, in their usual spelling, each once; fields of a title page; what a document's kind implies."""
    text = F.concat_ws("\n", "source_path", F.coalesce("markdown", F.lit("")))
    kind = F.col("document_kind")
    words = lambda values: F.array(*map(F.lit, values))

    def matches(pattern: str) -> Column:
        return F.regexp_extract_all(F.col("_text"), F.lit(f"(?iU){pattern}"), F.lit(1 if re.search(r"(?<!\\)\((?!\?)", pattern) else 0))

    groups = {name: F.array_distinct(F.transform(F.concat(*map(matches, patterns)), canonical)) for name, patterns in V.ENTITY_GROUPS.items()}
    groups["commission_number"] = F.filter(groups["commission_number"], lambda x: ~F.lower(x).isin(*V.NO_COMMISSION) & x.rlike("[0-9]"))
    topics = groups["manual_topic"]
    groups["manual_topic"] = F.when(kind == "manual_pdf", F.array_remove(topics, "functional description")).otherwise(topics)
    implied = F.coalesce(*[F.when(kind == k, words(v)) for k, v in V.KIND_DOCUMENT_TYPES.items()])
    drawing = F.when((kind == "technical_drawing_pdf") & F.contains(F.lower("_text"), F.lit("wiring diagram")), words(["wiring diagram"]))
    groups["document_type"] = F.coalesce(implied, drawing, groups["document_type"])
    parts = groups["equipment"]
    groups["equipment"] = F.when(kind == "hmi_translation_xlsx", F.array_union(parts, words(["PLC", "HMI"]))).otherwise(parts)
    for field in V.TITLE_FIELDS:
        value = F.trim(F.regexp_extract(F.coalesce("markdown", F.lit("")), rf"(?im)^-\s+{field}:\s*(.+)$", 1))
        groups[field] = F.array_compact(F.array(T.blank_to_null(value)))
    listed = F.array(*[F.struct(F.lit(name).alias("entity_type"), values.alias("texts")) for name, values in groups.items()])
    kinds = docs.withColumn("_text", text).select("doc_id", F.posexplode(listed).alias("_k", "e")).select("doc_id", "_k", "e.entity_type", F.posexplode("e.texts").alias("_p", "entity_text"))
    return kinds.select("doc_id", "entity_type", "entity_text", (F.shiftleft(F.col("_k").cast("long"), 32) + F.col("_p")).alias("position"))


def flatten_entities(packs: DataFrame) -> DataFrame:
    """doc_id, entity_type, entity_text from a JSON object of lists; what is no list, nested or empty is left out."""
    lists = F.from_json("entities_json", "map<string,string>")
    rows = packs.select("doc_id", F.explode(lists).alias("entity_type", "_v")).filter(F.col("_v").startswith("["))
    values = rows.select("doc_id", "entity_type", F.posexplode(F.from_json("_v", "array<string>")).alias("position", "_t"))
    return values.select("doc_id", "entity_type", F.trim("_t").alias("entity_text"), "position").filter("entity_text != '' and not startswith(entity_text, '{') and not startswith(entity_text, '[')")


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """entity_id, entity_type, normalized_text, entity_text (of the first mention), mention_count, first_ord.

    mentions: entity_type, entity_text, ord (a total order)."""
    own = mentions.withColumn("normalized_text", T.normal_entity(F.col("entity_text"))).filter("normalized_text != ''")
    grouped = own.groupBy("entity_type", "normalized_text").agg(F.min_by("entity_text", "ord").alias("entity_text"), F.count("*").alias("mention_count"), F.min("ord").alias("first_ord"))
    return grouped.withColumn("entity_id", T.entity_id(F.col("entity_type"), F.col("normalized_text")))


def top_entities(entities: DataFrame, size: int = 25) -> DataFrame:
    """By normalised text: the shortest spelling stands for all, counts add up. entities: entity_id, entity_type, entity_text,
    normalized_text, mention_count, first_ord."""
    best = F.struct(F.length("entity_text"), F.col("first_ord"))
    grouped = entities.groupBy("normalized_text").agg(
        F.min_by("entity_text", best).alias("entity_text"), F.min_by("entity_type", best).alias("entity_type"),
        F.sum("mention_count").alias("count"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
    )
    return grouped.orderBy(F.desc("count"), T.casefold(F.col("entity_text")), "normalized_text").limit(size)


def contained(chunks: DataFrame, entities: DataFrame, bounded: bool = True, least: int = 2, fold: Callable[[Column], Column] = T.casefold) -> DataFrame:
    """chunk_id, entity_id where the entity's text stands in the chunk's title, text, locator or headings, whatever the case.

    bounded: only entities first seen in this or an earlier document (first_doc_ord <= doc_ord). fold: which spellings are one;
    T.casefold takes ß for ss, F.lower doesn't. Texts of `least` characters and
    more are looked for (the empty one stands in every chunk), all at once: an automaton over a block of them goes through each chunk once, so neither common words nor
    names of one word cost more than others. A block has about MOST_LETTERS letters, whatever the number of entities; the
    entities are read block by block when the frame is made. Chunks are read in one scan: where there are several blocks, a task
    holds chunks of MOST_BYTES, about, and has one automaton after the other go through them."""
    hay = fold(F.concat_ws(" ", "title", "text", "locator", T.blank_to_null(F.array_join("heading_path", " "))))
    own = chunks.select("chunk_id", F.col("doc_ord").cast("long").alias("doc_ord"), hay.alias("_hay"))
    needles = entities.select(fold(F.col("entity_text")).alias("_needle"), "entity_id", F.col("first_doc_ord").cast("long").alias("first_doc_ord")).filter(F.length("_needle") >= least)
    needles = written(needles, "needles")
    schema = StructType([own.schema["chunk_id"], needles.schema["entity_id"]])
    blocks = -(-(needles.agg(F.sum(F.greatest(F.length("_needle"), F.lit(1)))).first()[0] or 0) // MOST_LETTERS)
    context, parts = chunks.sparkSession.sparkContext, []
    for k in range(blocks):
        part = needles.filter(F.pmod(F.xxhash64("_needle"), F.lit(blocks)) == k).toArrow()  # MOST_LETTERS letters, about
        parts.append(context.broadcast(part))
    return own.mapInArrow(_finder(parts, bounded, schema, MOST_BYTES), schema) if parts else chunks.sparkSession.createDataFrame([], schema)


def _finder(sent: list[Broadcast[pa.Table]], bounded: bool, schema: StructType, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = to_arrow_schema(schema)

    def automaton_of(block: pa.Table) -> tuple[object, list]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), []
        for needle, entity_id, first in zip(*(block.column(k).to_pylist() for k in range(3))):
            if not needle:
                everywhere.append((entity_id, first))
            elif needle in automaton:
                automaton.get(needle).append((entity_id, first))
            else:
                automaton.add_word(needle, [(entity_id, first)])
        automaton.make_automaton()
        return automaton, everywhere

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if len(sent) == 1 or size >= most:
                yield kept
                kept, size = [], 0
        if kept:
            yield kept

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = automaton_of(sent[0].value) if len(sent) == 1 else None
        for kept in held(batches):
            for block in sent:
                automaton, everywhere = only or automaton_of(block.value)
                for batch in kept:
                    chunk_ids, entity_ids = [], []
                    for chunk_id, doc_ord, hay in zip(*(batch.column(k).to_pylist() for k in range(3))):
                        inside = {id(x): x for _, x in automaton.iter(hay)} if len(automaton) else {}
                        for same in (everywhere, *inside.values()):
                            for entity_id, first in same:
                                if not bounded or first is not None and doc_ord is not None and first <= doc_ord:
                                    chunk_ids.append(chunk_id)
                                    entity_ids.append(entity_id)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((chunk_ids, entity_ids), kinds)], schema=kinds)

    return find


def with_entity_text(chunks: DataFrame, entities: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """Adds `entities`, which the index holds: the texts of all entities that stand in a chunk, wherever they were first seen, in
    the order in which they were. entities: entity_id, entity_text, first_doc_ord, first_ord; inside: contained(..., False), if it
    is there already."""
    inside = contained(chunks, entities, bounded=False) if inside is None else inside
    named = inside.join(entities.select("entity_id", "entity_text", "first_ord"), "entity_id")
    listed = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("first_ord", "entity_id", "entity_text"))).alias("_e"))
    joined = chunks.drop("entities").join(listed, "chunk_id", "left")
    return joined.withColumn("entities", F.coalesce(F.array_join(F.transform("_e", lambda x: x["entity_text"]), " "), F.lit(""))).drop("_e")


def assemble_packs(manifests: DataFrame, **parts: DataFrame) -> DataFrame:
    """Packs by their folder (doc_dir): manifests that didn't fail, with whatever else there is of each."""
    own = manifests.filter("status != 'failed'")
    return reduce(lambda a, b: a.join(b, "doc_dir", "left"), parts.values(), own)


def with_source(chunks: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """A chunk's own value, else its source map's; empty strings and zeros count as missing."""
    joined = chunks.alias("c").join(sources.alias("s"), ["doc_id", "chunk_id"], "left")
    kinds = dict(chunks.dtypes)

    def filled(c: str) -> Column:
        own, other = F.col(f"c.{c}"), F.col(f"s.{c}")
        if kinds[c] == "string":
            return T.first_filled(own, other)
        if kinds[c] in ("int", "bigint", "double"):
            return F.coalesce(F.nullif(own, F.lit(0)), F.nullif(other, F.lit(0)))
        return F.coalesce(own, other)

    return joined.select("doc_id", "chunk_id", *[filled(c).alias(c) for c in columns], *[F.col(f"c.{c}") for c in chunks.columns if c not in ("doc_id", "chunk_id", *columns)])


def unique_ids(rows: DataFrame, base: str, hint: str, order: str) -> DataFrame:
    """Adds `unique_id`: the base id made safe; the second of a kind gets -hint, later ones -hint-2 and so on. Rows of a kind are
    numbered by ranges, however many there are."""
    named = F.when(F.col("_n") == 1, F.col("_safe")).when(F.col("_n") == 2, F.concat("_safe", F.lit("-"), T.safe_id(F.col(hint)))).otherwise(
        F.concat("_safe", F.lit("-"), T.safe_id(F.col(hint)), F.lit("-"), (F.col("_n") - 1).cast("string"))
    )
    return numbered(rows.withColumn("_safe", T.safe_id(F.col(base))), ["_safe"], [order], "_n").withColumn("unique_id", named).drop("_safe", "_n")


def output_folders(files: DataFrame) -> DataFrame:
    """Adds output_dir to files (doc_ord, slug, checksum): the first of a slug has it, others add 8 characters of their hash. The
    first is a minimum that is taken before anything is shuffled, and comes back by a join that splits common slugs."""
    first = files.groupBy("slug").agg(F.min_by("checksum", "doc_ord").alias("_first"))
    named = F.when(F.col("_first").eqNullSafe(F.col("checksum")), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring(F.regexp_replace("checksum", "^sha256:", ""), 1, 8)))
    return files.join(first, "slug", "left").withColumn("output_dir", named).select(*files.columns, "output_dir")


def first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, a minimum that is taken before anything is shuffled."""
    first = F.min_by(F.struct(*rows.columns), order).alias("_r")
    return rows.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(first).select("_r.*")


_EDGE = ("source_id", "source_type", "target_id", "target_type", "relation_type", "evidence", "locator")


def _edges(rows: DataFrame, source: str, source_type: str, target: Column | str, target_type: str, relation: str, evidence: Column | None = None, locator: Column | None = None) -> DataFrame:
    target = F.col(target) if isinstance(target, str) else target
    none = F.lit(None).cast("string")
    values = (F.col(source).cast("string"), F.lit(source_type), target.cast("string"), F.lit(target_type), F.lit(relation), none if evidence is None else evidence, none if locator is None else locator)
    return rows.select(*[v.alias(n) for v, n in zip(values, _EDGE)])


def relations(chunks: DataFrame, assets: DataFrame, document_mentions: DataFrame, chunk_mentions: DataFrame) -> DataFrame:
    """All seven kinds of edges, duplicates kept."""
    where = F.col("locator")
    topic = F.concat(F.lit("topic:"), F.regexp_replace(T.casefold(F.col("topic_label")), "[^A-Za-z0-9_-]+", "_"))
    parts = [
        _edges(document_mentions, "doc_id", "document", "entity_id", "entity", "document_mentions_entity"),
        _edges(chunks, "doc_id", "document", "chunk_id", "chunk", "document_has_chunk", F.col("title"), where),
        _edges(chunks.filter("locator is not null and locator != ''"), "chunk_id", "chunk", "locator", "locator", "chunk_has_source_locator", None, where),
        _edges(assets, "doc_id", "document", "asset_id", "asset", "document_has_asset"),
        _edges(chunk_mentions, "chunk_id", "chunk", "entity_id", "entity", "chunk_mentions_entity"),
    ]
    if "topic_label" in chunks.columns:
        own = chunks.filter("topic_label is not null").withColumn("_topic", topic)
        parts.append(_edges(own, "_topic", "topic", "chunk_id", "slide", "topic_contains_slide", None, where))
    if "batch_id" in chunks.columns:
        own = chunks.filter("batch_id is not null").withColumn("_batch", F.concat(F.lit("batch:"), F.col("batch_id")))
        parts.append(_edges(own, "_batch", "batch", "chunk_id", "slide", "batch_mentioned_in_slide", None, where))
    return reduce(DataFrame.unionByName, parts)


def graph_nodes(*families: DataFrame) -> DataFrame:
    """Nodes (id, type, label) of the families in order; of an id that comes again the last stays."""
    numbered = [f.select(F.col("id").cast("string").alias("id"), "type", "label", F.lit(k).alias("_k")) for k, f in enumerate(families)]
    return reduce(DataFrame.unionByName, numbered).groupBy("id").agg(F.max_by("type", F.struct("_k", "label")).alias("type"), F.max_by("label", F.struct("_k", "label")).alias("label"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, type, count."""
    one = nodes.groupBy("type").count().select(F.lit("node").alias("part"), "type", F.col("count").alias("n"))
    return one.unionByName(edges.groupBy(F.col("relation_type").alias("type")).count().select(F.lit("edge").alias("part"), "type", F.col("count").alias("n")))


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """Seeds (id) and what is one edge away, at most so many nodes, and the edges among them."""
    own = seeds.select("id").distinct()
    out = edges.join(own, edges["source_id"] == own["id"], "left_semi").select(F.col("target_id").alias("id"))
    back = edges.join(own, edges["target_id"] == own["id"], "left_semi").select(F.col("source_id").alias("id"))
    near = out.unionByName(back).distinct().join(own, "id", "left_anti")
    chosen = own.withColumn("hop", F.lit(0)).unionByName(near.withColumn("hop", F.lit(1))).join(nodes, "id").orderBy("hop", "id").limit(most)
    ids = F.broadcast(chosen.select("id"))  # `most` rows
    inner = edges.join(ids, edges["source_id"] == F.col("id"), "left_semi").join(ids, edges["target_id"] == F.col("id"), "left_semi")
    return chosen, inner


def build(documents: DataFrame, chunks: DataFrame, document_entities: DataFrame, assets: DataFrame) -> Library:
    """documents: doc_id, doc_ord, title, ...; chunks: chunk_id, doc_id, chunk_ord, title, text, locator, heading_path, ...;
    document_entities: doc_id, entity_type, entity_text, position; assets: asset_id, doc_id, path. Entities are looked for in the
    documents' texts once and kept, as most tables need them."""
    ordered = written(document_entities, "document-entities").join(documents.select("doc_id", "doc_ord", "source_file"), "doc_id").withColumn("ord", F.struct("doc_ord", "position"))
    entities = written(dedupe_entities(ordered).withColumn("first_doc_ord", F.col("first_ord.doc_ord")), "entities")
    own = ordered.withColumn("normalized_text", T.normal_entity(F.col("entity_text"))).join(entities.select("entity_type", "normalized_text", "entity_id"), ["entity_type", "normalized_text"])
    held = written(contained(chunks.withColumn("doc_ord", F.lit(None).cast("long")), entities, bounded=False), "contained")
    places = chunks.select("chunk_id", "doc_id", "locator").join(documents.select("doc_id", "doc_ord", "source_file"), "doc_id")
    seen_before = F.col("first_doc_ord") <= F.col("doc_ord")
    inside = held.join(entities.select("entity_id", "first_doc_ord"), "entity_id").join(places, "chunk_id").filter(seen_before)
    document_mentions = own.select("entity_id", "doc_id", F.lit(None).cast("string").alias("chunk_id"), "source_file", F.lit(None).cast("string").alias("locator")).distinct()
    chunk_mentions = written(inside.select("entity_id", "doc_id", "chunk_id", "source_file", "locator"), "chunk-mentions")
    edges = relations(chunks.join(documents.select("doc_id"), "doc_id"), assets, document_mentions, chunk_mentions)
    shown = SHOWN if set(SHOWN.values()) <= set(documents.columns) and not set(SHOWN) & set(chunks.columns) else {}
    rows = _with_facts(chunks, documents.select("doc_id", "doc_ord", *[F.col(c).alias(name) for name, c in shown.items()]), entities, held)
    return Library(
        documents, rows.drop(*shown), entities.drop("first_ord"), document_mentions.unionByName(chunk_mentions),
        first_rows(assets, ["doc_id", "path"], "asset_id"), edges, rows if shown else None,
    )


def _with_facts(chunks: DataFrame, documents: DataFrame, entities: DataFrame, held: DataFrame) -> DataFrame:
    """Chunks with their documents' columns, their noise and their entities' text. What comes from other tables is put together
    for the keys alone, so that texts are shuffled once."""
    keys = chunks.select("chunk_id", "doc_id").distinct().join(documents, "doc_id")
    facts = with_entity_text(keys, entities, held).withColumnsRenamed({"chunk_id": "_chunk", "doc_id": "_doc"})
    own = chunks.drop("entities")
    joined = own.join(facts, (F.col("doc_id") == F.col("_doc")) & F.col("chunk_id").eqNullSafe(F.col("_chunk")))
    first = ["chunk_id", "doc_id", *[c for c in own.columns if c not in ("chunk_id", "doc_id")], "doc_ord"]
    noise = ["_noise.is_noisy", F.round("_noise.noise_score", 3).alias("noise_score"), "_noise.noise_reasons"]
    marked = joined.withColumn("_noise", T.noise(F.col("text"), F.col("locator")))
    return marked.select(*first, *noise, "entities", *[c for c in documents.columns if c not in ("doc_id", "doc_ord")])
