"""Concept mining and co-occurrence graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions import text as T
from ..tables import written

#: Words that are no concepts, sources' weights, bonuses and the gate.
STOPWORDS = [
    "a", "an", "and", "are", "as", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "to", "with",
    "system", "user texts", "page", "pages", "document", "documents", "file", "source", "asset", "assets", "image", "images",
    "locator", "locators", "extracted", "form", "group", "summary", "untitled", "png", "jpg", "jpeg", "table", "section",
    "text", "chapter", "title", "untitled source page",
]
SOURCE_WEIGHTS = {"structured_header": 7.0, "entity": 6.0, "document_title": 4.0, "heading": 4.0, "text_phrase": 2.0, "weak_page_title": 0.5}
NOISY_PHRASES = ["cover sheet", "private confidential", "liang private", "selection new", "caner sheet"]
NOISY_PART = "pm-group"
UNITS = ["min", "degc", "%", "bar", "rpm"]
LEAST_SCORE, MATCH_BONUS, MATCH_CAP, DOCUMENT_BONUS, DOCUMENT_CAP = 3.0, 0.45, 8, 0.8, 5
TITLE_TERMS, HEADING_TERMS, TEXT_TERMS, NODES, EDGES_LEAST, EDGES_FACTOR = 12, 10, 24, 150, 1000, 6
CJK = r"[一-鿿]"
#: What a label is no concept by, what is no word of a text, and what a word is.
SHEETS, NUMBERED = ("data", "assessment", "score", "risk"), (" form ", "group")
NUMBER, LANGUAGE_TAG, FILE_NAME, DRAWING = r"^(\d{4}|\d+(\.\d+)?)$", "^[a-z]{2}-[a-z]{2}$", r"\.(png|jpe?g|gif|bmp|tiff|pdf|docx?|xlsx?|pptx?|txt|md|html)$", r"^eng-\d+$"
RELATIONS = ("document_has_chunk", "document_has_asset", "chunk_has_source_locator")
NO_WORDS, WORD, WORD_EDGES = r"https?://\S+|[\w.+-]+@[\w.-]+\.\w+|\+?\d[\d\s().-]{7,}\d|[\\/_]+", "[A-Za-z][A-Za-z0-9+.-]*", r"^[.+-]+|[.+-]+$"


def normal_label(label: Column) -> Column:
    return T.normal_entity(F.coalesce(label, F.lit("")))


def noisy_label(label: Column, stopwords: list[str] = STOPWORDS, phrases: list[str] = NOISY_PHRASES) -> Column:
    """Whether a normalised label is no concept."""
    sheet = label.endswith(" sheet") & ~F.substring_index(label, " ", 1).isin(*SHEETS)
    numbered = label.rlike(r"\d") & (F.contains(F.concat(F.lit(" "), label, F.lit(" ")), F.lit(NUMBERED[0])) | F.contains(label, F.lit(NUMBERED[1])))
    return (
        (label == "") | label.isin(stopwords) | label.isin(phrases) | F.contains(label, F.lit(NOISY_PART)) | F.contains(label, F.lit("private")) | F.contains(label, F.lit("confidential"))
        | sheet | numbered | ((F.length(label) < 3) & ~label.rlike(CJK)) | label.rlike(NUMBER) | label.rlike(LANGUAGE_TAG)
        | label.isin(UNITS) | label.startswith("assets/") | label.rlike(FILE_NAME) | label.rlike(DRAWING) | label.isin(*RELATIONS)
    )


def tokens(text: Column) -> Column:
    """Lower-cased words that could be concepts, in order, without addresses, numbers and paths."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), NO_WORDS, " ")
    words = F.transform(F.regexp_extract_all(clean, F.lit(WORD), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, WORD_EDGES, "")))
    return F.filter(words, lambda w: ~noisy_label(w))


def bigrams(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def cjk_terms(text: Column) -> Column:
    """Runs of two to eight Chinese characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{CJK}{{2,8}}"), F.lit(0))


def candidates(rows: DataFrame, text: Column, keys: list[str], most: int, source: str) -> DataFrame:
    """keys, label, source: of each row the most frequent pairs of neighbouring words, then words, then the first Chinese terms,
    at most so many; equal counts in the order first seen."""
    words = rows.select(*keys, tokens(text).alias("_w"), cjk_terms(text).alias("_c"))
    both = F.concat(
        F.transform(bigrams(F.col("_w")), lambda x, i: F.struct(F.lit(0).alias("k"), x.alias("label"), i.alias("i"))),
        F.transform("_w", lambda x, i: F.struct(F.lit(1).alias("k"), x.alias("label"), i.alias("i"))),
        F.transform(F.slice("_c", 1, most), lambda x, i: F.struct(F.lit(2).alias("k"), x.alias("label"), i.alias("i"))),
    )
    counted = words.select(*keys, F.explode(both).alias("x")).groupBy(*keys, "x.k", "x.label").agg(F.when(F.col("x.k") < 2, F.count("*")).otherwise(F.lit(1)).alias("n"), F.min("x.i").alias("first"))
    order = Window.partitionBy(*keys).orderBy("k", F.desc("n"), "first")
    return counted.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= most) & ~noisy_label(F.col("label"))).select(*keys, "label", F.lit(source).alias("source"))


#: Words that make a label a header's, labels that are headers, titles that say little.
HEADER_WORDS = ("assessment", "leadership", "thinking", "background", "experience", "risk", "study")
HEADER_LABELS = (
    "leadership", "communication", "collaboration", "resilience", "english", "result", "case study", "logical thinking", "strategic thinking",
    "technical background", "learning agility", "background information",
)
WEAK_KINDS, WEAK_TITLES = ("generic_pdf", "low_structure_pdf"), ("cover", "cover sheet", "summary", "sheet", "untitled source page")


def source_type(label: Column, base: Column, document_kind: Column, chunk_title: Column) -> Column:
    """Where a label really stands: headings and phrases that look like a structured header count as one, and headings of
    weakly structured pages as weak titles."""
    clean = normal_label(label)
    words = F.split(clean, " ")
    header = ~noisy_label(clean) & ((F.size(words).between(2, 6) & F.arrays_overlap(words, F.array(*map(F.lit, HEADER_WORDS)))) | clean.isin(*HEADER_LABELS))
    weak = normal_label(document_kind).isin(*WEAK_KINDS) | normal_label(chunk_title).isin(*WEAK_TITLES)
    return F.when(base.isin("heading", "text_phrase") & header, F.lit("structured_header")).when((base == "heading") & weak, F.lit("weak_page_title")).otherwise(base)


def entity_graph(mentions: DataFrame, most: int = NODES) -> tuple[DataFrame, DataFrame]:
    """Entities of the most documents, and how many documents hold both of two of them. mentions: doc_id, entity_id, label."""
    own = mentions.select("doc_id", "entity_id", "label").distinct()
    nodes = own.groupBy("entity_id").agg(F.min("label").alias("label"), F.count("*").alias("documents")).orderBy(F.desc("documents"), "entity_id").limit(most)
    kept = own.join(F.broadcast(nodes.select("entity_id")), "entity_id", "left_semi")  # a document has `most` of them at most
    return nodes, cooccurrence(kept, "doc_id", "entity_id")


def concept_index(found: DataFrame) -> DataFrame:
    """label and its measures from candidates (doc_id, chunk_id, label, source), gated by quality."""
    own = found.withColumn("label", normal_label(F.col("label"))).filter(~noisy_label(F.col("label")))
    weight = reduce(lambda acc, kv: F.when(F.col("source") == kv[0], F.lit(kv[1])).otherwise(acc), SOURCE_WEIGHTS.items(), F.lit(1.0))
    grouped = own.groupBy("label").agg(
        F.max(weight).alias("source_score"), F.count("*").alias("match_count"), F.count_distinct("doc_id").alias("doc_count"),
        F.count_distinct("chunk_id").alias("chunk_count"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    score = F.col("source_score") + F.least(F.col("match_count"), F.lit(MATCH_CAP)) * MATCH_BONUS + F.least(F.col("doc_count"), F.lit(DOCUMENT_CAP)) * DOCUMENT_BONUS
    only = lambda s: (F.size("sources") == 1) & (F.get("sources", F.lit(0)) == s)
    scored = grouped.withColumn("score", score).withColumn("weight", F.round(score + F.col("chunk_count") + F.col("doc_count"), 2))
    return scored.filter((F.col("score") >= LEAST_SCORE) & ~only("weak_page_title") & ~(only("document_title") & (F.col("match_count") == 1)))


def cooccurrence(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """left, right (left < right), count: how many groups hold both of two items. A group's items are paired by a join on the
    group, whose size the callers' caps on candidates a chunk bound."""
    own = pairs.select(group, item).distinct()
    both = own.withColumnRenamed(item, "left").join(own.withColumnRenamed(item, "right"), group).filter("left < right")
    return both.groupBy("left", "right").agg(F.count("*").alias("count"))


def concept_graph(index: DataFrame, pairs: DataFrame, most: int = NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes (label, score) of the highest weight and pairs, and the strongest edges among them."""
    degree = pairs.select(F.col("left").alias("label"), "count").unionByName(pairs.select(F.col("right").alias("label"), "count")).groupBy("label").agg(F.sum("count").alias("pairs"))
    nodes = index.join(degree, "label", "left").select("label", (F.col("weight") + F.coalesce("pairs", F.lit(0))).alias("score")).orderBy(F.desc("score"), "label").limit(most)
    ids = F.broadcast(nodes.select("label"))  # `most` rows
    inner = pairs.join(ids, pairs["left"] == F.col("label"), "left_semi").join(ids, pairs["right"] == F.col("label"), "left_semi")
    return nodes, inner.orderBy(F.desc("count"), "left", "right").limit(edge_limit(most))


def edge_limit(most: int) -> int:
    return max(most, min(EDGES_LEAST, EDGES_FACTOR * most))


def _literal(value: object, kind: DataType) -> Column:
    """A value, a row too, as a column of its type."""
    if isinstance(kind, StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def admitted(edges: DataFrame, order: list[str], most: int = NODES, until_full: bool = True) -> tuple[list[str], DataFrame]:
    """(nodes, edges): edges (source, target: string, ...) in ascending order of columns that tell them apart, each admitted if its
    ends fit among `most` nodes with those before it. until_full: none is admitted after the one that fills the nodes.

    Only edges that would bring in a node change what fits. They are taken in rounds: the first `most` of those that still fit by
    now, a top-k over the table; a round fills the nodes or brings in one for each edge that it takes, so a few rounds do,
    whatever the number of edges. What was admitted are the edges between the nodes: an edge is refused only if both of its ends
    are new and one place is left, and then one of them stays out."""
    edges = written(edges.withColumn("_o", F.struct(*order)), "edges")
    kinds = edges.schema["_o"].dataType
    nodes: list[str] = []
    last = None
    while len(nodes) < most:
        inside = [F.col(c).isin(nodes) if nodes else F.lit(False) for c in ("source", "target")]
        wanted = (inside[0] != inside[1]) if len(nodes) == most - 1 else ~(inside[0] & inside[1])
        if last is not None:
            wanted = wanted & (F.col("_o") > _literal(last, kinds))
        batch = edges.filter(wanted).orderBy("_o").limit(most).select("source", "target", "_o").collect()  # `most` rows
        if not batch:
            break
        for r in batch:
            new = [x for x in dict.fromkeys((r["source"], r["target"])) if x not in nodes]
            if len(nodes) + len(new) <= most:
                nodes += new
            last = r["_o"]
            if len(nodes) == most:
                break
    found = edges.filter(F.col("source").isin(nodes) & F.col("target").isin(nodes)) if nodes else edges.limit(0)
    if until_full and len(nodes) == most:
        found = found.filter(F.col("_o") <= _literal(last, kinds))
    return nodes, found


def admit_edges(edges: DataFrame, most: int = NODES) -> DataFrame:
    """Document-concept edges (source, target, count), strongest first, for as long as their nodes fit; once `most` nodes are there,
    those between them."""
    own = edges.select("source", "target", "count").withColumn("_less", -F.col("count"))
    return admitted(own, ["_less", "source", "target"], most, until_full=False)[1].select("source", "target", "count")


def _graph(nodes: list[str], edges: DataFrame, most: int, families: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) of the families that are among those admitted, and the first edges."""
    kept = [rows.filter(F.col("id").isin(nodes)).select("id", F.lit(kind).alias("type"), "label") for kind, rows in families]
    return reduce(DataFrame.unionByName, kept), edges.orderBy("_o").limit(edge_limit(most)).drop("_o")


def document_concept_graph(found: DataFrame, index: DataFrame, documents: DataFrame, most: int = NODES, keyword: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents and the concepts that stand in them: heavier concepts first, then by label and document.

    found: doc_id, label as in concept_index; index: its result; documents: doc_id, title. keyword: only edges of a concept or a
    document whose name holds it, whatever the case."""
    counts = found.select(F.col("doc_id").cast("string").alias("source"), normal_label(F.col("label")).alias("label")).groupBy("source", "label").agg(F.count("*").alias("weight"))
    titles = documents.select(F.col("doc_id").cast("string").alias("source"), F.col("title").alias("_title"))
    own = counts.join(index.select("label", (-F.col("weight")).alias("_less")), "label").join(titles, "source", "left")
    if keyword:
        own = own.filter(F.contains(T.casefold(F.concat_ws("\n", "label", "_title")), T.casefold(F.lit(keyword))))
    edges = own.select("source", F.concat(F.lit("concept:"), "label").alias("target"), F.lit("document_mentions_concept").alias("relation_type"), "weight", "label", "_less")
    nodes, kept = admitted(edges, ["_less", "label", "source"], most)
    families = [("document", documents.select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("label"))), ("concept", index.select(F.concat(F.lit("concept:"), "label").alias("id"), "label"))]
    return _graph(nodes, kept.drop("_less", "label"), most, families)


def document_entity_graph(documents: DataFrame, entities: DataFrame, mentions: DataFrame, most: int = NODES, keyword: str | None = None, show_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents and the entities that they mention, in the order of the mentions (doc_id, entity_id, ord: tells
    them apart). documents: doc_id, title, doc_ord; entities: entity_id, entity_text, first_ord. keyword: only edges of a document
    or an entity whose name holds it; with show_isolated, other such documents, then entities, fill the places left."""
    docs = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("label"), F.col("doc_ord").alias("place"))
    names = entities.select(F.col("entity_id").cast("string").alias("id"), F.col("entity_text").alias("label"), F.col("first_ord").alias("place"))
    holds = lambda c: F.contains(T.casefold(F.coalesce(c, F.lit(""))), T.casefold(F.lit(keyword)))
    own = mentions.select(F.col("doc_id").cast("string").alias("source"), F.col("entity_id").cast("string").alias("target"), "ord")
    own = own.join(docs.select(F.col("id").alias("source"), F.col("label").alias("_d")), "source").join(names.select(F.col("id").alias("target"), F.col("label").alias("_e")), "target")
    own = own.filter(holds(F.col("_d")) | holds(F.col("_e"))) if keyword else own
    nodes, kept = admitted(own.select("source", "target", F.lit("document_mentions_entity").alias("relation_type"), "ord"), ["ord"], most)
    for rows in (docs, names) if show_isolated and keyword else ():
        if len(nodes) < most:
            more = rows.filter(holds(F.col("label")) & ~(F.col("id").isin(nodes) if nodes else F.lit(False))).orderBy("place").limit(most - len(nodes))
            nodes += [r["id"] for r in more.select("id").collect()]  # `most` rows
    return _graph(nodes, kept.drop("ord"), most, [("document", docs), ("entity", names)])


def top_concepts(index: DataFrame, most: int) -> DataFrame:
    return index.orderBy(F.desc("weight"), F.desc("match_count"), "label").limit(most)


def document_preview(chunks: DataFrame, first: int = 8, each: int = 500, most: int = 1800) -> DataFrame:
    """doc_id, preview: the starts of a document's first chunks."""
    own = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_ord"))).filter(F.col("_n") <= first)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("text", 1, each).alias("t")))), lambda x: x["t"]), "\n\n")
    return own.groupBy("doc_id").agg(F.substring(joined, 1, most).alias("preview"))
