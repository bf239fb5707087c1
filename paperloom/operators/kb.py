"""Evidence from several libraries at once: each is searched by the whole cascade, in one plan.

All stages of the cascade (the query, its expansions, tokens) are looked for in one scan, which keeps what they count in each row
but no texts. Counts of rows, mean lengths and document frequencies are taken for each library apart, so a library's scores are
those it would have alone. Each library shows the first of its stages that found anything; libraries are never ranked against one
another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import written
from . import search
from .search import Filters, Node, QuerySyntaxError


@dataclass(frozen=True)
class Stage:
    """kind: match, start (of an identifier) or tokens."""

    kind: str
    query: str
    alias: str | None = None
    exact: bool = False


def stages(query: str, aliases: dict[str, list[str]] | None = None) -> list[Stage]:
    """What is looked for, one after another, until something is found."""
    others = search.expansions(query, aliases)
    out = [Stage("match", query)]
    for other, label, exact in others:
        out.append(Stage("match", other, label, exact))
        if exact and other.endswith("*"):
            out.append(Stage("start", other, label, exact))
    return out + [Stage("tokens", q, label, exact) for q, label, exact in [(query, None, False), *others] if len(T.query_tokens(q)) > 1]


def chosen(rows: DataFrame, libraries: list[str] | None) -> DataFrame:
    """Rows of the libraries that are asked for (all, if none are), with their place in that order (by id, if none are)."""
    if libraries is None:
        return rows.withColumn("library_order", F.lit(0))
    order = list(dict.fromkeys(libraries))
    place = reduce(lambda acc, kv: F.when(F.col("library_id") == kv[1], F.lit(kv[0])).otherwise(acc), enumerate(order), F.lit(None).cast("int"))
    return rows.filter(F.col("library_id").isin(order)).withColumn("library_order", place)


def evidence(rows: DataFrame, query: str, limit: int = 5, libraries: list[str] | None = None, filters: Filters | None = None, mentions: DataFrame | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """library_id, library_order, stage, rank, chunk_id, score, total_hits, mode, query_used, alias_used, normalized_used,
    matched_tokens: the first `limit` rows of each library, from the first stage that finds anything there. rows: rows to search
    with library_id."""
    own, nodes, plan = search.with_terms(chosen(rows, libraries)), [], stages(query, aliases)
    hits: dict[str, Column] = {}
    of_stage: list[list[int]] = []  # the nodes of each stage
    for k, stage in enumerate(plan):
        mine = []
        for q in T.query_tokens(stage.query) if stage.kind == "tokens" else [stage.query] if stage.kind == "match" else []:
            try:
                node = search.parse(q)
            except QuerySyntaxError:
                break
            if node not in nodes:
                nodes.append(node)
            mine.append(nodes.index(node))
        if not mine:
            text = stage.query.rstrip("*") if stage.kind == "start" else stage.query
            hits[f"_sub{k}"] = search.start_of(text) if stage.kind == "start" else search.substring(text)
        of_stage.append(mine)
    each, over_all = search.counted(own, Node("or", tuple(nodes)))
    hits |= {f"_hit{k}": search.predicate(n) for k, n in enumerate(nodes)}
    counts = [c for c in each.columns if c.startswith("_tf")]
    asked = search.apply_filters(own, filters, mentions).select("library_id", "chunk_id", F.lit(True).alias("_asked")) if filters else None
    slim = each.select("library_id", "library_order", "chunk_id", "chunk_ord", "document_kind", "is_noisy", "noise_score", search.rank_adjustment().alias("adjustment"), "_dl", *counts, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in hits.items()])
    slim = written(slim, "library-rows")
    statistics = slim.groupBy("library_id").agg(*over_all)
    found = slim.filter(reduce(lambda a, b: a | b, (F.col(n) for n in hits))).join(statistics, "library_id")
    if asked is not None:
        found = found.join(asked, ["library_id", "chunk_id"]).drop("_asked")
    found = written(found, "library-matches")

    starts = [0]
    for node in nodes:
        starts.append(starts[-1] + len(search.phrases(node)))

    def score_of(k: int) -> Column:
        out = F.lit(0.0)
        for j in range(starts[k], starts[k + 1]):
            out = out + search.idf(F.col("n"), F.col(f"df{j}")) * search.saturated(F.col(f"_tf{j}"), F.col("_dl"), F.col("mean"))
        return F.col("adjustment") - out

    out = []
    none = F.array().cast("array<string>").alias("matched_tokens")
    for k, (stage, mine) in enumerate(zip(plan, of_stage)):
        names = ["library_id", "library_order", "chunk_id", "chunk_ord"]
        if stage.kind == "tokens":
            own = _pools(found, mine, T.query_tokens(stage.query), score_of, max(search.POOL, limit))
        elif mine:
            own = found.filter(f"_hit{mine[0]}").select(*names, score_of(mine[0]).alias("score"), none).withColumn("_order", F.array(F.round("score", 9)))
        else:
            own = found.filter(f"_sub{k}").select(*names, F.lit(0.0).alias("score"), none, F.array("adjustment").alias("_order"))
        shown = {"mode": F.lit("token_fallback" if stage.kind == "tokens" else "fts"), "query_used": F.lit(stage.query), "alias_used": F.lit(stage.alias).cast("string"), "normalized_used": F.lit(stage.exact)}
        out.append(own.withColumn("stage", F.lit(k)).withColumns(shown))
    every = reduce(DataFrame.unionByName, out)
    first = every.groupBy("library_id").agg(F.min("stage").alias("stage"))
    mine = every.join(first, ["library_id", "stage"])
    total = mine.groupBy("library_id").agg(F.count("*").alias("total_hits"))
    best = Window.partitionBy("library_id").orderBy("_order", "chunk_ord", "chunk_id")
    top = mine.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return top.join(total, "library_id").select("library_id", "library_order", "stage", "rank", "chunk_id", "score", "total_hits", "mode", "query_used", "alias_used", "normalized_used", "matched_tokens")




def _pools(found: DataFrame, nodes: list[int], tokens: list[str], score_of, pool: int) -> DataFrame:
    """The best rows of each token and library, merged; the more tokens match, the better."""
    parts = []
    for k, token in zip(nodes, tokens):
        best = Window.partitionBy("library_id").orderBy(F.round("score", 9), "chunk_ord", "chunk_id")
        own = found.filter(f"_hit{k}").withColumn("score", score_of(k)).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= pool)
        parts.append(own.select("library_id", "library_order", "chunk_id", "chunk_ord", "document_kind", "is_noisy", "noise_score", "adjustment", "score", "_rank", F.lit(token).alias("_token"), F.lit(tokens.index(token)).alias("_k")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("library_id", "library_order", "chunk_id", "chunk_ord", "document_kind", "is_noisy", "noise_score", "adjustment").agg(
        F.min_by("score", "_k").alias("score"), F.array_sort(F.collect_set("_token")).alias("matched_tokens"), F.min("_rank").alias("_best")
    )
    bonus = F.when(F.col("document_kind") == search.FAILURE_KIND, F.lit(search.FAILURE_WEIGHT)).otherwise(F.lit(0.0)) if search.FAILURE_TOKENS & set(tokens) else F.lit(0.0)
    order = F.array(-F.size("matched_tokens").cast("double"), F.col("adjustment") + bonus, F.col("_best").cast("double"), F.col("is_noisy").cast("double"), F.coalesce("noise_score", F.lit(0.0)))
    return merged.select("library_id", "library_order", "chunk_id", "chunk_ord", "score", "matched_tokens", order.alias("_order"))


def context(rows: DataFrame, query: str, limit: int = 5, around: int = 1, libraries: list[str] | None = None, **more: object) -> tuple[DataFrame, DataFrame]:
    """(evidence with what is shown of each row, supporting chunks): for each row of evidence the nearest chunks of its document,
    with for_chunk_id and position."""
    found = written(evidence(rows, query, limit, libraries, **more), "evidence")
    own = rows.withColumn("doc_id", F.concat_ws("\u0001", "library_id", F.col("doc_id").cast("string")))  # a document of one library
    keys = ["library_id", "chunk_id"]
    shown = rows.join(F.broadcast(found), keys)  # `limit` rows of each library
    targets = own.select("doc_id", *keys).join(F.broadcast(found.select(*keys)), keys, "left_semi")
    near = search.nearest(own, targets, around).withColumn("library_id", F.substring_index("doc_id", "\u0001", 1)).drop("doc_id")
    packets = rows.join(near, keys).withColumnRenamed("target_id", "for_chunk_id")
    fields = ["library_id", "source_file", "locator", "chunk_id", "doc_id", "document_title", "document_kind", "evidence_type"]
    limited = T.limitation(F.col("locator"), F.col("is_noisy")).alias("limitation")
    return (
        shown.select(*fields, "library_order", "stage", "rank", "score", "total_hits", "mode", "query_used", "alias_used", "matched_tokens", limited, T.preview(F.col("text"), query).alias("preview"), "text"),
        packets.select(*fields, "for_chunk_id", "position", limited, T.preview(F.col("text"), "", search.RELATED_PREVIEW).alias("preview")),
    )
