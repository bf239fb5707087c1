"""A library's search index: rows and positional postings, written once, and match expressions answered from them.

Rows are written by the bucket of their chunk's id, postings by the bucket of the first letters of their term, sorted by term:
a query reads the buckets of its terms (a prefix of enough letters has one bucket too) and, within them, the row groups that hold
them. Each posting has its chunk's length, number and rank adjustment, so a search without filters reads no rows but those of the
page that it shows. The number of chunks and their mean length are written beside them. Texts are never cut into terms again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import search
from .search import INDEXED, Filters, Node, Phrase

#: Letters of a term that decide its bucket.
LETTERS = 3
#: Rows whose postings are grouped at once, and terms whose postings a task sorts, about.
ROWS, TASK_TERMS = 1000, 4_000_000
#: Columns that rows get here or in search.search_rows.
OWN = ["bucket", "length", "adjustment", "headings", *[f"terms_{c}" for c in INDEXED]]
_FACTS = ["length", "chunk_ord", "adjustment", "document_kind", "is_noisy", "noise_score"]


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def postings_of(rows: DataFrame) -> DataFrame:
    """term, column, chunk_id, positions (from 0, ascending) and the chunk's facts, for rows with terms and facts. A chunk's
    postings come from its own row, so nothing is shuffled. Those of ROWS rows and a column are in the order of terms and chunks:
    sorting them all is then mostly a merge."""
    own = rows.select("chunk_id", *_FACTS, *[f"terms_{c}" for c in INDEXED])
    kinds = {f.name: f for f in own.schema}
    schema = StructType([StructField("term", StringType()), StructField("column", StringType()), kinds["chunk_id"], *[kinds[c] for c in _FACTS], StructField("positions", ArrayType(IntegerType()))])
    return own.mapInArrow(_grouped(schema), schema)


def _grouped(schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = to_arrow_schema(schema)
    facts = schema.names[2:-1]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
                for column in INDEXED:
                    lists = batch.column(batch.schema.get_field_index(f"terms_{column}"))
                    terms = lists.flatten().dictionary_encode()
                    if not len(terms):
                        continue
                    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(lengths)), lengths)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    code = terms.indices.to_numpy(zero_copy_only=False)
                    rank = np.empty(len(terms.dictionary), np.int64)
                    rank[pc.array_sort_indices(terms.dictionary).to_numpy()] = np.arange(len(rank))
                    key = rank[code] * len(lengths) + row
                    order = np.argsort(key, kind="stable")  # places of a term stay in order
                    first = np.flatnonzero(np.diff(key[order], prepend=-1))
                    ends = np.append(first, len(order)).astype(np.int32)
                    chunk = pa.array(row[order[first]])
                    out = [terms.dictionary.take(pa.array(code[order[first]])), pa.array([column] * len(first)), *[batch.column(batch.schema.get_field_index(c)).take(chunk) for c in facts]]
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, kinds)], schema=kinds)

    return grouped


def write_index(rows: DataFrame, folder: str, buckets: int = 256, dealt: bool = False) -> Index:
    """Writes rows to search (search.search_rows) and their postings into a fresh folder.

    Each task writes the postings of its own rows, sorted, into a file of each bucket: nothing is shuffled, and a term that very
    many chunks hold is spread over the files of its bucket. A bucket has a file for each TASK_TERMS terms of the library, about.
    dealt: rows are shuffled to their buckets before their texts are cut into terms, so that a bucket's rows have few files, where
    rows come in many small parts."""
    length = F.size(F.concat(*[F.col(f"terms_{c}") for c in INDEXED])).cast("double")
    own = rows.withColumn("bucket", _bucket(F.col("chunk_id"), buckets))
    own = own.hint("rebalance", F.col("bucket")) if dealt else own
    own = search.with_terms(own.sortWithinPartitions("bucket")).withColumns({"length": length, "adjustment": search.rank_adjustment()})
    own.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/index")
    spark = rows.sparkSession
    kept = spark.read.schema(own.schema).parquet(f"{folder}/index")
    kept.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/statistics")
    counted = spark.read.parquet(f"{folder}/statistics").first()
    tasks = max(spark.sparkContext.defaultParallelism, ceil(counted["n"] * (counted["mean"] or 0) / TASK_TERMS))
    found = postings_of(kept.coalesce(tasks)).withColumn("bucket", _bucket(F.substring("term", 1, LETTERS), buckets))
    found.sortWithinPartitions("bucket", "term", "chunk_id").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """The index that write_index has written."""
    s = spark.read.parquet(f"{folder}/statistics").first()
    rows = spark.read.parquet(f"{folder}/index").drop(*[f"terms_{c}" for c in INDEXED])
    return Index(rows, spark.read.parquet(f"{folder}/postings"), s["n"], s["mean"] or 0.0, s["buckets"])


@dataclass(frozen=True)
class Index(search.Rows):
    """A written index; search.search and the functions beside it take one in place of rows."""

    postings: DataFrame
    n: float
    mean: float
    buckets: int

    def fetch(self, chunk_ids: list[str]) -> DataFrame:
        ids = self.rows.sparkSession.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")
        wanted = sorted({r[0] for r in ids.select(_bucket(F.col("chunk_id"), self.buckets)).collect()})  # one page
        return self.rows.filter(F.col("bucket").isin(wanted) & F.col("chunk_id").isin(chunk_ids))

    def _of_terms(self, terms: list[tuple[str, bool]]) -> DataFrame:
        """Postings of the terms (term, whether it is a prefix), from their buckets."""
        hit = reduce(lambda a, b: a | b, (F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in terms))
        if any(prefix and len(t) < LETTERS for t, prefix in terms):
            return self.postings.filter(hit)  # such a prefix may be in any bucket
        named = self.rows.sparkSession.createDataFrame([(t[:LETTERS],) for t, _ in terms], "start string")
        wanted = sorted({r[0] for r in named.select(_bucket(F.col("start"), self.buckets)).collect()})  # the query's terms
        return self.postings.filter(F.col("bucket").isin(wanted) & hit)

    def with_places(self, nodes: list[Node]) -> tuple[DataFrame, search.Places]:
        """A row for each chunk that holds any term of the nodes, with the places of each term in each column."""
        terms = list(dict.fromkeys((t, p.is_prefix(k)) for node in nodes for p in _every_phrase(node) for k, t in enumerate(p.terms)))
        number = {t: k for k, t in enumerate(terms)}

        def held(k: int, column: str) -> Column:
            term, prefix = terms[k]
            own = (F.col("term").startswith(term) if prefix else F.col("term") == term) & (F.col("column") == column)
            return F.array_sort(F.flatten(F.collect_list(F.when(own, F.col("positions"))))).alias(f"_p{k}_{column}")

        if not terms:
            return self.postings.filter(F.lit(False)).select("chunk_id", *_FACTS), lambda column, phrase: F.array().cast("array<int>")
        found = self._of_terms(terms).groupBy("chunk_id", *_FACTS).agg(*[held(k, c) for k in range(len(terms)) for c in INDEXED])

        def places(column: str, phrase: Phrase) -> Column:
            own = [F.col(f"_p{number[t, phrase.is_prefix(k)]}_{column}") for k, t in enumerate(phrase.terms)]
            if not own:
                return F.array().cast("array<int>")

            def begins(x: Column) -> Column:
                follows = [F.array_contains(p, x + F.lit(k)) for k, p in enumerate(own) if k]
                return reduce(lambda a, b: a & b, follows, x == 0 if phrase.initial else F.lit(True))

            return own[0] if len(own) == 1 and not phrase.initial else F.filter(own[0], begins)

        return found, places

    def matching(self, node: Node) -> DataFrame:
        """chunk_id and the facts of the chunks that match."""
        found, places = self.with_places([node])
        return found.filter(search.predicate(node, places)).select("chunk_id", *_FACTS)

    def any_of(self, queries: list[str], filters: Filters, mentions: DataFrame | None) -> list[DataFrame]:
        nodes = [search.parse(q) for q in queries]
        found, places = self.with_places(nodes)
        own = [p for n in nodes for p in search.phrases(n)]
        each = found.select("chunk_id", *_FACTS, F.col("length").alias("_dl"), *[search.count_of(*p, places).cast("double").alias(f"_tf{k}") for k, p in enumerate(own)], *[search.predicate(n, places).alias(f"_hit{k}") for k, n in enumerate(nodes)])
        kept = search.written(each, "matches")  # a query's postings
        having = kept.agg(F.lit(0).alias("none"), *[F.count_if(F.col(f"_tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(own))]).first().asDict()
        if filters != Filters():
            kept = search.written(kept.join(search.apply_filters(self.rows, filters, mentions).select("chunk_id"), "chunk_id", "left_semi"), "matches")
        return search.scored_apart(kept, nodes, {"n": self.n, "mean": self.mean} | having)


def _every_phrase(node: Node) -> list[Phrase]:
    """The phrases of a node, those after NOT too."""
    return [*node.phrases, *(p for part in node.parts for p in _every_phrase(part))]
