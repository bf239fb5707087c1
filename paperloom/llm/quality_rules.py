"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. One multinomial over the buckets comes from
all trusted documents, one from all documents; a document's score is the mean, over its n-grams, of the log of the ratio of the
two. It is kept if the score reaches a fixed threshold. All of it is Spark expressions. Up to MOST_SENT trusted ids are sent to
the tasks, beyond that the documents that have an id meet them in a shuffle; the counts are summed map-side into at most
2 * BUCKETS rows a task, and the table of ratios has that many numbers, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, let

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Counts by which the trusted multinomial is drawn to that of all documents.
PRIOR = 20_000.0
THRESHOLD = -0.12
#: Ids of trusted documents that are sent to every task at most; more meet the documents in a shuffle.
MOST_SENT = 1_000_000
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _bucket(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BUCKET_BITS).cast("int")


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more in the text."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def repeated(sorted_: Column) -> Column:  # starts of windows that have an equal neighbour in the order of hashes
        twin = lambda x, j: F.coalesce(F.get(sorted_, j)["hash"] == x["hash"], F.lit(False))
        starts = F.transform(sorted_, lambda x, j: F.when(twin(x, j - 1) | twin(x, j + 1), x["at"]))
        return F.sort_array(F.array_compact(starts))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeated), covered)
        )

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, once each, of all documents that are labelled quality 1 and nothing else."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    return good.select(F.col("doc_id").cast("long").alias("doc_id"))


def log_ratios(docs: DataFrame, trusted: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """One row with ratios, array<double>: of the words' buckets, then of the pairs'. trusted: doc_id, once each."""
    text = F.coalesce("text", F.lit(""))
    grams = let(
        words_of(text),
        lambda w: F.flatten(
            F.transform(w, lambda x, i: F.array(_bucket(x), F.when(i + 1 < F.size(w), _bucket(x, F.get(w, i + 1)) + BUCKETS)))
        ),
    )
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), text.alias("text"))
    marked = trusted.select(F.col("doc_id").alias("_doc"), F.lit(1).alias("_trusted"))
    if trusted.limit(most_sent + 1).count() <= most_sent:  # one scan, and nothing of a text is shuffled
        found = own.join(F.broadcast(marked), "_doc", "left").select(F.explode(grams).alias("bucket"), F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.lit(1).alias("_all"))
    else:  # only the trusted documents' texts have to meet ids
        every = own.select(F.explode(grams).alias("bucket"), F.lit(0).alias("_trusted"), F.lit(1).alias("_all"))
        chosen = own.filter("_doc is not null").join(marked, "_doc", "left_semi")
        found = every.unionByName(chosen.select(F.explode(grams).alias("bucket"), F.lit(1).alias("_trusted"), F.lit(0).alias("_all")))
    counts = found.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("_all").alias("n"), F.sum("_trusted").alias("t"))
    every = docs.sparkSession.range(0, 2 * BUCKETS, 1, 4).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0)
    lists = filled.groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "t"))).alias("rows"))  # 2 * BUCKETS rows

    def ratios(rows: Column) -> Column:
        total = lambda name: F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x[name]).cast("double")
        return let(
            F.struct(total("n").alias("n"), total("t").alias("t")),
            lambda sums: F.transform(rows, lambda x: _ratio(x["n"], x["t"], sums["n"], sums["t"])),
        )

    return lists.select(ratios(F.col("rows")).alias("ratios"))


def _ratio(n: Column, t: Column, all_n: Column, all_t: Column) -> Column:
    raw = (n + 0.5) / (all_n + 0.5 * 2 * BUCKETS)
    return F.log(((t + PRIOR * raw) / (all_t + PRIOR)) / raw)


def measured(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, name: str = "rules") -> DataFrame:
    """docs (doc_id, text, ...) with the struct `name` added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    score, base_failed, kept. A null text has no words, so it fails. Every row is judged and stays, repeated ones too."""
    own = fresh(docs, "_ratios")
    text, table = F.coalesce("text", F.lit("")), F.col(own)

    def score(w: Column, r: Column) -> Column:
        own = F.transform(
            w, lambda x, i: F.get(r, _bucket(x)) + F.when(i + 1 < F.size(w), F.get(r, _bucket(x, F.get(w, i + 1)) + BUCKETS)).otherwise(0.0)
        )
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), 2 * F.size(w) - 1)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat"), let(table, lambda r: score(w, r)).alias("score")),
    )
    counted = F.struct(
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        of_words.alias("w"),
    )

    def verdict(c: Column) -> Column:
        failed = (c["w"]["n"] < 20) | (100 * c["w"]["repeat"] > 30 * c["w"]["n"])
        return F.struct(
            c["w"]["n"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["n_dup_lines"].alias("n_dup_lines"), c["w"]["repeat"].alias("n_repeat_words"), c["w"]["score"].alias("score"),
            failed.alias("base_failed"), (~failed & (c["w"]["score"] >= threshold)).alias("kept"),
        )

    ratios = log_ratios(docs, trusted_ids(labels)).scalar()  # its optimised plan holds one reference, no copy in each row
    return docs.withColumn(own, ratios).withColumn(name, let(counted, verdict)).drop(own)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id and the fields of `rules`. An empty table gives no rows."""
    return measured(docs.select(F.col("doc_id").cast("long"), "text"), labels, threshold).select("doc_id", "rules.*")


def passed(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their columns, whatever their names."""
    name = fresh(docs, "rules")
    return measured(docs, labels, threshold, name).filter(F.col(name)["kept"]).drop(name)
