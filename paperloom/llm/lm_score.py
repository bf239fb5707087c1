"""Language-model scores: tables, training and scoring over a corpus; the model itself is in bit_mixing.

Training counts tokens (map-side, then a shuffle), takes the most frequent ones as the vocabulary, and counts every bit of every
training document in the channels' slots, and the spelling of each of those tokens once; the tasks' slot counts are summed block
by block. A corpus of more different tokens gets more slots, up to MOST_SLOT_BITS. What is sent to each task has a bound:
VOCABULARY tokens with their codes, the slots' states and the counts of the MOST_SENT most frequent tokens; other tokens' counts,
which only the base score needs, come by a join.

Scoring reads each text once, in order. Weights and map are learned within the document, so a score depends on the document and
the counts alone, not on how the table is cut. A training document is in the counts that predict it: its score is the model's
probability of it, as that of any other text, and higher than that of a text which the model hasn't seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bit_mixing import CHANNELS, Code, Contexts, Counts, Model, Vocabulary, ending, read_tokens, states
from .common import give_back, keep_freed, training_fold, use_caches_of, written

HELD_OUT = 1
#: Tokens that are symbols of their own at most, and those whose counts are sent to every task at most.
VOCABULARY, MOST_SENT = 1 << 16, 1 << 20
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 21
#: Numbers of slots' counts that are summed as one row, and tokens that are scored at once.
BLOCK, BATCH = 1 << 16, 15_000
END = b"\n"  # no word holds a line feed


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def token_counts(docs: DataFrame) -> DataFrame:
    """word (binary; END for ends of documents), c: how often it stands in docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_words(text))
                counts[END] += 1
                if len(counts) > 700_000:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _level():
    """Counts by size, 64 classes for each doubling."""
    return F.floor(64 * F.log2("c")).cast("int")


def _least_level(levels: list[tuple[int, int]], most: int) -> int:
    """The lowest level from which on there are at most `most` tokens; levels: (level, tokens), falling."""
    found, total = levels[0][0] + 1 if levels else 0, 0
    for level, n in levels:
        total += n
        if total > most:
            break
        found = level
    return found


def _grouped(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with BATCH tokens or one text."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= BATCH:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def frequent(counts: DataFrame, levels: list[tuple[int, int]]) -> tuple[int, list[bytes], np.ndarray]:
    """The vocabulary's level, its tokens, the most frequent ones first, and their counts."""
    least = max(64, _least_level(levels, VOCABULARY))  # from a count of 2 on
    chosen = {r["word"]: r["c"] for r in counts.filter(_level() >= least).select("word", "c").toArrow().to_pylist()}  # at most VOCABULARY
    chosen[END] = max(1, sum(r["c"] for r in counts.filter(F.col("word") == F.lit(END)).collect()))
    words = sorted(chosen, key=lambda w: (-chosen[w], w))
    return least, words, np.array([chosen[w] for w in words], np.int64)


def train(docs: DataFrame, counts: DataFrame, least: int, words: list[bytes], own: np.ndarray, total: int, distinct: int) -> Model:
    """The model. docs (text): what is learned from; counts: its written tokens; least, words, own: those of the vocabulary."""
    context = docs.sparkSession.sparkContext

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(256)
        for batch in batches:
            if batch.num_rows:
                spelled, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                sums += np.bincount(np.frombuffer(b" ".join(spelled) + b" ", np.uint8), np.repeat(c, [len(w) + 1 for w in spelled]).astype(float), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(sums)], names=["byte", "n"])

    histogram = np.zeros(256)
    rest = counts.filter((_level() < least) & (F.col("word") != F.lit(END))).select("word", "c")
    for r in rest.mapInArrow(bytes_of, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        histogram[r["byte"]] = r["n"]
    code = Code(np.append(own, max(0, total - own.sum())), histogram)
    endings = np.array([*map(ending, words), 0])
    vocabulary = Vocabulary(words)
    slot_bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, 5 + int(math.log2(max(1, distinct)))))
    sent = context.broadcast((vocabulary, code, endings))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, code, endings = sent.value
        keep_freed()
        slots = Counts(code, endings, slot_bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [_words(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                for a, b in _grouped(texts):
                    slots.add(read_tokens(texts[a:b], vocabulary, vocabulary[END]))
        yield from blocks_of(slots)
        del slots
        give_back()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, code, endings = sent.value
        for _ in batches:  # one row
            slots = Counts(code, endings, slot_bits)
            slots.spell([w for w in vocabulary if w != END])
            yield from blocks_of(slots)

    def blocks_of(slots: Counts) -> Iterator[pa.RecordBatch]:
        blocks = slots.whole().reshape(-1, BLOCK)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            planes = blocks[k].astype("<i4").view(np.uint8).reshape(-1, 4).T  # bytes of like weight together, for the compression
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([planes.tobytes()], pa.binary())], names=["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                planes = np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1)
                own = np.ascontiguousarray(planes.T).view("<i4")[:, 0].astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([states(x[0::2], x[1::2]).tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    slots = np.zeros((CHANNELS * (2 << slot_bits) // BLOCK, BLOCK // 2), np.uint8)
    once = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(spell, schema)  # the vocabulary's own spellings
    for r in docs.select("text").mapInArrow(count, schema).unionByName(once).repartition("block").mapInArrow(add_up, schema).toLocalIterator():  # a fixed number of slots
        slots[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return Model(code, endings, slot_bits, slots.reshape(CHANNELS, -1))


_ROWS = "row long, doc_id long, held_out boolean, word binary, n_tokens long, n_bytes long, known long, base double, score double"


def base(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score as in score(), from the counts of tokens alone: what the
    model needs besides isn't made."""
    return _scores(docs, False).drop("score", "bits_per_byte")


def score(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, ...): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    A text is its words (A-Z lower-cased, cut at ASCII white space) and one end. The model learns from documents whose
    crc32(doc_id as text) mod 5 is not 1, all of their tokens. base_score is the sum over the tokens of
    log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the model's log10 probability of the same tokens, unknown ones spelled,
    bits_per_byte its bits for each byte of the words with a byte after each. A null or empty text is the end alone. A null
    doc_id is in training. Repeated rows are documents of their own; other columns are ignored. An empty table gives no rows.
    """
    return _scores(docs, True)


def _scores(docs: DataFrame, modelled: bool) -> DataFrame:
    """score(); its last two columns are null where no model is asked for."""
    context = docs.sparkSession.sparkContext
    held_out = F.coalesce(training_fold(F.col("doc_id").cast("long")) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = written(token_counts(training), "token-counts")
    sums = counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()  # 64 a doubling
    levels, total, distinct = [(r["level"], r["n"]) for r in sums], sum(r["c"] for r in sums), sum(r["n"] for r in sums)
    least, words, own = frequent(counts, levels)
    model, vocabulary = train(training, counts, least, words, own, total, distinct) if modelled else None, Vocabulary(words)
    own[words.index(END)] *= total > 0  # without a training document there is no end
    often = counts.filter(_level() >= _least_level(levels, MOST_SENT)).select("word", "c")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([xxhash.xxh64_intdigest(w) or 1 for w in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(1)], names=["hash", "c"])

    found = often.mapInArrow(hashed, "hash long, c long").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    def price(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    known_ids, prices_of = np.append(own, 1) > 0, np.append(price(own), 0.0)  # the escape's last
    sent = context.broadcast((model, vocabulary, known_ids, prices_of, hashes[order], found.column("c").to_numpy()[order]))
    del found, hashes, order

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        use_caches_of("lm_score")
        keep_freed()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                texts = [_words(t) for t in part.column(2).to_pylist()]
                for a, b in _grouped(texts):
                    yield from of_texts(part.column(0).slice(a, b - a), texts[a:b], held[a:b], row + at + np.arange(a, b))
            row += batch.num_rows
        give_back()

    def of_texts(ids: pa.Array, texts: list[list[bytes]], held: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        model, vocabulary, known_ids, prices_of, hashes, all_c = sent.value
        tokens = read_tokens(texts, vocabulary, vocabulary[END])
        n = len(texts)
        score = pa.array(-model.score(tokens, Contexts(tokens, model.endings)) * math.log10(2)) if model else pa.nulls(n, pa.float64())
        spelled = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in tokens.words), np.uint64, len(tokens.words))
        c, rare = _counts_of(spelled, hashes, all_c)
        doc = tokens.doc[tokens.where]
        prices = prices_of[tokens.ids]
        prices[tokens.where] = np.where(rare, 0, price(c))
        known = np.bincount(tokens.doc, known_ids[tokens.ids], n).astype(np.int64) - np.bincount(doc[rare | (c == 0)], minlength=n)
        sizes = np.array([sum(map(len, t)) + len(t) + 1 for t in texts], np.int64)
        base = np.bincount(tokens.doc, prices, n)
        values = [numbers, ids, held, pa.nulls(n, pa.binary()), tokens.sizes, sizes, known, base, score]
        names = [f.split()[0] for f in _ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=names)
        at = np.flatnonzero(rare)
        if len(at):
            none = lambda kind: pa.nulls(len(at), kind)
            words = pa.array([tokens.words[k] for k in at.tolist()], pa.binary())
            empty = [none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[doc[at]]), none(pa.int64()), none(pa.bool_()), words, *empty], names=names)

    parts = written(rows.mapInArrow(scored, _ROWS), "scored")
    chance = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / (F.lit(float(total)) + 0.5 * (distinct + 1)))
    rare = (
        parts.filter("word is not null").groupBy("row", "word").agg(F.count("*").alias("n")).join(counts, "word", "left")
        .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * chance).alias("more_base"))
    )
    return parts.filter("word is null").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _counts_of(own: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of tokens by their hashes, and which aren't in the table."""
    if not len(hashes):
        return np.zeros(len(own)), np.ones(len(own), bool)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return counts[at].astype(float), hashes[at] != own
