"""Phrases of two or three words whose words stand together more often than apart, by count tries.

Words are counted first. Every word has a 64-bit hash that no other word of the corpus has (it is checked; where two words met,
the corpus is counted again under another seed), so a phrase's path is one number for each word. Then each level of the trie is
counted: a task's trie of limited depth holds packed paths and counts, and only paths whose shorter paths can be frequent, which
filters of a fixed size tell (what they let through by mistake is counted and then found rare, so nothing is lost). A trie that
has grown to its limit, or is at its end, is serialised in the order of its paths, cut at ranges of the prefix; ranges of all
tries are merged, and counts of equal paths summed, keeping what is frequent.

A path's parents give the counts of left parts, its suffix links (the path without its first words) those of right parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LANGUAGE = "und"
#: Bits of a filter (8 MB, whatever the corpus), and bits that travel as one block.
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 16


@dataclass(frozen=True)
class Limits:
    """What a task holds: bytes of a text and words that it takes at once, paths in its trie, words that it numbers (2^20 at
    most, for a packed path of three) and others that it remembers."""

    slice: int = 1 << 21
    words: int = 1 << 21
    paths: int = 3_000_000
    numbers: int = 1 << 20
    known: int = 1 << 20


LIMITS = Limits()
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", b"." * 10)
_ODD, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """A text in slices that end where a word does."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b" \t.":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _tokens(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words, and b"." where a piece ends, of a text's slices."""
    for part in _slices(text.translate(_BREAKS), size):
        yield part.lower().replace(b".", b" . ").split()  # bytes: A-Z and ASCII white space only


def _prefix(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A hash of a path's first two words; no range of it is a hot word's."""
    mixed = (one * _ODD + (two ^ (two >> np.uint64(29)))) * _SPREAD
    return mixed ^ (mixed >> np.uint64(32))


def word_counts(docs: DataFrame, seed: int, limits: Limits = LIMITS) -> DataFrame:
    """lang, word (binary), hash, n: how often each word stands in docs (lang, text: binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(b".", None)
                salt = _salt(lang, seed)
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in own), np.uint64, len(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(hashes), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "hash", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts.setdefault(lang, Counter())
                for words in _tokens(text.as_py(), limits.slice):
                    own.update(words)
                if sum(map(len, counts.values())) > limits.known:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(count, "lang string, word binary, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _salt(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def _position(hashes: Column) -> Column:
    return F.pmod(hashes, F.lit(FILTER_BITS))


def _filter(hashes: DataFrame) -> np.ndarray:
    """uint8[FILTER_BITS / 8] with a bit set for each hash (hash: long); always of this size."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(own).tolist():
                blocks.setdefault(k, np.zeros(BLOCK_BITS, bool))[at[own == k]] = True
        for k, bits in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    at = _position(F.col("hash"))
    rows = hashes.select(F.floor(at / BLOCK_BITS).cast("long").alias("block"), F.pmod(at, F.lit(BLOCK_BITS)).cast("long").alias("at")).distinct().repartition("block")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = BLOCK_BITS // 8
    for r in rows.mapInArrow(gather, "block long, bits binary").toLocalIterator():  # FILTER_BITS bits in all
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Numbers(dict):
    """A task's numbers of the words of a language that can be frequent; -1 for others and for the ends of pieces."""

    def __init__(self, salt: int, frequent: np.ndarray, hashes: list[int], known: int):
        super().__init__({b".": -1})
        self.salt, self.frequent, self.hashes, self.known = salt, frequent, hashes, known

    def __missing__(self, word: bytes) -> int:
        if len(self) - len(self.hashes) > self.known:
            for other in [w for w, n in self.items() if n < 0 and w != b"."]:
                del self[other]
        h = xxhash.xxh64_intdigest(word, self.salt)
        at = h & (FILTER_BITS - 1)
        n = -1
        if self.frequent[at >> 3] >> (at & 7) & 1:
            n = len(self.hashes)
            self.hashes.append(h)
        self[word] = n
        return n


class Trie:
    """Counts of the paths of one depth, 2 or 3: sorted packed paths of word numbers, and counts."""

    def __init__(self, depth: int):
        self.depth, self.bits = depth, np.uint64(63 // depth)
        self.paths, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, paths: np.ndarray) -> None:
        own, counts = np.unique(paths, return_counts=True)
        if not len(self.paths):
            self.paths, self.counts = own, counts
            return
        both = np.concatenate([self.paths, own])
        order = np.argsort(both, kind="stable")  # two sorted runs
        both, all_counts = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        self.paths, self.counts = both[first], np.add.reduceat(all_counts, first)

    def words(self) -> list[np.ndarray]:
        low = (np.uint64(1) << self.bits) - np.uint64(1)
        return [((self.paths >> (self.bits * np.uint64(k))) & low).astype(np.intp) for k in reversed(range(self.depth))]


def _serialised(columns: list[np.ndarray], counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows (range, nodes) of paths (a hash for each word): a range's paths in order, the words before the last only where they
    change."""
    part = (_prefix(*columns[:2]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    order = np.lexsort([*reversed(columns), part])
    part, counts, columns = part[order], counts[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.intp)
    nodes = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        own = [c[a:b] for c in columns]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in own[:-1]], axis=0))  # another parent
        parents = np.flatnonzero(new)
        head = np.array([b - a, len(parents)], "<u4").tobytes()
        nodes.append(b"".join([head, *(c[parents].tobytes() for c in own[:-1]), parents.astype("<u4").tobytes(), own[-1].tobytes(), counts[a:b].astype("<u4").tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int64)), pa.array(nodes, pa.binary())], names=["range", "nodes"])


def _read(data: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, parents = np.frombuffer(data, "<u4", 2).tolist()
    at, columns = 8, []
    for _ in range(depth - 1):
        columns.append(np.frombuffer(data, np.uint64, parents, at))
        at += 8 * parents
    begins = np.frombuffer(data, "<u4", parents, at)
    at += 4 * parents
    times = np.diff(np.append(begins, n))
    columns = [np.repeat(c, times) for c in columns]
    columns.append(np.frombuffer(data, np.uint64, n, at))
    return columns, np.frombuffer(data, "<u4", n, at + 8 * n).astype(np.int64)


def _merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted runs, one after the other, as one, with the counts of equal paths summed."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[first] for c in columns], np.add.reduceat(counts, first)


def frequent_paths(docs: DataFrame, depth: int, least: int, words: np.ndarray, parents: np.ndarray | None, seed: int, limits: Limits = LIMITS) -> DataFrame:
    """h1, h2, ... (depth hashes), n, prefix for the phrases of `depth` words that stand in docs (lang, text: binary) at least
    `least` times. words: the filter of frequent words; parents: that of frequent pairs, for depth 3."""
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast((words, parents))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pairs = sent.value
        hashes: list[int] = []
        numbers: dict[str, _Numbers] = {}
        streams: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        trie = Trie(depth)

        def take(lang: str) -> None:
            ids = np.concatenate(streams[lang])
            streams[lang] = [ids[max(0, len(ids) - depth + 1) :]]  # phrases that begin there go on with what comes
            sizes[lang] = 0
            own = [ids[k : len(ids) - depth + 1 + k] for k in range(depth)]
            at = np.flatnonzero(np.all([x >= 0 for x in own], axis=0)) if len(ids) >= depth else np.empty(0, np.intp)
            own = [x[at] for x in own]
            if depth > 2 and len(at):
                table = np.array(hashes, np.uint64)
                known = [table[x] for x in own]
                at = np.flatnonzero(_passes(pairs, _prefix(known[0], known[1])) & _passes(pairs, _prefix(known[1], known[2])))
                own = [x[at] for x in own]
            path = np.zeros(len(at), np.uint64)
            for x in own:
                path = (path << trie.bits) | x.astype(np.uint64)
            trie.add(path)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in streams:
                take(lang)
            table = np.array(hashes, np.uint64)
            if len(trie.counts):
                yield _serialised([table[x] for x in trie.words()], trie.counts, ranges)
            trie.__init__(depth)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in numbers:
                    numbers[lang], streams[lang], sizes[lang] = _Numbers(_salt(lang, seed), frequent, hashes, limits.known), [], 0
                own = numbers[lang]
                for part in _tokens(text.as_py(), limits.slice):
                    streams[lang].append(np.fromiter(map(own.__getitem__, part), np.int64, len(part)))
                    sizes[lang] += len(part)
                    if sizes[lang] > limits.words or len(hashes) > limits.numbers:
                        take(lang)
                    if len(trie.counts) > limits.paths or len(hashes) > limits.numbers:
                        yield from flush()
                        if len(hashes) > limits.numbers:  # numbers begin anew, with what the open phrases need
                            table, old = np.array(hashes, np.uint64), {k: np.concatenate(v) for k, v in streams.items()}
                            kept = np.unique(np.concatenate(list(old.values())))
                            kept = kept[kept >= 0]
                            hashes[:] = table[kept].tolist()
                            streams.update({k: [np.where(x >= 0, np.searchsorted(kept, x), -1)] for k, x in old.items()})
                            for other in numbers.values():
                                other.clear()
                                other[b"."] = -1
                streams[lang].append(np.array([-1]))
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = [np.empty(0, np.uint64)] * depth, np.empty(0, np.int64)
        waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def together() -> tuple[list[np.ndarray], np.ndarray]:
            runs = [(columns, counts), *waiting]
            return _merged([np.concatenate([r[0][k] for r in runs]) for k in range(depth)], np.concatenate([r[1] for r in runs]))

        for batch in batches:
            for nodes in batch.column(1).to_pylist():
                waiting.append(_read(nodes, depth))
                size += len(waiting[-1][1])
                if size > max(limits.paths, len(counts)):
                    (columns, counts), waiting, size = together(), [], 0
        columns, counts = together()
        keep = counts >= least
        own = [c[keep] for c in columns]
        arrays = [*(c.view(np.int64) for c in own), counts[keep], _prefix(own[0], own[1]).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[*names, "n", "prefix"])

    names = [f"h{k + 1}" for k in range(depth)]
    tries = docs.mapInArrow(count, "range long, nodes binary")
    return tries.repartition("range").mapInArrow(merge, ", ".join(f"{c} long" for c in [*names, "n", "prefix"]))


def _counted(docs: DataFrame, limits: Limits) -> tuple[DataFrame, int]:
    """The words with hashes that tell them apart, and the seed that does."""
    seed = 0
    while True:
        words = written(word_counts(docs, seed, limits), "words")
        if words.groupBy("hash").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    big = lambda x: x.cast("decimal(19,0)")
    product = lambda x, y: (big(x) * big(y)).cast("decimal(38,0)")
    return F.call_function("div", (product(a, a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), product(left, right))


def candidates(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, limits: Limits = LIMITS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one covers; see mine()."""
    if longest not in (2, 3):
        raise ValueError("phrases have two words, or two and three")
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words, seed = _counted(own, limits)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= least)
    words_filter = _filter(often.select("hash"))
    pairs = written(frequent_paths(own, 2, least, words_filter, None, seed, limits), "pairs")

    def word(k: int) -> DataFrame:
        shown = [F.col("lang")] if k == 1 else []
        return often.select(*shown, F.col("hash").alias(f"h{k}"), F.col("word").cast("string").alias(f"w{k}"), F.col("n").alias(f"n{k}"))

    named = pairs.join(word(1), "h1").join(word(2), "h2")
    found = named.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), _score(F.col("n"), F.col("n1"), F.col("n2")).alias("score"), "h1", "h2")
    if longest == 3:
        triples = written(frequent_paths(own, 3, least, words_filter, _filter(pairs.select(F.col("prefix").alias("hash"))), seed, limits), "triples")
        parent = pairs.select("h1", "h2", F.col("n").alias("n12"))
        suffix = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("n23"))
        whole = triples.drop("prefix").join(parent, ["h1", "h2"]).join(suffix, ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
        cut = lambda k, left, right: F.struct(_score(F.col("n"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        best = F.least(cut(1, "n1", "n23"), cut(2, "n12", "n3"))
        longer = whole.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), best.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        each = F.explode(F.array(F.struct(F.col("h1").alias("x"), F.col("h2").alias("y")), F.struct(F.col("h2").alias("x"), F.col("h3").alias("y"))))
        cover = triples.select(each.alias("p"), "n").groupBy(F.col("p.x").alias("h1"), F.col("p.y").alias("h2")).agg(F.max("n").alias("cover"))
        found = found.join(cover, ["h1", "h2"], "left").filter(F.col("cover").isNull() | (100 * F.col("cover") < share * F.col("a"))).drop("cover", "h1", "h2").unionByName(longer)
    else:
        found = found.drop("h1", "h2")
    return found.join(totals, "lang").withColumnRenamed("total", "n")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, limits: Limits = LIMITS) -> DataFrame:
    """The first `top` phrases of each language of docs (lang, text, ...): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at `[.,;:!?]` and line ends into pieces, those at spaces and tabs into words. A null
    lang is "und", a null text empty. n counts all words of the language, a the phrase's occurrences within pieces. A candidate
    has 2 to `longest` words and a >= least. Of its cuts in two the one with the lowest floor(1000000 * a * a / (l * r)) counts,
    the first of ties; l and r are the counts of its parts. Candidates inside a longer one with 100 * its count >= share * a
    go. Rows are ordered by score and a (falling) and phrase (bytes). Repeated rows count again; other columns are ignored. An
    empty table, or one without such phrases, gives no rows.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = candidates(docs, longest, least, share, limits).repartitionByRange("lang", *order)
    placed = written(found.withColumn("_part", F.spark_partition_id()), "phrases")  # a language may fill many ranges
    local = Window.partitionBy("lang", "_part").orderBy(*order)
    first = placed.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= top)
    base = placed.groupBy("lang", "_part").agg(F.count("*").alias("_c"))
    base = base.withColumn("_base", F.sum("_c").over(Window.partitionBy("lang").orderBy("_part")) - F.col("_c")).filter(F.col("_base") < top)
    rank = F.col("_n") + F.col("_base")
    return first.join(F.broadcast(base.drop("_c")), ["lang", "_part"]).select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score").filter(F.col("rank") <= top)
