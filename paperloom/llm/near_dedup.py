"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set of word shingles gets a signature of chunks * width symbols of 16 bits. The distance of two signatures is the
number of places where they differ. If it is below 2 * chunks, some chunk differs in at most one place (pigeonhole), so the
two share a key made of a chunk without one of its symbols: each chunk gives `width` keys, one for each place where the one
allowed error may be, and a join on keys meets every pair within the distance. The split into chunks is made for the least
similarity that links: 10 of 5 symbols for 0.85, 12 of 4 for 0.80. At a similarity of 0.85 a pair goes beyond the first's
distance about 16 times in a million, at 0.80 beyond the second's 3 times.

Documents with equal sets are one class from the start, so exact copies never meet as pairs. In each bucket of a key every
member is first compared with the smallest one only; links are confirmed on whole sets, and linked classes become components.
Then only pairs whose members are still in different components are looked at, each in the first bucket that its members
share, so that a large group of near copies never emits its pairs, and no link that joins two components is missed. Before
their sets are fetched, pairs are compared by sketches: one shingle from each of BINS ranges of hashes, nearly the whole set of
a short document, from which the similarity is known to within a few hundredths; pairs five deviations short of a link go.

A bucket of more than BLOCK members in several components is what a template makes: documents that share most of their words, too
few for a link, so that their signatures are near and all of their pairs would be compared. Its members meet on single shingles
instead: two sets that are to be linked share one of the rarest shingles of either, as many as a link lets them differ by, and what
only the template holds is common and no key. Only where even such a shingle has more members than a task takes, blocks of them
are dealt out in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, use_caches_of, written
from .components import components

SHINGLE = 5
CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
BINS = 512


@dataclass(frozen=True)
class Split:
    """How a signature is cut into chunks, and the percentage of similarity that it is made for."""

    percent: int
    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


SPLIT_85 = Split(85, CHUNKS, WIDTH)
SPLIT_80 = Split(80, 12, 4)


def split_for(percent: int) -> Split:
    """The split for links from `percent` on; the one for 85 serves any higher percentage."""
    if percent < SPLIT_80.percent:
        raise ValueError("the signatures' distances are made for 80 percent and more")
    return SPLIT_85 if percent >= SPLIT_85.percent else SPLIT_80


#: Ids that are broadcast at most, to find the texts of candidates; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Members of a bucket that one task compares at most; larger ones meet on rarer keys. What stands for a key of any way.
BLOCK, ANY_WAY = 4_000, -1

_random = np.random.default_rng(20_240_229)
_WEIGHTS = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64)
_FACTORS = _random.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _random.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of 5 words; with fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return (hashes * _WEIGHTS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _SALTS[len(words) : len(words) + 1]
    out = hashes[: len(words) - SHINGLE + 1] * _WEIGHTS[0]
    for k in range(1, SHINGLE):
        out += hashes[k : len(words) - SHINGLE + 1 + k] * _WEIGHTS[k]
    return np.unique(out)


def _signatures(sets: list[np.ndarray], split: Split) -> np.ndarray:
    """uint16[documents, symbols] of non-empty sets."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), split.symbols), np.uint16)
    for k in range(split.symbols):
        least = np.minimum.reduceat(joined * _FACTORS[k] + _ADDENDS[k], starts)
        out[:, k] = (least * _ODD) >> np.uint64(48)
    return out


def _sketch(shingle_set: np.ndarray) -> np.ndarray:
    """uint8[BINS]: a code of the least hash in each of BINS ranges, 0 where there is none."""
    starts = np.searchsorted(shingle_set, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 9))
    ends = np.append(starts[1:], len(shingle_set))
    least = shingle_set[np.minimum(starts, len(shingle_set) - 1)]
    return np.where(ends > starts, ((least * _ODD) >> np.uint64(56)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def _may_link(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, split: Split) -> np.ndarray:
    """Whether pairs of sketches (rows; sizes: of both sets together) leave the split's similarity possible."""
    least = split.percent / 100
    same = ((one == two) & (one > 0)).sum(1)
    filled = np.maximum(((one > 0) | (two > 0)).sum(1), 1)
    left_out = np.maximum(0, 1 - filled / np.maximum(sizes / (1 + least), 1))  # share of the union that the sketches don't hold
    return same >= filled * (least - 5 * np.sqrt(least * (1 - least) * left_out / filled)) - 2


def signed(docs: DataFrame, split: Split = SPLIT_85) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a fingerprint of the set), signature and sketch in one binary (null for an empty
    set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches_of("hashes")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                prints = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
                full = [k for k, x in enumerate(sets) if len(x)]
                own: list[bytes | None] = [None] * len(sets)
                group: list[int] = []
                size = 0
                for k in [*full, None]:
                    if k is None or size > 200_000:
                        if group:
                            for j, row in zip(group, _signatures([sets[j] for j in group], split)):
                                own[j] = row.tobytes() + _sketch(sets[j]).tobytes()
                        group, size = [], 0
                    if k is not None:
                        group.append(k)
                        size += len(sets[k])
                halves = [np.array([(x >> shift) & (2**64 - 1) for x in prints], np.uint64).view(np.int64) for shift in (64, 0)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(halves[0]), pa.array(halves[1]), pa.array(own, pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, schema)


def _matrix(column: pa.Array, split: Split) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, uint16[rows, symbols], and sketches, uint8[rows, BINS]."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * split.symbols + BINS)
    return np.ascontiguousarray(both[:, : 2 * split.symbols]).view(np.uint16), both[:, 2 * split.symbols :]


def keys_of(classes: DataFrame, split: Split = SPLIT_85) -> DataFrame:
    """key, member, way (the key's number among the chunks * width of each): rows for each class (member, signature)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members, signs = batch.column(0).to_numpy(), _matrix(batch.column(1), split)[0].astype(np.uint64)
            out = []
            for chunk in range(split.chunks):
                for gap in range(split.width):
                    key = np.zeros(len(signs), np.uint64)
                    for k in range(split.width):
                        if k != gap:
                            key = (key << np.uint64(16)) | signs[:, chunk * split.width + k]
                    key = (key ^ np.uint64((chunk * split.width + gap) * 0x1000003)) * _ODD
                    out.append((key ^ (key >> np.uint64(29))).view(np.int64))
            ways = np.repeat(np.arange(len(out), dtype=np.int8), len(members))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(members, len(out))), pa.array(ways)], names=["key", "member", "way"])

    return classes.select("member", "signature").mapInArrow(keys, "key long, member long, way byte")


def _within(pairs: DataFrame, classes: DataFrame, split: Split) -> DataFrame:
    """Pairs (a, b) whose sizes, signatures and sketches allow a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                (sign_a, sketch_a), (sign_b, sketch_b) = _matrix(part.column(2), split), _matrix(part.column(3), split)
                keep = pa.array(((sign_a != sign_b).sum(1) <= split.distance) & _may_link(sketch_a, sketch_b, part.column(4).to_numpy(), split))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    one = classes.select(F.col("member").alias("a"), F.col("signature").alias("sign_a"), F.col("n_shingles").alias("n_a"))
    two = classes.select(F.col("member").alias("b"), F.col("signature").alias("sign_b"), F.col("n_shingles").alias("n_b"))
    joined = pairs.join(one, "a").join(two, "b").filter(f"100 * least(n_a, n_b) >= {split.percent} * greatest(n_a, n_b)")
    return joined.select("a", "b", "sign_a", "sign_b", F.expr("n_a + n_b")).mapInArrow(near, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on the whole sets of shingles, as a written table."""
    pairs = written(pairs, "candidates")
    n_pairs = pairs.count()
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids", 2 * n_pairs)
    few = ids.count() <= MOST_BROADCAST
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(_sets(texts), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("shingles_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("shingles_b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("shingles_a") + F.size("shingles_b")).alias("all"))
    return written(joined.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"), "confirmed", n_pairs)


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, shingles (array<long>) of texts (doc_id, text)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches_of("hashes")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "shingles"])

    return texts.mapInArrow(sets_of, "doc_id long, shingles array<long>")


def _rare_keys(members: DataFrame, docs: DataFrame, split: Split) -> DataFrame:
    """key, member: the rarest shingles of each member (member, ...), one more than a link lets it lack, if others have them. Two
    sets of a similarity of split.percent share one of them: if they share none, the rarest of those that they share comes after
    all of the keys of one of the two, which then lacks too many."""
    ids = written(members.select(F.col("member").alias("doc_id")).distinct(), "large-ids")
    few = ids.count() <= MOST_BROADCAST
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(_sets(texts), "large-sets").select(F.col("doc_id").alias("member"), F.size("shingles").alias("size"), F.xxhash64("shingles").alias("print"), F.explode("shingles").alias("key"))
    counts = sets.groupBy("key").agg(F.count("*").alias("n"))  # summed map-side
    ranked = sets.join(counts, "key").groupBy("member", "size", "print").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("keys"))  # a document's own shingles
    first = F.slice("keys", 1, F.col("size") - F.ceil(split.percent * F.col("size") / 100).cast("int") + 1)
    return ranked.select("member", F.explode(first).alias("k")).filter("k.n > 1").select("k.key", "member").distinct()


def _across(buckets: DataFrame, classes: DataFrame, docs: DataFrame, split: Split) -> DataFrame:
    """Pairs (a, b) of a bucket (key, member, way, component) that are in different components and may be linked."""
    counts = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = written(counts.filter("low != high").select("key", "n"), "mixed-keys")
    found = _compared(buckets, mixed.filter(F.col("n") <= BLOCK), classes, split)
    large = mixed.filter(F.col("n") > BLOCK).select("key")
    if large.isEmpty():
        return found
    members = written(buckets.join(large, "key").select("member", "component").distinct(), "large-members")
    rare = written(_rare_keys(members, docs, split).join(members, "member").select("key", "member", F.lit(ANY_WAY).cast("byte").alias("way"), "component"), "rare-keys")
    counts = rare.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return found.unionByName(_compared(rare, counts.filter("low != high").select("key", "n"), classes, split)).distinct()


def _compared(buckets: DataFrame, mixed: DataFrame, classes: DataFrame, split: Split) -> DataFrame:
    """Pairs of the buckets mixed (key, n), each pair in the first bucket that its members share, or, where way is ANY_WAY, in all."""
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        buckets.join(mixed, "key")
        .withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # one row unless the bucket is cut
        .select("key", "member", "way", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(classes.select("member", "signature", "n_shingles"), "member")
    )
    task = F.xxhash64("key", "low", "high")
    ordered = dealt.select(task.alias("task"), "member", "component", "block", (F.col("low") != F.col("high")).alias("apart"), "n_shingles", "signature", "way")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            tasks = table.column(0).to_numpy()
            last = int(np.searchsorted(tasks, tasks[-1]))  # the last task's rows may go on in the next batch
            rest = table.slice(last)
            if last:
                yield _pairs_of(table.slice(0, last), split)
        if rest is not None and rest.num_rows:
            yield _pairs_of(rest, split)

    sorted_ = ordered.repartition("task").sortWithinPartitions("task")
    return sorted_.mapInArrow(pairs, "a long, b long")


def _pairs_of(table: pa.Table, split: Split) -> pa.RecordBatch:
    table = table.combine_chunks()
    task, member, component, block = (table.column(k).to_numpy() for k in range(4))
    apart, size, way = table.column(4).to_numpy(zero_copy_only=False), table.column(5).to_numpy(), table.column(7).to_numpy()
    signs, sketches = _matrix(table.column(6), split)
    found_a, found_b, step = [], [], 1
    at = np.arange(len(task))
    while True:
        at = at[at + step < len(task)]
        at = at[task[at] == task[at + step]]
        if not len(at):
            break
        to = at + step
        ok = (component[at] != component[to]) & (100 * np.minimum(size[at], size[to]) >= split.percent * np.maximum(size[at], size[to]))
        ok &= ~apart[at] | (block[at] != block[to])
        x, y = at[ok], to[ok]
        for k in range(0, len(x), 20_000):
            i, j = x[k : k + 20_000], y[k : k + 20_000]
            differ = (signs[i] != signs[j]).reshape(-1, split.chunks, split.width)
            errors = differ.sum(2)
            chunk = (errors <= 1).argmax(1)  # the first chunk that makes a key of both, and there the first such key
            first = chunk * split.width + differ[np.arange(len(i)), chunk].argmax(1)
            near = (errors.sum(1) <= split.distance) & ((first == way[i]) | (way[i] == ANY_WAY))
            i, j = i[near], j[near]
            near = _may_link(sketches[i], sketches[j], size[i] + size[j], split)
            found_a.append(np.minimum(member[i[near]], member[j[near]]))
            found_b.append(np.maximum(member[i[near]], member[j[near]]))
        step += 1
    ends = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), words are cut at ASCII white space, and a document is its set of distinct shingles of 5
    words; one with fewer words is one shingle, one without words (also null) an empty set that is linked with nothing. Two
    are linked if 100 * intersection >= percent * union, percent being 80 or more; component_id is the smallest doc_id that
    can be reached. Rows that share a doc_id stand for one document and get one result each. A null doc_id is linked with
    nothing and kept. Other columns are ignored. An empty table gives no rows.
    """
    split = split_for(percent)
    signs = written(signed(docs, split), "signatures")
    classes = written(
        signs.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("member"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "classes",
    )
    ends = keys_of(classes, split).groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high"))  # summed map-side
    shared = written(ends.filter("low != high").select("key", "low"), "shared-keys")
    buckets = written(keys_of(classes, split).join(shared, "key").select("key", "member", "way", "low"), "buckets")
    stars = buckets.filter("member != low").select(F.col("low").alias("a"), F.col("member").alias("b")).distinct()
    links = confirmed(_within(stars, classes, split), docs, percent)
    first = written(components(links), "components", 2 * links.count())
    known = buckets.join(first.select(F.col("node").alias("member"), "component"), "member", "left")
    known = known.select("key", "member", "way", F.coalesce("component", "member").alias("component"))
    more = confirmed(_across(known, classes, docs, split), docs, percent)
    found = components(links.unionByName(more))
    named = classes.join(found.select(F.col("node").alias("member"), "component"), "member", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "member").alias("component_id"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return signs.join(named, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without those that are linked, however indirectly, to one with a smaller doc_id; all columns stay."""
    gone = written(deduplicate(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "duplicates")
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
