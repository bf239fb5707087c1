"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Texts and items are sequences of words (lower-cased, ASCII punctuation dropped). An item of n words is found in a text if some
stretch of the text is within an edit distance of RATIO * n words. Such a stretch shares a run of GRAM words with the item
(each edit breaks GRAM runs at most, and n - GRAM + 1 of them are more than that for every n that allows an edit), so windows
of the item's size are laid where a run is shared, at the run's offset. Each window and each item is embedded by the CGK
random walk: a pointer walks over the words, writes the one it stands on, and steps on or stays by a random bit of the word
and the time; sequences at a small edit distance get embeddings at a small Hamming distance. REPEATS walks of TABLES samples
of SAMPLE places each make the keys; at a Hamming distance of half of all places a pair still shares a key with a chance over
0.98, and the passages that are wanted are nearer. Pairs that share a key are confirmed by their exact edit distance.

Items are sent to the tasks in blocks of a bounded size, one pass over the texts for each block; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, use_caches_of

RATIO = 0.2
GRAM = 3
REPEATS, TABLES, SAMPLE = 4, 8, 2
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 8_000_000
_MAP_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def hashed_words(text: str | None) -> np.ndarray:
    words = (text or "").encode().translate(_LOWER).split()
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _MORE + words[k : k + n]
    out *= _ODD
    return out ^ (out >> np.uint64(32))


def allowed(n: int, ratio: float = RATIO) -> int:
    """Edits that an item of n words may have: none where a shared run would not be certain."""
    edits = int(ratio * n + 1e-9)
    while edits and n - GRAM + 1 <= GRAM * edits:
        edits -= 1
    return edits


def embed(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK walks over rows of word hashes (0 past their end): uint64[rows, 3 * columns]."""
    random = np.random.default_rng(seed)
    count, width = rows.shape
    factors = random.integers(1, 2**63, 3 * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.concatenate([rows, np.zeros((count, 1), np.uint64)], 1)
    at, every = np.zeros(count, np.int64), np.arange(count)
    out = np.empty((count, 3 * width), np.uint64)
    for j, factor in enumerate(factors):
        out[:, j] = padded[every, at]
        step = (((out[:, j] + np.uint64(j)) * factor) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + step, width)
    return out


def keys(rows: np.ndarray, seed: int) -> np.ndarray:
    """uint64[rows, REPEATS * TABLES]: keys of windows or items that have all the same number of words."""
    width, out = rows.shape[1], []
    for repeat in range(REPEATS):
        walked = embed(rows, seed + repeat)
        random = np.random.default_rng([seed, repeat, width])
        for table in range(TABLES):
            key = np.full(len(rows), repeat * TABLES + table, np.uint64)
            for place in random.choice(2 * width, SAMPLE, replace=2 * width < SAMPLE):  # the walk ends at about 2 * width
                key = (key ^ walked[:, place]) * _MORE
                key ^= key >> np.uint64(31)
            out.append(key)
    return np.stack(out, 1)


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance, in words, of the item to any stretch of the text."""
    before = np.zeros(len(text) + 1, np.int64)
    places = np.arange(len(text) + 1)
    for k, word in enumerate(item.tolist(), 1):
        now = np.empty_like(before)
        now[0] = k
        now[1:] = np.minimum(before[1:] + 1, before[:-1] + (text != word))
        before = np.minimum.accumulate(now - places) + places  # insertions
    return int(before.min())


class Items:
    """A block of the benchmark, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str | None]], ratio: float = RATIO, seed: int = 11):
        self.ids, self.words, self.seed, self.ratio = [], [], seed, ratio
        for item_id, text in rows:
            words = hashed_words(text)
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        self.grams, self.keys = {}, {}
        for size in self.sizes:
            own = [(g, k, at) for k, w in enumerate(self.words) if min(GRAM, len(w)) == size for at, g in enumerate(_grams(w, size))]
            hashes = np.array([g for g, _, _ in own], np.uint64)
            order = np.argsort(hashes, kind="stable")
            there = np.zeros(1 << _MAP_BITS, bool)
            there[hashes >> np.uint64(64 - _MAP_BITS)] = True
            self.grams[size] = (there, hashes[order], np.array([k for _, k, _ in own])[order], np.array([at for _, _, at in own])[order])
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        for n in sorted(set(self.lengths.tolist())):
            items = np.flatnonzero(self.lengths == n)
            found = keys(np.stack([self.words[k] for k in items]), seed)
            flat, owner = found.T.ravel(), np.tile(items, found.shape[1])
            order = np.argsort(flat, kind="stable")
            self.keys[n] = (flat[order], owner[order])

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start of its window) wherever the text shares a run of words with an item."""
        items, starts = [], []
        for size in self.sizes:
            there, hashes, owner, offset = self.grams[size]
            own = _grams(words, size)
            at = np.flatnonzero(there[own >> np.uint64(64 - _MAP_BITS)])
            low, high = (np.searchsorted(hashes, own[at], side) for side in ("left", "right"))
            n = high - low
            if n.sum():
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                items.append(owner[k])
                starts.append(np.repeat(at, n) - offset[k])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)]), axis=1)
        return pairs[0], pairs[1]

    def find(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item): (edit distance, start of the best window)."""
        text_of, item_of, start_of = [], [], []
        for k, words in enumerate(texts):
            items, starts = self.anchors(words)
            text_of.append(np.full(len(items), k))
            item_of.append(items)
            start_of.append(starts)
        text_of, item_of, start_of = map(np.concatenate, (text_of, item_of, start_of))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        sizes = self.lengths[item_of] if len(item_of) else np.empty(0, np.int64)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            places = np.unique(np.stack([text_of[own], start_of[own]]), axis=1)
            for k in range(0, places.shape[1], 20_000):
                self._windows(texts, n, places[:, k : k + 20_000], out)
        return out

    def _windows(self, texts: list[np.ndarray], n: int, places: np.ndarray, out: dict) -> None:
        rows = np.zeros((places.shape[1], n), np.uint64)
        for k, (text, start) in enumerate(places.T.tolist()):
            window = texts[text][max(0, start) : max(0, start + n)]
            rows[k, : len(window)] = window
        flat, owner = self.keys[n]
        found = keys(rows, self.seed)
        pairs = set()
        low, high = (np.searchsorted(flat, found.ravel(), side) for side in ("left", "right"))
        for hit in np.flatnonzero(high > low):
            for k in range(low[hit], high[hit]):
                pairs.add((int(hit) // found.shape[1], int(owner[k])))
        most = allowed(n, self.ratio)
        for row, item in sorted(pairs):
            text, start = places[:, row].tolist()
            known = out.get((text, item))
            if known and known[0] == 0:
                continue
            stretch = texts[text][max(0, start - 2 * most) : max(0, start + n + 2 * most)]
            if np.isin(self.words[item], stretch).sum() < n - most:  # each missing word is an edit
                continue
            distance = edit_distance(self.words[item], stretch)
            if distance <= most and (known is None or (distance, start) < known):
                out[text, item] = (distance, max(0, start))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), at most about BLOCK_BYTES of text at a time; the driver holds one block."""
    rows = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(count):
        yield sorted((r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect())


def _found(batch: pa.RecordBatch, column: int, items: Items) -> Iterator[tuple[int, int, int, int]]:
    texts: list[np.ndarray] = []
    at = size = 0
    for k, text in enumerate(batch.column(column)):
        texts.append(hashed_words(text.as_py()))
        size += len(texts[-1])
        if size > 2_000_000 or k + 1 == batch.num_rows:
            for (row, item), (distance, start) in sorted(items.find(texts).items()):
                yield at + row, item, distance, start
            texts, at, size = [], k + 1, 0


def matches(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """One row for each document (doc_id, text, ...) and item (item_id, text, ...) that is found in it: doc_id, item_id,
    distance (edits, in words), item_words, start_word (about where).

    Null or empty texts and items are found nowhere and have nothing. Rows that repeat give rows that repeat, items that
    repeat count once for each item_id. An empty table on either side gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, distance long, item_words long, start_word long"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, ratio))  # BLOCK_BYTES of text at most

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            use_caches_of("hashes")
            items = sent.value
            for batch in batches:
                best: dict[tuple[int, int], tuple[int, int, int]] = {}  # an id that has several texts counts once, the nearest
                for row, k, distance, start in _found(batch, 1, items):
                    own = (distance, len(items.words[k]), start)
                    best[row, items.ids[k]] = min(own, best.get((row, items.ids[k]), own))
                found = [(batch.column(0)[row].as_py(), item, *own) for (row, item), own in sorted(best.items())]
                columns = zip(*found) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "item_id", "distance", "item_words", "start_word"])

        part = rows.mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    column = docs.columns.index("text")
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, ratio))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            use_caches_of("hashes")
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, *_ in _found(batch, column, sent.value)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
