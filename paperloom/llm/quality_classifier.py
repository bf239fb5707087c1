"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1, the unlabelled ones any documents; no document is taken as negative. The
share of positives among the unlabelled (the class prior) is estimated by the lowest ratio, over thresholds of a first
classifier, of the unlabelled to the positive documents above the threshold. Then a linear model minimises the non-negative
unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), with the logistic loss; where a batch's second part falls
below zero, its gradient is taken backwards. The model's features are means over a document's words (hashed words, hashed
pairs, word shapes) and a few ratios of the whole text; only the text is read.

Fitting takes at most MOST_POSITIVE and MOST_UNLABELLED documents, those with the smallest hashes of doc_id, so its cost does
not grow with the corpus. Every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_cache, training_fold, use_caches_of

#: Bounds of the sample that the classifier is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 5_000, 7_500
HELD_OUT = 0
THRESHOLD = 0.3

_WORDS, _PAIRS, _SHAPES = 4096, 4096, 256
_RATIOS = 9
SIZE = _WORDS + _PAIRS + _SHAPES + _RATIOS
#: What a whole text's hashed features, and each of its ratios, weigh.
_SCALE = 6.0
_SHAPE_OF = (
    (re.compile(rb"[0-9]+"), b"0"),
    (re.compile(rb"[A-Z]+"), b"A"),
    (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
    (re.compile(rb"([^A-Za-z0\x80-\xff])\1+"), rb"\1+"),
)
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>!@^_~={}[]\\/", bytes(range(65, 91)), bytes(range(48, 58))


class _Codes(dict):
    """A word's bucket and shape in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = word
        for pattern, by in _SHAPE_OF:
            shape = pattern.sub(by, shape)
        got = self[word] = (xxhash.xxh32_intdigest(shape) % _SHAPES) << 12 | xxhash.xxh32_intdigest(word) % _WORDS
        return got


_CODES = _Codes()
keep_cache("codes", _CODES.clear)


def features(text: str | None) -> tuple[np.ndarray, float, np.ndarray]:
    """Indices of a text's hashed features (repeated as they occur), the weight of each, and its ratios."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), 0.0, np.array([0, 0, 0, 0, 0, 0, 0, 0, 1.0])
    codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, n)
    buckets, shapes = codes & (_WORDS - 1), codes >> 12
    pairs = (buckets[:-1] * 2_654_435_761 + buckets[1:] * 40_503) % 1_000_003 % _PAIRS
    size = len(data)
    ratio = lambda kind: (size - len(data.translate(None, kind))) / size
    ratios = np.array(
        [
            min(1.0, 5 * ratio(_SYMBOLS)), ratio(_UPPER), ratio(_DIGITS), len(set(words)) / n, float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
            math.log1p(n) / 10, min(1.0, size / n / 20), min(1.0, 5 * data.count(b"\n") / n), 0.0,
        ]
    )
    return np.concatenate([buckets, _WORDS + pairs, _WORDS + _PAIRS + shapes]), _SCALE / n, _SCALE * ratios


class _Rows:
    """Sparse rows: a document's indices and values lie end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.uint16)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32)
        self.ends = np.cumsum([0, *(len(i) for i, _ in rows)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.ends[rows + 1] - self.ends[rows]
        own = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[rows], sizes)
        return own, self.index[at], self.value[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(positive: _Rows, unlabelled: _Rows, prior: float | None, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights and, last, the bias. Without a prior: plain logistic regression of positive against unlabelled, evenly weighted."""
    random = np.random.default_rng(seed)
    w, first, second, t = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0

    def scored(rows: _Rows, chosen: np.ndarray) -> tuple:
        own, index, value = rows.of(chosen)
        return own, index, value, np.bincount(own, value * w[index], len(chosen)) + w[-1]

    def gradient(part: tuple, slope: np.ndarray) -> np.ndarray:
        own, index, value, _ = part
        g = np.bincount(index, value * slope[own], SIZE + 1)
        g[-1] += slope.sum()
        return g

    steps = max(1, min(len(positive), len(unlabelled)) // 250)
    for _ in range(max(epochs, 1_500 // steps)):
        orders = [np.array_split(random.permutation(len(x)), steps) for x in (positive, unlabelled)]
        for chosen_p, chosen_u in zip(*orders):
            p, u = scored(positive, chosen_p), scored(unlabelled, chosen_u)
            up_p, up_u = _sigmoid(p[3]), _sigmoid(u[3])
            if prior is None:
                g = gradient(p, (up_p - 1) / len(chosen_p)) + gradient(u, up_u / len(chosen_u))
            else:
                negative = gradient(u, up_u / len(chosen_u)) - gradient(p, prior * up_p / len(chosen_p))
                risk = np.logaddexp(0, u[3]).mean() - prior * np.logaddexp(0, p[3]).mean()
                g = gradient(p, prior * (up_p - 1) / len(chosen_p)) + negative if risk >= 0 else -negative
            g += 1e-5 * w
            t += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _scores(rows: _Rows, w: np.ndarray) -> np.ndarray:
    out = []
    for chosen in np.array_split(np.arange(len(rows)), max(1, len(rows) // 500)):
        own, index, value = rows.of(chosen)
        out.append(np.bincount(own, value * w[index], len(chosen)) + w[-1])
    return np.concatenate(out)


def estimate_prior(positive: _Rows, unlabelled: _Rows) -> float:
    """Share of positives among the unlabelled: fitted on the even rows of both, measured on the odd ones."""
    halves = [[_Rows([(r.index[a:b], r.value[a:b]) for a, b in zip(r.ends[k::2], r.ends[k + 1 :: 2])]) for k in (0, 1)] for r in (positive, unlabelled)]
    w = _fit(halves[0][0], halves[1][0], None, 8)
    p, u = (np.sort(_scores(h[1], w)) for h in halves)
    cuts = np.quantile(p, np.linspace(0, 0.95, 96))
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    slack = math.sqrt(math.log(40) / (2 * len(p))) + math.sqrt(math.log(40) / (2 * len(u)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.98))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights of the model, from the rows that are not held out; None without a positive or an unlabelled document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(training_fold(F.col("doc_id")) != HELD_OUT)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.filter(training_fold(F.col("doc_id")) != HELD_OUT)
    one = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE).withColumn("positive", F.lit(True))
    two = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MOST_UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(one.unionByName(two))  # as many rows as the two bounds allow

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for text in batch.column(1).to_pylist():
                own, weight, ratios = features(text)
                own, n = np.unique(own, return_counts=True)
                index.append(np.concatenate([own, SIZE - _RATIOS + np.arange(_RATIOS)]).astype(np.uint16).tobytes())
                value.append(np.concatenate([n * weight, ratios]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary()), batch.column(2)], names=["positive", "index", "value", "doc_id"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    texts = texts.groupBy("positive", "doc_id").agg(F.min("text").alias("text")).select("positive", "text", "doc_id")  # one of rows that share an id
    found = texts.mapInArrow(extract, "positive boolean, index binary, value binary, doc_id long").toArrow()
    order = np.lexsort((found.column("doc_id").to_numpy(), found.column("positive").to_numpy()))
    ids, indices, values = (found.column(k) for k in ("positive", "index", "value"))
    parts: dict[bool, list] = {True: [], False: []}
    for k in order.tolist():
        parts[ids[k].as_py()].append((np.frombuffer(indices[k].as_buffer(), np.uint16), np.frombuffer(values[k].as_buffer(), np.float32)))
    positive, unlabelled = _Rows(parts[True]), _Rows(parts[False])
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    return _fit(positive, unlabelled, estimate_prior(positive, unlabelled), 30)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, ...): doc_id, held_out, score (0 to 1), predicted.

    Learns from rows of labels (doc_id, quality) and documents whose crc32(doc_id as text) mod 5 is not 0; a document that is
    labelled both ways counts as unlabelled. Without anything to learn from, every score is 0.5. A null text counts as empty
    and an empty one is scored by its ratios. Repeated rows give repeated rows; other columns are ignored.
    """
    weights = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE + 1 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches_of("codes")
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if w is not None:
                for k, text in enumerate(batch.column(2).to_pylist()):
                    index, weight, ratios = features(text)
                    out[k] = w[index].sum() * weight + ratios @ w[SIZE - _RATIOS : SIZE] + w[-1]
            scores = _sigmoid(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(training_fold(F.col("doc_id").cast("long")) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
