"""Token counts of whole texts by a sentencepiece model; huge texts are encoded in overlapping chunks.

A huge text is encoded chunk by chunk with offsets. Two neighbouring chunks overlap, and they are spliced where both have a
token boundary that nothing can merge across: before a single space that follows a visible character, as no piece of the
vocabulary holds white space after another character, or between two characters that stand side by side in no piece. Each
side's tokens are then those of the whole text. If the overlap has no such place, it is widened, at last to the whole of both
chunks, which then become one; the chunk that follows is twice as long, so that a text without any such place is encoded a few
times at most.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_MARK = "▁"


class Counter:
    """count(texts): numbers of tokens, without begin, end or added special tokens."""

    def __init__(self, path: str, chunk: int = 100_000, overlap: int = 2_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether a space after a visible character is a boundary that no merge crosses.
        self.stable = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        #: Characters that stand side by side in a piece; nothing is known of them if texts are changed before they are encoded.
        self.joined = {x + y for p in pieces for x, y in zip(p, p[1:])}
        self.unchanged = [p.piece for p in self.model.encode("aﬁ２é", return_type="proto").pieces if p.piece in ("ﬁ", "２", "<0xEF>")] != []
        self.widened = self.encoded = 0

    def count(self, texts: list[str | None]) -> list[int]:
        texts = [t or "" for t in texts]
        small = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for k, ids in zip(small, self.model.encode([texts[k] for k in small], num_threads=1)):
            out[k] = len(ids)
        for k, t in enumerate(texts):
            if len(t) > self.chunk:
                out[k] = self.count_huge(t)
        return out

    def count_huge(self, text: str) -> int:
        if not self.stable:
            return len(self.model.encode(text))
        data = text.encode()
        total = counted = start = 0  # what lies before `counted` is in `total`; the chunk at hand begins at `start`
        size = self.chunk
        end = _whole(data, min(size, len(data)))
        left = self._starts(data, start, end)
        while end < len(data):
            further, overlap = _whole(data, min(end + size, len(data))), self.overlap
            while True:
                begin = _whole(data, max(start, end - overlap))
                if begin <= start:  # no boundary to be had: both chunks become one
                    left, size = self._starts(data, start, further), 2 * size
                    break
                if (at := self._boundary(data, begin, end)) is not None:
                    right = self._starts(data, begin, further)
                    if left.holds(at) and right.holds(at):
                        total += left.before(at) - left.before(counted)
                        left, counted, start, size = right, at, begin, self.chunk
                        break
                overlap *= 2
                self.widened += 1
            end = further
        return total + len(left) - left.before(counted)

    def _starts(self, data: bytes, start: int, end: int) -> _Starts:
        self.encoded += end - start
        return _Starts(self.model.encode(data[start:end].decode(), return_type="proto").pieces, start)

    def _boundary(self, data: bytes, start: int, end: int) -> int | None:
        """The first place, away from either rim, that no merge crosses."""
        rim = min(200, (end - start) // 4)
        at = _whole(data, start + rim)
        own = data[at:end].decode()
        for x, y, z in zip(own, own[1:], own[2:]):
            at += len(x.encode())
            if at >= end - rim:
                return None
            if y == " ":
                if x > " " and z > " ":
                    return at
            elif self.unchanged and x + y not in self.joined and not x.isspace() and not y.isspace() and _MARK not in x + y:
                return at
        return None


class _Starts:
    """The byte offsets, in the whole text, at which the tokens of a chunk begin; they ascend, and few are ever looked at."""

    def __init__(self, pieces, start: int):
        self.pieces, self.start = pieces, start

    def __len__(self) -> int:
        return len(self.pieces)

    def __getitem__(self, k: int) -> int:
        return self.start + self.pieces[k].begin

    def before(self, at: int) -> int:
        return bisect_left(self, at)

    def holds(self, at: int) -> bool:
        k = bisect_left(self, at)
        return k < len(self) and self[k] == at


def _whole(data: bytes, at: int) -> int:
    """at, or the next place that doesn't split a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Counts the tokens of every document (doc_id, text, ...).

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null text counts as empty and has 0 of both. Repeated rows give
    repeated rows; other columns are ignored. An empty table gives no rows.
    """
    path = vocabulary(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, SCHEMA)


_COUNTERS: dict[str, Counter] = {}
