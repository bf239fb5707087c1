"""Online logistic mixing of bit predictors over whole texts; numpy only, the same for any grouping of texts.

A text is a sequence of tokens. A token of the vocabulary is one symbol; any other is an escape symbol, then its bytes, then a
mark. Symbols are spelled in bits by Huffman codes (one of tokens, one of bytes), so a text is a sequence of bits, and every bit
is predicted in order:

- CHANNELS hashed contexts, of tokens (none; the last common token; the token before) or, inside a spelled token, of bytes (the
  last three; the last common token and two bytes; the last five). The context and the code's node give a slot, and the counts of
  zeros and ones there, kept as one of 256 states, give log odds. How tokens are spelled is learned from those that training
  spells, and from each token of the vocabulary once;
- a match: where the tokens just before have been seen, what followed then is expected again, spelled bytes too.

A gate (how well the longer contexts are known, whether a match runs, token or byte) chooses the weights that add the log odds
up, and the sum is refined by a map from odds to odds that the document itself corrects. Weights and map start from fixed values
and are learned online while a document is scored, block by block, each bit being scored before it is learned from.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import repeat
from os.path import commonprefix

import numpy as np
import xxhash

CHANNELS = 3
#: The weights that a document starts from, of the channels and of the match: for tokens, and for spelled bytes.
START = ((0.35, 0.6, 0.4, 2.5), (0.5, 0.6, 0.5, 2.5))
#: Tokens that count as common, and tokens that are contexts by themselves (others are so by their endings).
COMMON, FREQUENT = 64, 4096
KNOWN = 4  # classes of what is known of the third context
GATES = 2 * 3 * KNOWN
BUCKETS = 16  # of log odds from -8 to 8
MARK = 32  # the byte after a spelled token; no token holds a space
#: Tokens in the first block of a text, and in its later ones (each twice the one before, up to this).
FIRST_BLOCK, LAST_BLOCK = 16, 1024
#: Tokens of a text that are worked on at once.
SEGMENT = 60_000
RATE, MAP_RATE, SHARE = 6.0, 3.0, 2
#: Symbols with their contexts that are gathered before their bits are counted, and bits that hold a symbol's number.
FLUSH, SYMBOL_BITS = 1 << 20, 24
MATCH_TOKENS = 3
_ODD = np.uint32(0x9E3779B1)
_SALTS = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The Huffman code of symbols with these counts: for each symbol the nodes (from 0) and bits from the root on."""
    n = len(counts)
    heap = [(float(c) + 0.01, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a[1], b[1]))
        heapq.heappush(heap, (a[0] + b[0], n + len(children) - 1))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    stack = [(heap[0][1], [])]
    while stack:
        node, path = stack.pop()
        if node < n:
            paths[node] = path
        else:
            stack += [(children[node - n][bit], [*path, (node - n, bit)]) for bit in (0, 1)]
    return paths


class Code:
    """Paths of the symbols: 0 to V - 1 the vocabulary's tokens, V the escape, V + 1 + b the byte b of a spelled token."""

    def __init__(self, token_counts: np.ndarray, byte_counts: np.ndarray):
        """token_counts: V + 1 numbers, the escape's last; byte_counts: 256."""
        self.escape = len(token_counts) - 1
        tokens, letters = _paths(token_counts), _paths(byte_counts)
        paths = tokens + [[(node + len(tokens), bit) for node, bit in p] for p in letters]
        self.lens = np.array([len(p) for p in paths], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        nodes = np.array([node for p in paths for node, _ in p], np.uint32)
        bits = np.array([bit for p in paths for _, bit in p], np.uint32)
        mixed = (nodes + np.uint32(1)) * _ODD
        self.steps = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) << np.uint32(1) | bits  # a hash of the node, and the bit
        self.values = np.zeros(len(paths), np.uint64)  # the code words, from the highest bit on
        for k, p in enumerate(paths):
            self.values[k] = sum(bit << (63 - i) for i, (_, bit) in enumerate(p[:64]))

    def shared(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many first bits two symbols' code words have in common."""
        differ = self.values[one] ^ self.values[two]
        high = (differ >> np.uint64(32)).astype(np.uint32)
        top = np.where(high > 0, high, differ.astype(np.uint32)).astype(float)
        first = np.where(high > 0, 31, 63) - np.floor(np.log2(np.maximum(top, 1))).astype(np.int64)
        return np.where(differ == 0, 64, first)


#: Counts that are kept as they are: zeros and ones that are EXACT together at most. Others are kept by their share of ones, in
#: LEVELS steps of log odds, and by how many they are, in as many classes as 256 states leave.
EXACT, LEVELS = 12, 32
_PAIRS = [(zeros, n - zeros) for n in range(EXACT + 1) for zeros in range(n + 1)]
_MANY = (256 - len(_PAIRS)) // LEVELS
_STATE_OF = np.zeros((EXACT + 1, EXACT + 1), np.uint8)
for _k, _pair in enumerate(_PAIRS):
    _STATE_OF[_pair] = _k


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """uint8: the states of these counts."""
    total = zeros + ones
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    level = np.clip(np.rint((odds + 8) * (LEVELS - 1) / 16), 0, LEVELS - 1).astype(np.int64)
    many = np.clip(np.floor(np.log2(np.maximum(total, 1) / EXACT) / 2), 0, _MANY - 1).astype(np.int64)
    few = _STATE_OF[np.minimum(zeros, EXACT), np.minimum(ones, EXACT)]
    return np.where(total <= EXACT, few, len(_PAIRS) + many * LEVELS + level).astype(np.uint8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By state: log odds, and the class of how much is known."""
    few = [np.log((ones + 0.4) / (zeros + 0.4)) for zeros, ones in _PAIRS]
    odds = np.concatenate([few, np.tile(np.linspace(-8, 8, LEVELS), _MANY), np.zeros(256 - len(_PAIRS) - _MANY * LEVELS)])
    known = np.append(np.digitize([sum(x) for x in _PAIRS], [1, 3, EXACT]), np.full(256 - len(_PAIRS), KNOWN - 1))
    return odds.astype(np.float32), known.astype(np.int64)


ODDS, KNOWN_OF = _tables()


class Vocabulary(dict):
    """token -> id; all others have the escape's."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(words))
        self.escape = len(words)

    def __reduce__(self):
        return Vocabulary, (list(self),)


@dataclass
class Tokens:
    """Some documents' tokens, one after the other. where: of the spelled ones, with their words."""

    ids: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray
    where: np.ndarray
    words: list[bytes]


def read_tokens(texts: list[list[bytes]], vocabulary: Vocabulary, end: int) -> Tokens:
    """texts: words; each document gets one token `end` more."""
    ids, where, words, at, others = [], [], [], 0, repeat(vocabulary.escape)
    for text in texts:
        own = np.fromiter(map(vocabulary.get, text, others), np.int32, len(text))
        new = np.flatnonzero(own == vocabulary.escape)
        if len(new):
            where.append(new + at)
            words += [text[k] for k in new.tolist()]
        ids += [own, np.array([end], np.int32)]
        at += len(text) + 1
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    none = np.empty(0, np.int64)
    return Tokens(np.concatenate(ids) if ids else np.empty(0, np.int32), np.repeat(np.arange(len(texts)), sizes), sizes, np.concatenate(where) if where else none, words)


def ending(word: bytes) -> int:
    """A class of a token by its last two bytes."""
    return (word[-2:][0] * 7 + word[-1]) % 1021


def endings_of(words: list[bytes]) -> np.ndarray:
    """ending() of each of these words."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
    begin = np.append(0, ends[:-1] + 1)
    return (data[np.maximum(ends - 1, begin)] * np.uint32(7) + data[ends]) % np.uint32(1021)


def _mixed(x: np.ndarray, salt: np.uint32) -> np.ndarray:
    x = (x ^ salt) * _ODD
    return (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)


class Contexts:
    """What precedes each token: hashes for the channels, the common token, the expected token and its match's length."""

    def __init__(self, tokens: Tokens, endings: np.ndarray, matches: bool = True):
        """endings: for each id of the vocabulary a class."""
        ids, n = tokens.ids, len(tokens.ids)
        first = np.cumsum(tokens.sizes) - tokens.sizes
        place = np.arange(n) - first[tokens.doc]
        own = np.where(ids < FREQUENT, ids, FREQUENT + endings[ids]).astype(np.uint32)
        if len(tokens.where):
            own[tokens.where] = np.uint32(FREQUENT) + endings_of(tokens.words)
        own += 2
        before = np.ones(n, np.uint32)
        before[1:] = own[:-1]
        before[place == 0] = 1
        seen = np.where(ids < COMMON, np.arange(n), -1)
        seen = np.maximum.accumulate(np.concatenate([[-1], seen[:-1]])) if n else seen
        self.common = np.where(seen >= first[tokens.doc], ids[np.maximum(seen, 0)] + 1, 0).astype(np.uint32)
        self.hashes = [_mixed(c, s) for c, s in zip((np.zeros(n, np.uint32), self.common, before), _SALTS)]
        self.expected, self.lengths, self.source = self._matches(tokens, place) if matches else (None, None, None)

    @staticmethod
    def _matches(tokens: Tokens, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Within a document: the token that followed where its last MATCH_TOKENS tokens stood before, for how long so, and where."""
        n, ids = len(tokens.ids), tokens.ids.astype(np.uint64)
        expected, lengths, source = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        key = (tokens.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        own = ids.copy()
        own[tokens.where] = np.fromiter(map(xxhash.xxh64_intdigest, tokens.words), np.uint64, len(tokens.words)) | np.uint64(1 << 40)
        for back in range(1, MATCH_TOKENS + 1):
            shifted = np.zeros(n, np.uint64)
            shifted[back:] = own[: n - back]
            key = (key + shifted) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        short = (key >> np.uint64(48)).astype(np.intp)
        rows = np.flatnonzero((np.bincount(short, minlength=1 << 16).take(short) > 1) & (place >= MATCH_TOKENS))  # others stand alone
        if not len(rows):
            return expected, lengths, source
        order = rows[np.argsort(key[rows], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        at, earlier = order[1:][same], order[:-1][same]
        expected[at] = tokens.ids[earlier]
        source[at] = earlier
        goes_on = np.zeros(n, bool)
        goes_on[1:] = (source[1:] >= 0) & (source[1:] == source[:-1] + 1)
        begun = np.maximum.accumulate(np.where(goes_on, 0, np.arange(n)))
        lengths[at] = (np.arange(n) - begun)[at] + 1
        return expected, lengths, source


def _edges(n: int) -> np.ndarray:
    """Where a text's blocks begin, up to n tokens."""
    out, size = [0], FIRST_BLOCK
    while out[-1] + size < n:
        out.append(out[-1] + size)
        size = min(2 * size, LAST_BLOCK)
    return np.array(out)


def _symbols(tokens: Tokens, contexts: Contexts, code: Code, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The symbols of the tokens `rows`, in that order: symbol, its token's row, whether it's a byte, hashes of the channels."""
    ids = tokens.ids[rows]
    spelled = np.flatnonzero(ids == code.escape)
    number = np.searchsorted(tokens.where, rows[spelled])
    words = [tokens.words[k] for k in number.tolist()]
    lens = np.array([len(w) + 1 for w in words], np.int64)
    sizes = np.ones(len(rows), np.int64)
    sizes[spelled] += lens
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    symbol = np.empty(len(owner), np.int64)
    symbol[starts] = ids
    token = rows[owner]
    hashes = [np.repeat(h[rows], sizes) for h in contexts.hashes]
    is_byte = np.ones(len(owner), bool)
    is_byte[starts] = False
    if len(words):
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        symbol[is_byte] = data + np.uint32(code.escape + 1)
        begin = np.cumsum(lens) - lens
        place = np.arange(len(data)) - np.repeat(begin, lens)
        last = np.zeros((5, len(data)), np.uint32)
        for back in range(1, 6):
            last[back - 1, back:] = data[: max(0, len(data) - back)] + 1
            last[back - 1, place < back] = 0
        common = contexts.common[token[is_byte]] + np.uint32(1)
        two = last[0] * np.uint32(257) + last[1]
        three = two * np.uint32(257) + last[2]
        five = (three * np.uint32(257) + last[3]) * np.uint32(263) + last[4]
        for k, c in enumerate((three, two * np.uint32(67) + common, five)):
            hashes[k][is_byte] = _mixed(c + np.uint32(0x5BD1E995), _SALTS[k])
    return symbol, token, is_byte, hashes


def _steps(code: Code, symbol: np.ndarray, hashes: list[np.ndarray], slot_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the symbols' bits: how many each has, where each begins, the bits, and for each channel the slots."""
    lens = code.lens.take(symbol, mode="clip")
    begin = np.cumsum(lens) - lens
    path = np.repeat(code.starts.take(symbol, mode="clip") - begin, lens)
    path += np.arange(len(path))
    steps = code.steps.take(path, mode="clip")
    bit, node, shift = steps & np.uint32(1), steps >> np.uint32(1), np.uint32(32 - slot_bits)
    slots = []
    for h in hashes:
        own = np.repeat(h, lens)
        own ^= node
        own *= _ODD
        own >>= shift
        slots.append(own)
    return lens, begin, bit, slots


class Counts:
    """How often the channels' slots have had a zero and a one; side by side, 2 * slots numbers for each channel.

    The first two contexts of a token are known by the last common token alone, so these are counted as pairs of common token
    and token, and their bits are counted once for each pair, in whole().
    """

    def __init__(self, code: Code, endings: np.ndarray, slot_bits: int):
        self.code, self.endings, self.slot_bits = code, endings, slot_bits
        self.counts = np.zeros((CHANNELS, 2 << slot_bits), np.int32)
        self.pairs = np.zeros((COMMON + 1) * (code.escape + 1), np.int32)
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(CHANNELS)]

    def _bits(self, channel: int, symbol: np.ndarray, hashed: np.ndarray) -> None:
        self.waiting[channel].append(hashed.astype(np.uint64) << np.uint64(SYMBOL_BITS) | symbol.astype(np.uint64))
        if sum(map(len, self.waiting[channel])) >= FLUSH:
            self._flush(channel)

    def _flush(self, channel: int) -> None:
        """Counts what waits: the bits of each symbol in each context once, times how often it stands there."""
        waiting, self.waiting[channel] = self.waiting[channel], []
        if not any(map(len, waiting)):  # nothing, or texts without a spelled token
            return
        keys = np.concatenate(waiting)
        del waiting
        keys.sort()
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1)
        keys, times = keys[ends], np.diff(ends, prepend=-1).astype(np.int32)
        for at in range(0, len(keys), SEGMENT):
            part = keys[at : at + SEGMENT]
            symbol = (part & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)
            self._count(channel, symbol, (part >> np.uint64(SYMBOL_BITS)).astype(np.uint32), times[at : at + SEGMENT])

    def _count(self, channel: int, symbol: np.ndarray, hashed: np.ndarray, times: np.ndarray) -> None:
        lens, _, bit, (slot,) = _steps(self.code, symbol, [hashed], self.slot_bits)
        slot <<= np.uint32(1)
        slot |= bit
        np.add.at(self.counts[channel], slot.astype(np.intp), np.repeat(times, lens))

    def add(self, tokens: Tokens) -> None:
        contexts = Contexts(tokens, self.endings, matches=False)
        np.add.at(self.pairs, contexts.common.astype(np.intp) * (self.code.escape + 1) + tokens.ids, np.int32(1))
        for at in range(0, len(tokens.ids), SEGMENT):
            rows = np.arange(at, min(at + SEGMENT, len(tokens.ids)))
            symbol, _, is_byte, hashes = _symbols(tokens, contexts, self.code, rows)
            self._bits(2, symbol, hashes[2])
            for channel in (0, 1):
                self._bits(channel, symbol[is_byte], hashes[channel][is_byte])

    def spell(self, words: list[bytes]) -> None:
        """Counts how these tokens are spelled, each once, after no common token."""
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT]
            spelled = Tokens(np.full(len(part), self.code.escape, np.int32), np.arange(len(part)), np.ones(len(part), np.int64), np.arange(len(part)), part)
            symbol, _, is_byte, hashes = _symbols(spelled, Contexts(spelled, self.endings, matches=False), self.code, np.arange(len(part)))
            for channel in range(CHANNELS):
                self._bits(channel, symbol[is_byte], hashes[channel][is_byte])

    def whole(self) -> np.ndarray:
        for channel in range(CHANNELS):
            self._flush(channel)
        found = np.flatnonzero(self.pairs)
        for at in range(0, len(found), SEGMENT):
            pair = found[at : at + SEGMENT]
            common, symbol = np.divmod(pair, self.code.escape + 1)
            for channel, context in ((0, np.zeros(len(pair), np.uint32)), (1, common.astype(np.uint32))):
                self._count(channel, symbol, _mixed(context, _SALTS[channel]), self.pairs[pair])
        self.pairs[:] = 0
        return self.counts


class Model:
    """What training has found: code, token classes, and the states of each channel's slots."""

    def __init__(self, code: Code, endings: np.ndarray, slot_bits: int, slots: np.ndarray):
        self.code, self.endings, self.slot_bits, self.states = code, endings, slot_bits, slots

    def score(self, tokens: Tokens, contexts: Contexts) -> np.ndarray:
        """For each document the bits that its tokens take, learning online from the bits before. What a bit is predicted from
        doesn't depend on the bit, so the chances of its two values add up to one, in documents that are in the counts too."""
        n_docs = len(tokens.sizes)
        place = np.arange(len(tokens.ids)) - (np.cumsum(tokens.sizes) - tokens.sizes)[tokens.doc]
        block = np.searchsorted(_edges(int(tokens.sizes.max(initial=1))), place, "right") - 1
        ends = block[np.cumsum(tokens.sizes) - 1]
        state = _State(n_docs)
        for at in range(0, len(tokens.ids), SEGMENT):  # later segments are a long text's, or begin new documents
            rows = np.arange(at, min(at + SEGMENT, len(tokens.ids)))
            self._segment(tokens, contexts, rows, block[rows], ends, state)
        return state.spent

    def _segment(self, tokens: Tokens, contexts: Contexts, rows: np.ndarray, block: np.ndarray, ends: np.ndarray, state: _State) -> None:
        last = block == ends[tokens.doc[rows]]  # nothing is learned from a document's last block
        part = (block - block.min()) * 2 + last
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        symbol, token, is_byte, hashes = _symbols(tokens, contexts, self.code, rows)
        lens, begin, bit, slots = _steps(self.code, symbol, hashes, self.slot_bits)
        inputs = []
        for k, slot in enumerate(slots):
            state_of = self.states[k].take(slot, mode="clip")  # all are in range; "clip" needs no buffer
            inputs.append(ODDS.take(state_of, mode="clip"))
        known = KNOWN_OF.take(state_of, mode="clip")
        match, run, lost = self._match(tokens, contexts, symbol, token, is_byte, lens, begin, bit)
        inputs.append(match)
        doc = tokens.doc[token]
        where = np.repeat(doc * GATES + (is_byte * 3 + run) * KNOWN, lens)
        where += known
        where[lost] -= np.repeat(run, lens)[lost] * KNOWN
        base = np.repeat(doc * BUCKETS, lens)
        sign = bit.astype(np.float32) * 2 - 1
        begins = np.append(begin[~is_byte], len(bit))  # of tokens
        edges = begins[np.searchsorted(part, np.arange(part[-1] // 2 * 2 + 3))].tolist()
        for k in range(0, len(edges) - 1, 2):
            a, b, c = edges[k : k + 3]
            state.block(base[a:c], where[a:c], sign[a:c], [x[a:c] for x in inputs], b - a)

    def _match(self, tokens: Tokens, contexts: Contexts, symbol: np.ndarray, token: np.ndarray, is_byte: np.ndarray, lens: np.ndarray, begin: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bit: 1 or -1 for an expected one or zero, else 0; of each symbol: 0, 1 or 2 (a long match); bits after a miss."""
        match, run = np.zeros(len(bit), np.float32), np.zeros(len(symbol), np.int64)
        expected, escape = np.where(is_byte, -1, contexts.expected[token]), self.code.escape
        both = np.flatnonzero((expected == escape) & (symbol == escape))
        ours, others = (np.searchsorted(tokens.where, rows).tolist() for rows in (token[both], contexts.source[token[both]]))
        for at, one, two in zip(both.tolist(), ours, others):
            own, other = tokens.words[one] + b" ", tokens.words[two] + b" "
            n = len(own) if own == other else len(commonprefix([own, other])) + 1  # up to the first byte that differs
            expected[at + 1 : at + 1 + n] = np.frombuffer(other[:n], np.uint8) + np.int64(escape + 1)
        hoped = np.flatnonzero(expected >= 0)
        if not len(hoped):
            return match, run, hoped
        own = lens[hoped]
        right = np.repeat(np.minimum(self.code.shared(symbol[hoped], expected[hoped]), own), own)
        depth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        at = np.repeat(begin[hoped], own) + depth
        sign = bit[at].astype(np.float32) * 2 - 1
        match[at] = np.where(depth < right, sign, np.where(depth == right, -sign, 0))
        run[hoped] = 1 + (contexts.lengths[token[hoped]] >= 16)
        return match, run, at[depth > right]


class _State:
    """What documents have learned so far, and the bits that they have taken."""

    def __init__(self, n_docs: int):
        self.weights = [np.tile(np.repeat(np.array(w, np.float32), GATES // 2), n_docs) for w in zip(*START)]
        self.map = np.zeros(n_docs * BUCKETS, np.float32)
        self.mapped = np.zeros(n_docs * BUCKETS)
        self.taken = np.zeros(n_docs * BUCKETS)

    @property
    def spent(self) -> np.ndarray:
        return self.taken.reshape(-1, BUCKETS).sum(1) / -np.log(2)

    def block(self, base: np.ndarray, where: np.ndarray, sign: np.ndarray, inputs: list[np.ndarray], learn: int) -> None:
        """Scores a block's bits, then learns from the first `learn` of them. base: where the document's map begins."""
        if not len(base):
            return
        odds = self.weights[0].take(where, mode="clip")
        odds *= inputs[0]
        for w, x in zip(self.weights[1:], inputs[1:-1]):
            part = w.take(where, mode="clip")
            part *= x
            odds += part
        hoped = np.flatnonzero(inputs[-1] != 0)  # few bits have a match
        hope, at = inputs[-1][hoped], where[hoped]
        odds[hoped] += self.weights[-1].take(at) * hope
        np.clip(odds, -7.99, 7.99, out=odds)
        bucket = ((odds + np.float32(8)) * np.float32(BUCKETS / 16)).astype(np.intp)
        bucket += base
        odds += self.map.take(bucket, mode="clip")
        odds *= sign
        chance = 1 / (1 + np.exp(-odds))
        self.taken += np.bincount(bucket, np.log(chance).astype(float), len(self.taken))
        if not learn:
            return
        bucket, where = bucket[:learn], where[:learn]
        error = ((1 - chance[:learn]) * sign[:learn]).astype(float)
        self.mapped += np.bincount(bucket, minlength=len(self.map))
        self.map += MAP_RATE * np.bincount(bucket, error, len(self.map)) / (self.mapped + 100)
        rate = np.repeat(RATE / (400 + self.mapped.reshape(-1, BUCKETS).sum(1) / SHARE), GATES)
        for w, x in zip(self.weights, inputs[:-1]):
            w += rate * np.bincount(where, error * x[:learn], len(w))
        early = np.searchsorted(hoped, learn)
        self.weights[-1] += rate * np.bincount(at[:early], error[hoped[:early]] * hope[:early], len(rate))
