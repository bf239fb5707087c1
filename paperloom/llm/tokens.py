"""Token ids of whole texts, exactly as the tokenizers library gives them, with a cache of words.

A byte-level tokenizer never merges across a change from a visible character to white space, so a text falls into units
(white space, then visible characters) whose ids can be computed apart and concatenated. Units repeat, so their ids are
kept in a bounded dictionary of the Python worker. Whatever the fast path doesn't know goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import keep_cache, use_caches_of

_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
#: White space other than the ASCII kinds that units are cut at.
_ODD_SPACE = re.compile(r"[^\S \t-\r]")
_PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_CONTRACTIONS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte as a letter: visible Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids of a text, special tokens not added."""

    def __init__(self, path: str, most: int = 500_000, most_pieces: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.most, self.most_pieces = self.whole.model, most, most_pieces
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, norm = kind["pre_tokenizer"] or {}, kind["normalizer"]
        steps = pre.get("pretokenizers", [pre])
        plain_bytes = steps[-1].get("type") == "ByteLevel" and not steps[-1]["add_prefix_space"] and not kind["post_processor"]
        self.keeps_space = plain_bytes and len(steps) == 1 and steps[0]["use_regex"] and norm is None
        self.drops_space = (
            plain_bytes
            and len(steps) == 2
            and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _CONTRACTIONS_SPLIT}, "Removed", True)
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )

        self.ranked = self._by_ranks(kind) if self.keeps_space else None

    def _by_ranks(self, kind: dict):
        """The same merges in a faster library; None where they might differ.

        That library merges whatever two neighbours make a token, the lowest id first; the vocabulary merges listed pairs, in
        their order. They are the same if ids are in the order of the merges and every token, merged by ids from its bytes on,
        ends as the listed pair: neighbours that make a token have been merged as in the token alone.
        """
        import tiktoken

        byte_of = {letter: b for b, letter in self.letters.items()}
        vocab, special = kind["model"]["vocab"], {t["content"] for t in kind["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in kind["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or any("<|" not in t for t in special):
            return None
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocab.items() if token not in special}
        for merge in kind["model"]["merges"]:
            pair = tuple(bytes(byte_of[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            if _last_pair(pair[0] + pair[1], ranks) != pair:
                return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not (self.keeps_space or self.drops_space) or _ODD_SPACE.search(text):
            return self._library(text)
        if self.ranked and "<|" not in text and _in_latin_1(text):  # letters and digits that every library agrees on
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        if self.drops_space and "<|" not in text and _in_latin_1(text):
            units = text.lower().split()  # Latin-1 has one way to write and to lower-case a character
        else:
            units = _UNIT.findall(text)
        known = self.units
        found = list(map(known.get, units))
        try:
            return b"".join(found)
        except TypeError:  # some aren't known yet
            return self._filled(units, found)

    def _filled(self, units: list[str], found: list[bytes | None]) -> bytes:
        if 2 * len(self.units) > self.most:  # the older half stays in reach, and what is met again comes over
            self.older, self.units = self.units, {}
        known, long = self.units, {}
        for k, ids in enumerate(found):
            if ids is None:
                unit = units[k]
                cache = known if len(unit) <= 64 else long
                ids = cache.get(unit) or self.older.get(unit)
                if ids is None:
                    ids = self._unit(unit)
                found[k] = cache[unit] = ids
        return b"".join(found)

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        if self.drops_space and unit[-1] in ".," and unit[-2:-1].isalpha() and (head := self.units.get(unit[:-1])):
            return head + self._piece(unit[-1])
        plain = _PLAIN.fullmatch(unit) if len(unit) <= 64 else None
        if not plain:
            return self._library(unit)
        space, word, mark = plain.groups()
        if self.drops_space:
            return self._merge(word.lower()) + (self._piece(mark) if mark else b"")
        head = self._piece("\n") + self._piece(word) if space == "\n" else self._piece(space + word)
        return head + (self._piece(mark) if mark else b"")

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) > self.most_pieces:
                self.pieces.clear()
            got = self.pieces[piece] = self._merge(piece)
        return got

    def _merge(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """The parts that a token's bytes are merged into, the lowest id first, before the token itself is made."""
    own, parts = ranks[token], [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        best = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] >= own:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return tuple(parts)


def _in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary; workers are used again for later tasks."""
    use_caches_of("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


keep_cache("tokens", _ENCODERS.clear)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
