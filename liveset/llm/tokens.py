"""Whole texts to token ids with the ``tokenizers`` library, inside tasks.

The word tokenizers used here drop white space and never look across it: their normaliser
and their pre-tokenizer both act within runs of other characters. A text's ids are
therefore those of its white-space separated pieces, one after another, and the ids of a
piece can be kept and used again. Pieces are cut at ASCII white space only, so rarer
separators stay inside a piece and are left to the library. A batch's pieces are found in its
bytes and reduced to distinct ones by Arrow, so that only those are looked up.

Where probes show that the tokenizer allows it, closing punctuation after an ASCII letter or
digit is a piece of its own, ASCII capitals are the same piece as small letters, and a piece of
small letters goes to the tokenizer's model directly.
``Encoder(whole=True)`` keeps to one library call per text, for tokenizers that do look
across white space.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from liveset.llm.common import flat

KEPT_PIECES = 600_000
PIECES_A_CALL = 1_000
MARK = "~"  # stands between pieces that are encoded in one call
BYTES_A_GROUP = 1 << 21
PROBE = "a  b,\tc\u0144d 'S e's <|endoftext|> 12 3"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts that must have the ids of their parts, where punctuation is cut off.
CLOSED = [(w, p) for w in ("word", "It's", "12", "a1", "Z") for p in (
    *"""!"#$%&'()*+,-./:;=?@[\\]^_`{}""", "...", "?!", ".,", "&&&", "''", ").")]
#: Words that must have the ids the model alone gives them, where words skip the other steps.
WORDS = ["a", "of", "water", "internationalisation", "qzxvkjw", "ñandú", "ciónquell", "straße", "éééou", "œuvre", "ěščř", "ɏaƀ", "s", "t", "re"]
LAST_LETTER = "\u024f"

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[*b"""!"#$%&'()*+,-./:;=?@[\\]^_`{}"""]] = True  # no sign of the special tokens, and not the mark
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_SMALL = _SAME.copy()
_SMALL[65:91] += 32


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the rest for those from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """Ids of texts; at most ``kept`` pieces are remembered, so memory is bounded."""

    def __init__(self, path: str, whole: bool = False, kept: int = KEPT_PIECES):
        # One thread a task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept, self.whole = kept, whole or not self._splits()
        mark = self._encode([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        if not self.whole:
            joined, parts = self._encode([w + p for w, p in CLOSED]), self._encode([x for pair in CLOSED for x in pair])
            self.closing = joined == [a + b for a, b in zip(parts[::2], parts[1::2])]
            words = [LETTERS, *LETTERS, "WoRD", "IT'S", "A1"]
            self.bytes = _byte_letters()
            self.modelled = self._modelled(WORDS) == self._encode(WORDS)
            self.letters = _SMALL if self._encode(words) == self._encode([w.lower() for w in words]) else _SAME
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces, end to end, and how many each has: one call with a marker
        after every piece. A piece that holds the marker must not be among them."""
        ids = np.array(self._encode([f" {MARK} ".join(pieces) + f" {MARK}"])[0], np.uint32)
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(pieces) or self.mark is None:
            encoded = self._encode(pieces)
            return np.array([i for e in encoded for i in e], np.uint32), np.fromiter(map(len, encoded), np.int64)
        return ids[ids != self.mark], np.diff(at, prepend=-1) - 1

    def _splits(self) -> bool:
        """Whether this tokenizer encodes a text piece by piece, on a telling example."""
        parts = self._encode(PROBE.split())
        return self._encode([PROBE])[0] == [i for p in parts for i in p]

    def _modelled(self, words: list[str]) -> list[list[int]]:
        """Ids of single runs of letters by the tokenizer's model, past its other steps."""
        tokenize, letters = self.tokenizer.model.tokenize, self.bytes
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words]
        return [[t.id for t in tokenize(w)] for w in shown]

    def _learn(self, keys: list[bytes]) -> None:
        pieces = [k.decode() for k in keys]
        if self.modelled:
            # Letters that are normal and small already: no step before the model changes or cuts them.
            fit = [p.isalpha() and p.islower() and (p.isascii() or max(p) <= LAST_LETTER and p == p.lower() and is_normalized("NFC", p))
                   for p in pieces]
            words = [p for p, f in zip(pieces, fit) if f]
            pieces = [p for p, f in zip(pieces, fit) if not f]
            ids = self._modelled(words)
            self._keep(words, np.array([i for x in ids for i in x], np.uint32), np.array(list(map(len, ids)), np.int64))
        odd = [p for p in pieces if MARK in p]
        plain = [p for p in pieces if MARK not in p] if odd else pieces
        for some in [plain[k:k + PIECES_A_CALL] for k in range(0, len(plain), PIECES_A_CALL)] + [[p] for p in odd]:
            if MARK in some[0]:
                ids = np.array(self._encode(some)[0], np.uint32)
                sizes = np.array([len(ids)])
            else:
                ids, sizes = self._pieces(some)
            self._keep(some, ids, sizes)

    def _keep(self, some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), len(self.place)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(some) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + total] = ids
        self.start[n:n + len(some)] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + len(some)] = sizes
        self.place.update(zip([p.encode() for p in some], range(n, n + len(some))))
        self.used += total

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        """Bytes of all pieces end to end, their offsets, and each text's first piece."""
        data = self.letters[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside[1:] & (~inside[:-1] | edge)
        if self.closing and len(data):
            closing = np.zeros(len(data) + 2, bool)
            closing[1:-1] = _CLOSING[data]
            first = np.flatnonzero(closing[1:] & (~closing[:-1] | edge))
            behind = np.flatnonzero(closing[:-1] & (~closing[1:] | edge))
            ends = ~inside[1:] | edge  # nothing of the piece follows
            first = first[ends[behind] & ~edge[first] & (first > 0) & _PLAIN[data[np.maximum(first, 1) - 1]]]
            begins[first] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(np.cumsum(np.append(0, inside[1:-1]))[start], inside[1:-1].sum()))
        return data[inside[1:-1]], np.append(0, np.cumsum(length)).astype(np.int64), np.searchsorted(start, offsets)

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if len(self.place) > self.kept:
            self._forget()
        letters, cuts, first = self._cut(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
        raw, at = flat(pieces.dictionary)
        raw, at = raw.tobytes(), at.tolist()
        keys = [raw[a:b] for a, b in zip(at, at[1:])]
        known = list(map(self.place.get, keys))
        if None in known:
            self._learn([k for k, at in zip(keys, known) if at is None])
            known = list(map(self.place.__getitem__, keys))
        at = np.array(known, np.int64)[pieces.indices.to_numpy()]
        sizes = self.size[at]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.split(ids, ends[first[1:-1]])

    def encode_many(self, texts):
        """Ids of each whole text in turn, as unsigned 32-bit integers; null is the empty text.
        ``texts`` is a list or an Arrow array of strings."""
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if self.whole:
            for text in column.to_pylist():
                yield np.array(self._encode([text or ""])[0], np.uint32)
            return
        data, offsets = flat(column)
        begin, n = 0, len(offsets) - 1
        while begin < n:
            end = int(np.searchsorted(offsets, offsets[begin] + BYTES_A_GROUP, "right")) - 1
            end = min(max(end, begin + 1), n)
            lo, hi = int(offsets[begin]), int(offsets[end])
            if hi - lo > BYTES_A_GROUP:
                yield self._long(data[lo:hi])
            else:
                yield from self._group(data[lo:hi], offsets[begin:end + 1] - lo)
            begin = end

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The same pieces of one text, a part of it at a time, cut at white space."""
        parts, begin = [], 0
        while begin < len(data):
            end = begin + BYTES_A_GROUP
            while end < len(data):
                gap = np.flatnonzero(_GAP[data[end:end + BYTES_A_GROUP]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += BYTES_A_GROUP
            end = min(end, len(data))
            parts += self._group(data[begin:end], np.array([0, end - begin]))
            begin = end
        return np.concatenate(parts)

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.encode_many([text])))


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file: a reused Python worker finds the pieces known."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]
