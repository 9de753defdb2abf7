"""Many terms in one scan of a text: a multi-pattern automaton over UTF-8 bytes.

The automaton is a few arrays built level by level from the sorted terms: ``goto`` (state and
byte to state), ``fail`` (longest proper suffix that is a state too) and ``output`` (next state
on the suffix chain that ends a term). Steps that are missing are filled in from ``fail``, so a
scan takes one look-up a byte. Bytes that occur in no term share one class.

Texts of an Arrow batch are scanned side by side: step ``i`` moves all texts that have an
``i``-th byte at once. A long text is cut into overlapping spans for that, each of which begins
early enough to be in the state the whole text would be in wherever a term can end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a span that is scanned in one lane, and finds kept before they are made distinct.
SPAN, HELD = 1024, 1 << 20
#: Cells of ``goto`` in one automaton; more terms than that make several.
CELLS = 1 << 24


#: Bytes with the letters A-Z in lower case.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class Automaton:
    """``terms``: distinct, non-empty byte strings. ``find`` gives their numbers."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.longest = max(map(len, terms), default=0)
        used = sorted({c for t in terms for c in t})
        self.byte_class = np.zeros(256, np.int32)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self._grow()

    def _grow(self) -> None:
        order = sorted(range(len(self.terms)), key=lambda i: self.terms[i])
        sizes = np.array([len(self.terms[i]) for i in order], np.int64)
        letters = np.frombuffer(b"".join(self.terms[i] for i in order), np.uint8)
        first = np.cumsum(sizes) - sizes
        # Level by level: terms that agree so far and in the next byte make one new state.
        tables, levels, ends = [np.full((1, self.width), -1, np.int64)], [], [np.full(1, -1, np.int64)]
        at, start, n = np.zeros(len(order), np.int64), 0, 1
        for depth in range(self.longest):
            alive = np.flatnonzero(sizes > depth)
            step = self.byte_class[letters[first[alive] + depth]]
            made, place = np.unique((at[alive] - start) * self.width + step, return_inverse=True)
            tables[-1][made // self.width, made % self.width] = n + np.arange(len(made))
            levels.append((n + np.arange(len(made)), start + made // self.width, made % self.width))
            at[alive] = n + place
            tables.append(np.full((len(made), self.width), -1, np.int64))
            ends.append(np.full(len(made), -1, np.int64))
            done = alive[sizes[alive] == depth + 1]
            ends[-1][at[done] - n] = np.array(order, np.int64)[done]
            start, n = n, n + len(made)
        self.goto, self.ends = np.concatenate(tables), np.concatenate(ends)
        self.fail, self.output = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.goto[0][self.goto[0] < 0] = 0
        for depth, (state, parent, step) in enumerate(levels):
            if depth:
                self.fail[state] = self.goto[self.fail[parent], step]
            back = self.fail[state]
            self.output[state] = np.where(self.ends[back] >= 0, back, self.output[back])
            rows = self.goto[state]
            self.goto[state] = np.where(rows >= 0, rows, self.goto[back])
        self.hits = (self.ends >= 0) | (self.output >= 0)
        self.goto = self.goto.astype(np.int32).ravel()

    def _scan(self, data: np.ndarray, offsets: np.ndarray):
        """Yields texts, the places behind a byte, and the states there, where a term ends.
        Occurrences inside an overlap of two spans come up twice."""
        sizes, overlap = np.diff(offsets), max(self.longest - 1, 0)
        spans = np.maximum(1, -(-np.maximum(sizes - overlap, 1) // SPAN))
        text = np.repeat(np.arange(len(sizes)), spans)
        number = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = offsets[text] + number * SPAN
        length = np.minimum(begin + SPAN + overlap, offsets[text + 1]) - begin
        order = np.argsort(-length, kind="stable")  # lanes that are done drop out at the end
        text, begin, length = text[order], begin[order], length[order]
        state = np.zeros(len(text), np.int32)
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, "left"))
            state = self.goto[state[:n] * self.width + self.byte_class[data[begin[:n] + i]]]
            at = np.flatnonzero(self.hits[state])
            if len(at):
                yield text[at], begin[at] + i + 1, state[at].astype(np.int64)

    def _ends_of(self, states: np.ndarray):
        """Yields marks and term numbers: the term that ends in a state, then those on its suffix chain."""
        at = np.arange(len(states))
        while len(at):
            hit = self.ends[states] >= 0
            yield at[hit], self.ends[states[hit]]
            states = self.output[states]
            at, states = at[states >= 0], states[states >= 0]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and of the terms they hold, each pair once, in order."""
        found, held = [np.zeros(0, np.int64)], 0
        for text, _, state in self._scan(data, offsets):
            found.append(text * len(self.goto) + state)
            held += len(text)
            if held > HELD:
                found = [_distinct(np.concatenate(found))]
                held = 0
        pairs = _distinct(np.concatenate(found))
        text, state = pairs // len(self.goto), pairs % len(self.goto)
        held = [text[at] * len(self.terms) + term for at, term in self._ends_of(state)]
        pairs = _distinct(np.concatenate([np.zeros(0, np.int64), *held]))
        return pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Text, first byte (in the text), byte behind the end and term of every occurrence."""
        found = [np.zeros((0, 4), np.int64)]
        for text, end, state in self._scan(data, offsets):
            for at, term in self._ends_of(state):
                stop = end[at] - offsets[text[at]]
                found.append(np.stack([text[at], stop - self.sizes[term], stop, term], axis=1))
        return np.unique(np.concatenate(found), axis=0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def automata(terms: list[bytes], cells: int = CELLS) -> list[tuple[np.ndarray, Automaton]]:
    """Automata that are no larger than ``cells`` unless one term is, with the places of their
    terms in the list."""
    out, some, used, letters = [], [], 0, set()
    order = sorted(range(len(terms)), key=lambda i: terms[i])
    for i in order:
        wider = letters | set(terms[i])
        if some and (used + len(terms[i])) * (len(wider) + 1) > cells:
            out.append((np.array(some), Automaton([terms[j] for j in some])))
            some, used, wider = [], 0, set(terms[i])
        some.append(i)
        used, letters = used + len(terms[i]), wider
    if some:
        out.append((np.array(some), Automaton([terms[j] for j in some])))
    return out


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
