"""Weighted acyclic automata over word sequences: count transducers.

A transducer reads a sequence label by label; the weight of the last arc read is the count
of the sequence: how often it begins one of the counted rows. Layers are numpy arrays, so
a step treats all states of a layer at once.

* ``Tree`` is the unshared form. ``Tree.of_sorted`` builds it incrementally from sorted
  distinct rows: a row adds the arcs beyond what it shares with the row before.
* ``Tree.pack`` makes the automaton minimal from the last layer up: states with the same
  labels, weights and targets are one. ``unpack`` reads it back.
* ``union`` merges transducers layer by layer and sums weights of equal paths.
* ``compose`` reads the sequences of one automaton through another, pairs of states a
  layer at a time, and gives the weight each path ends with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from liveset.llm.common import mixed

_SALTS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def dictionary(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings in ascending order, and the place of every value among them."""
    encoded = values.cast(pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)), rank[encoded.indices.to_numpy()]


class Tree:
    """``words``: label texts in ascending order. Per layer: ``label``, ``weight`` and
    ``parent`` (place of the arc before, in the layer before), arcs in ascending order."""

    def __init__(self, words: pa.Array, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.layers = words, layers

    @staticmethod
    def of_sorted(words: pa.Array, rows: np.ndarray, counts: np.ndarray) -> Tree:
        """From sorted distinct rows of label places; -1 stands behind a row's end."""
        layers, fresh, arc_of = [], np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        fresh[:1] = True
        for column in rows.T:
            fresh = fresh | np.append(np.ones(min(1, len(rows)), bool), column[1:] != column[:-1])
            at = np.flatnonzero(fresh & (column >= 0))
            # Rows that ended before this layer hang between two arcs and weigh nothing here.
            weight = np.add.reduceat(np.where(column >= 0, counts, 0), at) if len(at) else np.zeros(0, np.int64)
            layers.append((column[at].astype(np.int64), weight, arc_of[at]))
            arc_of = np.searchsorted(at, np.arange(len(rows)), "right") - 1
        return Tree(words, layers)

    def paths(self, layer: int, arcs: np.ndarray) -> np.ndarray:
        """Labels read up to some arcs of a layer, one row an arc."""
        out = np.empty((len(arcs), layer + 1), np.int64)
        for k in range(layer, -1, -1):
            label, _, parent = self.layers[k]
            out[:, k], arcs = label[arcs], parent[arcs]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct rows and their counts again."""
        found, depth = [], len(self.layers)
        for k, (label, weight, _) in enumerate(self.layers):
            own = weight.copy()
            if k + 1 < depth:
                _, below, parent = self.layers[k + 1]
                np.subtract.at(own, parent, below)
            arcs = np.flatnonzero(own > 0)
            ids = np.full((len(arcs), depth), -1, np.int64)
            ids[:, :k + 1] = self.paths(k, arcs)
            found.append((ids, own[arcs]))
        ids, counts = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort(ids.T[::-1])
        return ids[order], counts[order]

    def part(self, rows: np.ndarray, counts: np.ndarray) -> Tree:
        """Transducer of some of the sorted rows, with the words they need."""
        used = np.unique(rows)
        used = used[used >= 0]
        again = np.searchsorted(used, rows)
        again[rows < 0] = -1
        return Tree.of_sorted(self.words.take(pa.array(used)), again, counts)

    # --- the minimal form as bytes -----------------------------------------------------------
    def pack(self) -> tuple[bytes, int]:
        """The minimal automaton as bytes, and their length when unpacked."""
        arrays: list[np.ndarray] = []
        target, kept = np.zeros(0, np.int64), None
        for k in range(len(self.layers) - 1, -1, -1):
            label, weight, parent = self.layers[k]
            if kept is None:
                target = np.zeros(len(label), np.int64)
            states = len(self.layers[k - 1][0]) if k else 1
            begin = np.searchsorted(parent, np.arange(states + 1))
            sign = [mixed(label.astype(np.uint64) + s * mixed(weight.astype(np.uint64) + s * mixed(target.astype(np.uint64) + s)))
                    for s in _SALTS]
            both = np.zeros((states, 2), np.uint64)
            for j, values in enumerate(sign):
                sums = np.append(np.zeros(1, np.uint64), np.cumsum(values))
                both[:, j] = sums[begin[1:]] - sums[begin[:-1]]
            order = np.lexsort(both.T)
            new = np.append(True, (both[order][1:] != both[order][:-1]).any(axis=1)) if states else np.zeros(0, bool)
            state = np.empty(states, np.int64)
            state[order] = np.cumsum(new) - 1
            first = order[new]  # one tree state stands for all that are equal
            sizes = begin[first + 1] - begin[first]
            arcs = np.repeat(begin[first] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            arrays += [sizes, label[arcs], weight[arcs], target[arcs]]
            target, kept = state, True
        arrays.append(target)  # the state that a sequence starts in
        lengths = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.words) else np.zeros(0, np.int64)
        text = b"".join(self.words.to_pylist())
        raw = _joined([*arrays, lengths, np.frombuffer(text, np.uint8)])
        return pa.compress(raw, "zstd", asbytes=True), len(raw)

    @staticmethod
    def unpack(raw: bytes, size: int) -> Tree:
        *arrays, state, lengths, text = _split(pa.decompress(raw, size, "zstd", asbytes=True))
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())])
        layers = []
        for k in range(len(arrays) // 4 - 1, -1, -1):
            sizes, label, weight, target = (a.astype(np.int64) for a in arrays[4 * k:4 * k + 4])
            begin = np.append(0, np.cumsum(sizes))
            here = sizes[state]
            arcs = np.repeat(begin[state] - np.append(0, np.cumsum(here)[:-1]), here) + np.arange(here.sum())
            layers.append((label[arcs], weight[arcs], np.repeat(np.arange(len(state)), here)))
            state = target[arcs]
        return Tree(words, layers)


def _joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays with their lengths and least widths in front; bytes of like weight together."""
    head, body = [len(arrays)], []
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << (8 * w))
        head += [len(a), width]
        body.append(a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T.tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def _split(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 1 + 2 * n)[1:], 8 * (1 + 2 * n), []
    for size, width in head.reshape(n, 2).tolist():
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(part).view(f"<u{width}").reshape(size))
        at += size * width
    return out


def _common(trees: list[Tree]) -> tuple[pa.Array, list[np.ndarray]]:
    """One dictionary for several automata, and the new place of each one's labels."""
    words, place = dictionary(pa.concat_arrays([t.words.cast(pa.large_binary()) for t in trees]))
    cuts = np.cumsum([len(t.words) for t in trees])[:-1]
    return words, np.split(place, cuts)


def union(trees: list[Tree]) -> Tree:
    """All paths of some automata with their weights summed."""
    words, places = _common(trees)
    layers, to = [], [np.zeros(1, np.int64) for _ in trees]
    width = len(words) + 1
    for k in range(len(trees[0].layers)):
        # Paths stay apart by the merged arc before them and their own label.
        keys = [to[i][t.layers[k][2]] * width + places[i][t.layers[k][0]] if len(t.layers[k][0]) else np.zeros(0, np.int64)
                for i, t in enumerate(trees)]
        merged, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.zeros(len(merged), np.int64)
        np.add.at(weight, inverse, np.concatenate([t.layers[k][1] for t in trees]))
        layers.append((merged % width, weight, merged // width))
        to = np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])
    return Tree(words, layers)


def compose(asked: Tree, counts: Tree) -> list[np.ndarray]:
    """Per layer of ``asked``: the weight with which each of its paths leaves ``counts``,
    0 where there is no such path."""
    words, (a, c) = _common([asked, counts])
    width, out, met = len(words) + 1, [], np.zeros(1, np.int64)
    for k, (label, _, parent) in enumerate(asked.layers):
        theirs, weight, before = counts.layers[k] if k < len(counts.layers) else (np.zeros(0, np.int64),) * 3
        keys = before * width + c[theirs]  # ascending, as arcs are
        at = met[parent]
        wanted = np.where(at >= 0, at * width + a[label], -1)
        found = np.searchsorted(keys, wanted)
        hit = np.zeros(len(wanted), bool)
        inside = found < len(keys)
        hit[inside] = keys[found[inside]] == wanted[inside]
        met = np.where(hit, found, -1)
        out.append(np.where(hit, weight[np.where(hit, found, 0)] if len(weight) else 0, 0))
    return out
