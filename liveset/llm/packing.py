"""Sum-of-squares packing of tokenized documents into fixed windows.

Online: each document is placed as it arrives. ``levels[f]`` counts the open windows filled
to ``f`` tokens; a piece goes where the sum of squared counts grows least, be it a new
window or one of any fill it fits. That keeps few windows of each fill open, so most close
exactly full. Documents are placed whole; one longer than a window fills windows of its
own and leaves its remainder to be placed.

Every task packs its own part of the input, in one pass and without a shuffle. What it
holds is bounded: when ``most_open`` windows are open, and at the end of the part, their
pieces are poured in order into full windows, cut where needed. Only the last pour leaves
a tail, which goes into windows of power-of-two lengths, so no sequence is padded.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liveset.llm.tokens import encoder

WINDOW = 4096
MOST_OPEN = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Places documents of one task. Pieces leave through ``out`` as soon as they are final:
    ``(doc_id, start, ids, doc_tokens, sequence, offset)``."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first_sequence: int = 0):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.cost = np.full(window + 1, 1, np.int64)  # growth of the sum if a piece ends at this fill
        self.open: dict[int, list[list]] = {}
        self.fills: list[int] = []  # fills that have open windows, ascending
        self.n_open, self.next = 0, first_sequence
        self.out: list[tuple] = []

    def _change(self, fill: int, by: int) -> None:
        self.levels[fill] += by
        self.n_open += by
        self.cost[fill] = 2 * self.levels[fill] + 1

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close([(doc_id, start, ids[start:start + self.window], total)])
            start += self.window
        if start < total:
            self._place((doc_id, start, ids[start:], total))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        best, best_cost = 0, int(self.cost[size])  # a new window ends at ``size``
        if self.fills:
            fit = np.array(self.fills[:bisect.bisect_right(self.fills, self.window - size)], np.int64)
            if len(fit):
                # Leaving fill f lowers the sum by 2n(f)-1; a full window leaves the sum.
                after = np.where(fit + size == self.window, 0, self.cost[fit + size])
                growth = after - (2 * self.levels[fit] - 1)
                at = len(growth) - 1 - int(np.argmin(growth[::-1]))  # ties: the fullest window
                if growth[at] <= best_cost:
                    best, best_cost = int(fit[at]), int(growth[at])
        pieces = []
        if best:
            pieces = self.open[best].pop()
            self._change(best, -1)
            if not self.open[best]:
                del self.open[best]
                self.fills.remove(best)
        pieces.append(piece)
        fill = best + size
        if fill == self.window:
            self._close(pieces)
            return
        if fill not in self.open:
            self.open[fill] = []
            bisect.insort(self.fills, fill)
        self.open[fill].append(pieces)
        self._change(fill, 1)
        if self.n_open >= self.most_open:
            self.pour(last=False)

    def pour(self, last: bool) -> None:
        """Cut the open windows' pieces into full windows; the rest stays open, or goes out
        in windows of power-of-two lengths when it is the ``last`` pour."""
        queue = [p for fill in reversed(self.fills) for w in self.open[fill] for p in w]
        left = sum(len(p[2]) for p in queue)
        self.open, self.fills, self.n_open = {}, [], 0
        self.levels[:] = 0
        self.cost[:] = 1
        goal, here, filled = 0, [], 0
        at = 0
        while left and (last or left >= self.window or here):
            if not here:
                goal = min(self.window, 1 << (left.bit_length() - 1))
            doc_id, start, ids, total = queue[at]
            take = min(goal - filled, len(ids))
            here.append((doc_id, start, ids[:take], total))
            filled, left = filled + take, left - take
            if take < len(ids):
                queue[at] = (doc_id, start + take, ids[take:], total)
            else:
                at += 1
            if filled == goal:
                self._close(here)
                here, filled = [], 0
        for piece in queue[at:]:
            self._place(piece)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, most_open: int = MOST_OPEN) -> DataFrame:
    """One row per piece: ``doc_id, start`` (place in its document), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (place in
    its sequence, gapless from 0). Needs columns ``doc_id`` and ``text``; others are ignored.

    Null and empty texts hold the end id alone. Repeated rows are packed each. A null
    ``doc_id`` stays null. An empty table gives no rows. ``sequence_id`` holds the task in
    its upper bits. ``window`` should be a power of two, or the tail may hold shorter ones only.
    """

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        packer = Packer(window, most_open, TaskContext.get().partitionId() << 32)

        def emitted():
            rows, packer.out = packer.out, []
            columns = list(zip(*rows)) if rows else [[]] * 6
            doc_id, start, ids, total, sequence, offset = columns
            ids = [np.ascontiguousarray(x, "<u4") for x in ids]
            return pa.RecordBatch.from_arrays([
                pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
                pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=ARROW)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for begin in range(0, len(texts), 2048):
                for k, ids in enumerate(encode.encode_many(texts.slice(begin, 2048)), begin):
                    packer.add(ids_of[k], np.append(ids, np.uint32(end_id)))
                if packer.out:
                    yield emitted()
        packer.pour(last=True)
        if packer.out:
            yield emitted()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
