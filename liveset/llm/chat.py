"""Conversations as training sequences with a loss mask aligned by offsets.

A turn is rendered as ``<|role|>`` role ``<|text|>`` text ``<|end|>``. The three markers are
tokens of their own, so no token reaches across one. Where a role or text itself holds a
marker (or the vocabulary's end token) one backslash more is put before its first bar,
which is undone by taking one away: reversible, and nothing else is changed.

A rendered conversation is encoded once, with offsets. Its token spans and the spans of
the assistant's texts are both sorted, so the tokens of a text are found by two binary
searches. A conversation beyond ``MOST_TURNS`` or ``MOST_CHARS`` is cut between turns into
segments; as markers part tokens, the ids are the same as of the whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveset.llm.common import partitions

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
HELD = r"(role|text|end|endoftext)"
ESCAPED_FROM, ESCAPED_TO = re.compile(r"<(\\*)\|" + HELD + r"\|>"), r"<\1\\|\2|>"
PLAIN_FROM, PLAIN_TO = re.compile(r"<(\\*)\\\|" + HELD + r"\|>"), r"<\1|\2|>"
TURN = re.compile(re.escape(ROLE) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
MOST_TURNS, MOST_CHARS = 1024, 1 << 20
SEGMENTS = "conv_id long, segment long, n_turns long, text string, ids array<int>, mask array<boolean>"
LEARNED = "assistant"


def escape(text: str) -> str:
    return ESCAPED_FROM.sub(ESCAPED_TO, text)


def unescape(text: str) -> str:
    return PLAIN_FROM.sub(PLAIN_TO, text)


def tokenizer_of(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (ROLE, TEXT, END)])
    return tokenizer


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text, and the spans (code points) of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def aligned(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted spans ``offsets``) reach into one of the sorted ``spans``."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    turn = np.zeros(len(offsets) + 1, np.int64)
    np.add.at(turn, first, 1)
    np.add.at(turn, np.maximum(last, first), -1)
    return np.cumsum(turn)[:-1] > 0


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per segment of a conversation: ``conv_id, segment`` (ascending in its order),
    ``n_turns, text, ids, mask`` (true on tokens of the assistant's texts).

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. Rows are ordered
    by turn, then role and text, nulls first; null roles and texts are empty ones; repeated
    rows are turns each. Rows with a null ``conv_id`` form one conversation. An empty table
    gives no rows. Parts are ranges of (conversation, turn), so a conversation of any length
    is spread over tasks.
    """

    def run(batches):
        from pyspark import TaskContext

        encode = tokenizer_of(tokenizer)
        number = TaskContext.get().partitionId() << 32
        conv, held, chars, done = None, [], 0, []

        def closed():
            nonlocal held, chars, number
            if held:
                text, spans = render(held)
                e = encode.encode(text, add_special_tokens=False)
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                done.append((conv, number, len(held), text, np.array(e.ids, np.int32), aligned(offsets, spans)))
                held, chars, number = [], 0, number + 1

        def taken():
            rows = list(zip(*done))
            done.clear()
            lists = lambda x: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)), pa.array(np.concatenate(x)))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), lists(rows[4]), lists(rows[5])],
                names=["conv_id", "segment", "n_turns", "text", "ids", "mask"])

        for b in batches:
            for c, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if held and (c != conv or len(held) >= MOST_TURNS or chars >= MOST_CHARS):
                    closed()
                    if len(done) >= 200:
                        yield taken()
                conv = c
                held.append((role or "", text or ""))
                chars += len(text or "")
            if done:
                yield taken()
        closed()
        if done:
            yield taken()

    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # Beginnings follow the same order as whole texts, and keep the ranges' bounds small.
    begins = [F.substring("role", 1, 64), F.when(F.length("role") <= 64, F.substring("text", 1, 64))]
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", "turn", *begins)
    return ranged.sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame, tokenizer: str) -> DataFrame:
    """What a written table of segments holds, conversation by conversation: ``conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Turns are parsed from
    the formatted text, the learned text is decoded from the ids under the mask. A digest is
    sequential; segments stream through it one at a time."""

    def run(batches):
        decode, conv, state, out = tokenizer_of(tokenizer), None, None, []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}

        def closed():
            if state is not None:
                out.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        for b in batches:
            for k in range(b.num_rows):
                c, text = b.column("conv_id")[k].as_py(), b.column("text")[k].as_py()
                if state is None or c != conv:
                    closed()
                    conv, state = c, fresh()
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                ids = b.column("ids")[k].values.to_numpy()
                mask = b.column("mask")[k].values.to_numpy(zero_copy_only=False).astype(np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                for lo, hi in zip(edge[::2], edge[1::2]):
                    said = unescape(decode.decode(ids[lo:hi].tolist(), skip_special_tokens=False))
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["formatted"] += len(text)
            if len(out) >= 5000:
                yield taken(out)
        closed()
        if out:
            yield taken(out)

    def taken(out):
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "text", "ids", "mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
