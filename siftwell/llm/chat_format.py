"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once as one string, encoded once with character offsets, and its
assistant spans are intersected with the (sorted) token spans by binary search.

Template
    ``<|im_start|>{role}\\n{text}<|im_end|>\\n`` for every turn.  Inside roles and texts a
    backslash doubles and ``<|`` becomes ``<\\|``, so no control string can appear; in roles
    a newline becomes backslash + n.  ``unescape`` undoes this exactly.

Defined cases
    null text or role: empty string.  null conv_id: the rows with a null id form one
    conversation.  Ties and repeated rows: turns are ordered by turn (null first), then role,
    then text; repeated rows are turns of their own.  Empty table: no rows.  Extra columns are
    ignored.  Very long conversations stream through one task; memory holds one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the sorted (start, end) spans of assistant texts in it."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Per token the number of the span that it meets, or -1; both inputs are sorted.

    A token is in a span's loss if it shares a character with it.  Starts and ends of token
    offsets both ascend, so each span's tokens are one range found by two binary searches.
    """
    mask = np.full(len(offsets), -1, np.int32)
    if len(offsets):
        low = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
        high = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
        for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            if spans[i, 1] > spans[i, 0]:
                mask[a:b] = i
    return mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_loss(formatted: str, offsets: np.ndarray, spans: np.ndarray, mask: np.ndarray) -> str:
    """The text under the loss mask: masked tokens' characters clipped to their span, each once."""
    out = []
    picked = np.flatnonzero(mask >= 0)
    if len(picked):
        which = mask[picked]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        last = np.r_[first[1:], len(which)] - 1
        for i, a, b in zip(which[first].tolist(), picked[first].tolist(), picked[last].tolist(), strict=True):
            start, end = max(int(offsets[a, 0]), int(spans[i, 0])), min(int(offsets[b, 1]), int(spans[i, 1]))
            out.append(unescape(formatted[start:end]))
    return "".join(out)


_SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<int>, span_starts array<int>, span_ends array<int>"


def format_conversations(conversations: DataFrame, tokenizer_path: str, partitions: int | None = None) -> DataFrame:
    """One row per conversation: formatted text, token ids with offsets, and the loss mask.

    Rows are hash-partitioned by conversation and sorted in the partition, so the Python side
    streams; no group is handed over as a whole frame.
    """
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True

        def flush(held):
            texts, spans = zip(*(render(t) for _, t in held), strict=True)
            codes = tokenizer.encode_batch(list(texts), add_special_tokens=False)
            out = {k: [] for k in ("conv_id", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask", "span_starts", "span_ends")}
            for (conv, turns), text, span, code in zip(held, texts, spans, codes, strict=True):
                offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets, span)
                for k, v in (("conv_id", conv), ("n_turns", len(turns)), ("formatted", text), ("token_ids", code.ids), ("token_starts", offsets[:, 0]), ("token_ends", offsets[:, 1]), ("loss_mask", mask), ("span_starts", span[:, 0]), ("span_ends", span[:, 1])):
                    out[k].append(v)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["conv_id"], pa.int64()), pa.array(out["n_turns"], pa.int64()), pa.array(out["formatted"], pa.string()), *(pa.array([np.asarray(x, np.int32) for x in out[k]], lists) for k in list(out)[3:])],
                names=list(out),
            )

        held, size, current, turns, begun = [], 0, None, [], False
        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if begun and conv != current:
                    held.append((current, turns))
                    turns = []
                    if size > 1 << 20:
                        yield from flush(held)
                        held, size = [], 0
                current, begun = conv, True
                turns.append((role, text))
                size += len(text)
        if begun:
            held.append((current, turns))
            yield from flush(held)

    return rows.mapInArrow(run, _SCHEMA)


def digest_output(formatted: DataFrame) -> DataFrame:
    """Read turns and loss text back from the operator's output and digest them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            rows = []
            for i in range(batch.num_rows):
                text = cols["formatted"][i].as_py()
                arrays = {k: np.asarray(cols[k][i].values) for k in ("token_starts", "token_ends", "loss_mask", "span_starts", "span_ends")}
                turns = read_turns(text)
                loss = read_loss(text, np.stack([arrays["token_starts"], arrays["token_ends"]], 1), np.stack([arrays["span_starts"], arrays["span_ends"]], 1), arrays["loss_mask"])
                rows.append((cols["conv_id"][i].as_py(), len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            a = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
