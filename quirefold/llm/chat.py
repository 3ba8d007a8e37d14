"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the tokens under the loss mask are found by binary search of
their offsets among the sorted spans of the assistant's texts. Control strings are tokens of their own at each turn's start, so
a long conversation is rendered in pieces of whole turns, with the same tokens as in one piece and in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURNS, CHARS = 64, 1 << 20  # of a piece; a longer text is a piece of its own
FORMATTED = "conv_id long, piece long, part long, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    """A text in which no control string can begin: of the bars after a `<` there is one more."""
    return re.sub(r"<(\|+)", r"<|\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the sorted spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def load_tokenizer(source: str):
    """A tokenizer from the text of its file, with the control strings as tokens and offsets that cover every character."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(source)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie inside a span, by binary search among the sorted spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = (np.array(x) for x in zip(*spans, strict=True))
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (ends <= last[np.maximum(at, 0)]) & (ends > starts)


def encode(tokenizer, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text, spans = render(turns)
    e = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
    return text, np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1], loss_mask(offsets[:, 0], offsets[:, 1], spans)


def _format(batches: Iterator[pa.RecordBatch], source) -> Iterator[pa.RecordBatch]:
    tokenizer = load_tokenizer(source.value)
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
    key, part, turns, chars, rows, held = None, 0, [], 0, [], 0

    def flush() -> None:
        nonlocal turns, chars, part, held
        if turns:
            rows.append((*key, part, *encode(tokenizer, turns)))
            held += chars
        turns, chars, part = [], 0, part + 1

    def ready() -> Iterator[pa.RecordBatch]:
        nonlocal rows, held
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, held = [], 0

    for batch in batches:
        for conv, piece, role, text in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
            text, role = text or "", role or ""
            if (conv, piece) != key:
                flush()
                key, part = (conv, piece), 0
            elif turns and (len(turns) >= TURNS or chars + len(text) > CHARS):
                flush()
            turns.append((role, text))
            chars += len(text)
            if held > CHARS:
                yield from ready()
    flush()
    yield from ready()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, any_yet, rows = None, False, []
    n = loss_chars = total = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def close() -> None:
        if any_yet:
            rows.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total))

    def out() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        conv_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (conv, text) in enumerate(zip(conv_ids, texts, strict=True)):
            if not any_yet or conv != key:
                close()
                key, any_yet = conv, True
                n = loss_chars = total = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            total += len(text)
            for role, body in _TURN.findall(text):
                n += 1
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            mask = np.array(batch.column(4)[i].values.to_numpy(zero_copy_only=False), bool)
            first = batch.column(2)[i].values.to_numpy()[mask]
            last = batch.column(3)[i].values.to_numpy()[mask]
            if len(first):
                # tokens of one character share its offsets; spans end where the next token begins later than all before have ended
                reach = np.maximum.accumulate(last)
                breaks = np.flatnonzero(first[1:] > reach[:-1]) + 1
                for a, b in zip(first[np.r_[0, breaks]], reach[np.r_[breaks - 1, len(last) - 1]], strict=True):
                    plain = unescape(text[a:b])
                    loss_chars += len(plain)
                    loss.update(plain.encode())
        if len(rows) > 1000:
            yield out()
            rows = []
    close()
    if rows:
        yield out()


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (conv_id, piece, part, formatted, token_ids, starts, ends, loss): each conversation's text and tokens in pieces.

    Turns go by turn, then role and text; null roles and texts count as empty; repeated rows are turns of their own; rows
    with a null conv_id form one conversation, a null turn comes first. Other columns are ignored. The pieces of a
    conversation joined by (piece, part) are the whole conversation. The driver reads the tokenizer's file, a few MB.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = conversations.sparkSession.sparkContext.broadcast(f.read())
    piece = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), piece.alias("piece"), "role", "text", "turn")
    rows = rows.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role", "text")
    return rows.mapInArrow(partial(_format, source=source), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted pieces: the digests of its turns and of the text under its loss mask.

    A digest of a whole conversation is one sequence, so its pieces pass one task in order; they are read one after another.
    """
    rows = formatted.select("conv_id", "formatted", "starts", "ends", "loss", "piece", "part")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part").mapInArrow(_digest, DIGESTS)
