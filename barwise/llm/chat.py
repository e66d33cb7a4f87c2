"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once, with offsets; the mask of the assistant's turns is the
intersection of the sorted turn spans with the sorted token spans, found by binary search. Markers are
special tokens, which the encoder never merges with what stands beside them, so the spans' ends are token
ends and a very long conversation can be encoded in pieces between turns without any change of the tokens.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import vocabulary_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text must never contain as such: this template's, the vocabulary's, and other templates'.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RENDERED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """A backslash after a control string's first character, and in front of every backslash."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}" for role, text in turns)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in `formatted`."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _RENDERED.finditer(formatted)]


@lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    encoder = Tokenizer.from_file(path)
    encoder.post_processor = processors.ByteLevel(trim_offsets=False)
    encoder.add_special_tokens([AddedToken(marker, special=True, normalized=False) for marker in (TURN, TEXT, END)])
    return encoder


def masked(formatted: str, spans: list[tuple[int, int]], path: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """(token ids, loss mask, the spans that the masked tokens cover); `spans` are sorted and disjoint."""
    encoded = _encoder(path).encode(formatted, add_special_tokens=False)
    starts, ends = [o[0] for o in encoded.offsets], [o[1] for o in encoded.offsets]
    mask, covered = [0] * len(encoded.ids), []
    for start, end in spans:
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        if start < end and first < last:
            mask[first:last] = [1] * (last - first)
            covered.append((starts[first], ends[last - 1]))
    return encoded.ids, mask, covered


def _ordered(conversations: DataFrame) -> DataFrame:
    """One conversation's rows together and by turn; rows of one turn by role and text."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _pieces(batches, most_chars: int):
    """(conv_id, [(role, text)], whether the conversation ends here) from sorted rows, in bounded pieces."""
    conv, turns, chars, begun = None, [], 0, False
    for batch in batches:
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if begun and c != conv:
                yield conv, turns, True
                turns, chars = [], 0
            elif chars > most_chars:
                yield conv, turns, False
                turns, chars = [], 0
            conv, begun = c, True
            turns.append((role, text))
            chars += len(text)
    if begun:
        yield conv, turns, True


def format_conversations(conversations: DataFrame, trained_role: str = "assistant", tokenizer_path: str | None = None, piece_chars: int = 4_000_000) -> DataFrame:
    """(conv_id, piece, formatted, ids, loss_mask): the training rows. Conversations over `piece_chars` give several pieces."""
    path = tokenizer_path or vocabulary_path("byte_bpe_50k.json")

    def encoded(batches):
        piece = 0
        for conv, turns, last in _pieces(batches, piece_chars):
            formatted = render(turns)
            ids, mask, _ = masked(formatted, [(s, e) for role, _, s, e in read_back(formatted) if role == trained_role], path)
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([piece], pa.int32()), pa.array([formatted]), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int32()))], names=["conv_id", "piece", "formatted", "ids", "loss_mask"])
            piece = 0 if last else piece + 1

    return _ordered(conversations).mapInArrow(encoded, "conv_id long, piece int, formatted string, ids array<int>, loss_mask array<int>")


def conversation_digests(conversations: DataFrame, trained_role: str = "assistant", tokenizer_path: str | None = None, piece_chars: int = 4_000_000) -> DataFrame:
    """What the formatted output says when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.

    Null roles and texts count as empty; rows of a null conv_id form one conversation. An empty table gives no rows.
    """
    path = tokenizer_path or vocabulary_path("byte_bpe_50k.json")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def digests(batches):
        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]

        state, rows = fresh(), []
        for conv, turns, last in _pieces(batches, piece_chars):
            formatted = render(turns)
            read = read_back(formatted)
            ids, mask, covered = masked(formatted, [(s, e) for role, _, s, e in read if role == trained_role], path)
            state[0] += len(read)
            for role, text, _, _ in read:
                state[1].update(f"{role}\n{text}\n".encode())
            for start, end in covered:
                text = unescape(formatted[start:end])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += len(ids)
            state[6] += sum(mask)
            if last:
                rows.append((conv, *(x if isinstance(x, int) else x.hexdigest() for x in state)))
                state = fresh()
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if not isinstance(x[0], str) else None) for x in zip(*rows)], names=names)

    return _ordered(conversations).mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
