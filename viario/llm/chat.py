"""Chat formatting: conversations as one text each, its tokens, and which of them are trained on.

A turn is written as `### role: text</turn>` and a line break. A backslash, `###` and
`</turn>` inside a text, and `:` too inside a role, get a backslash before them, so the
conversation can be read back. The whole text is encoded once; a token is under the loss
mask if its span of characters meets a span of the trained role, found by binary search in
the sorted spans.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_MARK = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n|: ")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and where in it each turn's own text lies."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, _CONTROL_IN_ROLE)}: ", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at = spans[-1][1] + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role, start = None, at + len(OPEN)
        for mark in _MARK.finditer(formatted, start):
            if role is None and mark[0] == ": ":
                role, start = unescape(formatted[start:mark.start()]), mark.end()
            elif mark[0] == CLOSE:
                turns.append((role, unescape(formatted[start:mark.start()])))
                at = mark.end()
                break
    return turns


def masked_text(formatted: str, spans: list[tuple[int, int]], starts, stops, mask) -> str:
    """The text under the mask: each span's characters that masked tokens cover, unescaped."""
    ends = [b for _, b in spans]
    taken: list[list[str]] = [[] for _ in spans]
    at, i = 0, 0
    for a, b, on in zip(starts, stops, mask):
        if on:
            i = bisect_right(ends, a, i)
            for j in range(i, len(spans)):
                low, high = max(a, at, spans[j][0]), min(b, spans[j][1])  # parts of one character share its place
                if spans[j][0] >= b:
                    break
                if low < high:
                    taken[j].append(formatted[low:high])
            at = max(at, b)
    return "".join(unescape("".join(own)) for own in taken)


def loss_mask(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted, disjoint spans."""
    spans = [s for s in spans if s[0] < s[1]]
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    first, last = np.array(spans).T
    at = np.searchsorted(last, starts, side="right")
    return (at < len(spans)) & (first[np.minimum(at, len(spans) - 1)] < stops) & (starts < stops)


def format_conversations(conversations: DataFrame, tokenizer_json: str, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, token_ids, token_starts, token_stops, loss_mask and spans of the trained role.

    `tokenizer_json` is the content of a tokenizer file; it travels with the tasks. Rows are
    taken in the order of turn (nulls first), ties by role and text; repeated rows are turns of
    their own. Null roles and texts are empty, rows without conv_id are one conversation.
    Positions count characters. A conversation is one text and so one task's work; others are
    spread by conv_id. An empty table gives no rows.
    """
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = ordered.select("conv_id").schema.add("n_turns", "long").add("formatted", "string")
    for name in ("token_ids", "token_starts", "token_stops"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    span = T.StructType().add("start", "integer").add("stop", "integer")
    schema = schema.add("loss_mask", T.ArrayType(T.BooleanType())).add("spans", T.ArrayType(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(tokenizer_json)
        coder.encode_special_tokens = True
        names = [f.name for f in schema.fields]
        key_type = None

        def made(groups: list[tuple]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for key, turns in groups:
                formatted, spans = render(turns)
                own = [s for s, (who, _) in zip(spans, turns) if who == trained_role]
                code = coder.encode(formatted, add_special_tokens=False)
                offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
                mask = loss_mask(offsets[:, 0], offsets[:, 1], own)
                row = (key, len(turns), formatted, code.ids, offsets[:, 0], offsets[:, 1], mask,
                       [{"start": a, "stop": b} for a, b in own])
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [key_type, pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()),
                     pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        key, turns, groups, chars = None, None, [], 0
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for k, who, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns is None or k != key:
                    if turns is not None:
                        groups.append((key, turns))
                        if chars > 4_000_000:
                            yield made(groups)
                            groups, chars = [], 0
                    key, turns = k, []
                turns.append((who, said))
                chars += len(said)
        if turns is not None:
            yield made([*groups, (key, turns)])

    return ordered.mapInArrow(run, schema)
