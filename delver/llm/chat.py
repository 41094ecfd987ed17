"""Chat formatting with offset-aligned loss masks.

Template: every turn is <|turn|>role<|say|>text<|end|>, nothing between turns. The three markers are added
tokens, so an encoding never straddles them. In roles and texts, `<`, any backslashes and `|` in a row get
one more backslash before the bar; that undoes exactly, and leaves no control string (those of the template
or the vocabulary, all of which begin with `<|`) in escaped text.

A whole conversation is rendered, then encoded once with offsets. Assistant texts are spans of characters;
their first and last token are found by binary search in the token starts and ends.

Rows of a conversation are ordered by turn, ties by role and text; repeated rows are turns of their own. A
null role or text is empty, a null turn comes first, rows without a conv_id form one conversation. An empty
table gives an empty table. Extra columns are ignored. One conversation is one training sequence and has to
fit in a task; rows stream through the task in order, so nothing else does.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
TOKENIZER = os.environ.get("DELVER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
SCHEMA = "conv_id long, formatted string, input_ids array<int>, loss_spans array<array<int>>"
_ESC, _UNESC = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_READ = re.compile(r"<\|turn\|>(.*?)<\|say\|>(.*?)<\|end\|>", re.S)
_loaded: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESC.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(r"<\1|", text)


def tokenizer(path: str):  # noqa: ANN201
    """The byte-level tokenizer at path with the markers added; offsets keep white space."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers, processors

        t = Tokenizer.from_file(path)
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([TURN, SAY, END])
        _loaded[path] = t
    return _loaded[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, sorted character spans of the assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAY}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[list[int]]:
    """Token ranges [first, end) of character spans."""
    if not spans or not offsets:
        return []
    o = np.asarray(offsets)
    s = np.asarray(spans)
    first = np.searchsorted(o[:, 1], s[:, 0], "right")  # the first token that ends after the span's start
    end = np.searchsorted(o[:, 0], s[:, 1], "left")  # the tokens that start before the span's end
    return np.stack((first, end), 1).tolist()


def read(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv != now:
                yield now, turns
                turns = []
            now, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield now, turns


def format_conversations(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per conversation of rows(conv_id, turn, role, text): conv_id, formatted, input_ids, loss_spans (token ranges)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        held: list[tuple[int | None, str, list[tuple[int, int]]]] = []

        def out() -> pa.RecordBatch:
            encoded = t.encode_batch([h[1] for h in held], add_special_tokens=False)
            cols = [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([h[1] for h in held], pa.string()),
                pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                pa.array([align(e.offsets, h[2]) for e, h in zip(encoded, held, strict=True)], pa.list_(pa.list_(pa.int32()))),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "input_ids", "loss_spans"])

        for conv, turns in _conversations(batches):
            held.append((conv, *render(turns)))
            if len(held) == 64 or sum(len(h[1]) for h in held) > 2_000_000:
                yield out()
        if held:
            yield out()

    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """What can be read back from the output: turns from the text, loss texts from the masked tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            rows = []
            for conv, text, ids, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read(text)
                whole = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode())
                loss = "".join(unescape(t.decode(ids[a:b], skip_special_tokens=False)) for a, b in spans)
                rows.append((conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(ids), sum(b - a for a, b in spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(extra))).drop("n_tokens", "n_loss_tokens")
