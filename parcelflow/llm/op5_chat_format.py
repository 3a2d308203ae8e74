"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole::

    <|turn|>role<|says|>text<|done|>   for each turn

and encoded once with character offsets.  The four control strings are added to the tokenizer as whole
tokens, so a turn's text starts and ends at a token's edge.  Turn spans and token spans are both sorted;
binary search of the spans' ends in the token offsets gives the tokens of each assistant text, which are the loss mask.

Inside roles and texts ``<|`` is written ``<\\|``, and an existing ``<\\...\\|`` gets one more backslash, so
texts cannot hold a control string and reading is exact.

Turns are sorted by (conv_id, turn, role, text) inside a partition by conversation and streamed; a
task holds one conversation at a time, whatever the number of turns of the others.

Nulls and odd rows: null text and null role are empty; rows with a null conv_id form one conversation; a null
turn comes first; equal turns are ordered by role, then text, and all of them stay; an empty
table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.registry import query, table
from parcelflow.llm.worker import once

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
_CONTROL = regex.compile(r"<(\\*)\|")
_WRITTEN = regex.compile(r"<\\(\\*)\|")
_FORMATTED = regex.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|done\|>", regex.DOTALL)
_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("token_starts", T.ArrayType(T.IntegerType())),
    T.StructField("token_ends", T.ArrayType(T.IntegerType())),
    T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
])


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) of the texts under the loss, in characters."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        start = at + len(head)
        if role == loss_role:
            spans.append((start, start + len(body)))
        parts += [head, body, DONE]
        at = start + len(body) + len(DONE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _FORMATTED.findall(formatted)]


def tokenizer(path: str):
    """The tokenizer with the control strings as tokens and offsets that leave no character out."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    out = Tokenizer.from_file(path)
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    out.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, SAYS, DONE)])
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the sorted token spans lie in the sorted text spans."""
    edges = np.zeros(len(starts) + 1, dtype=np.int64)
    a, b = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    full = a < b  # an empty text has no token
    np.add.at(edges, np.searchsorted(ends, a[full], side="right"), 1)
    np.add.at(edges, np.searchsorted(starts, b[full], side="left"), -1)
    return np.cumsum(edges[:-1]) > 0


def _conversations(batches):
    """Complete conversations from sorted rows: (conv_id, turns)."""
    now, turns = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns, strict=True):
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def _formatted(path: str, loss_role: str, batch_chars: int):
    def rows(held, tok):
        out = []
        for conv, turns in held:
            text, spans = render(turns, loss_role)
            # one encoding at a time: a batch of them, made by threads of its own, takes far more memory than its ids
            enc = tok.encode(text, add_special_tokens=False)
            starts, ends = np.fromiter(chain.from_iterable(enc.offsets), dtype=np.int32, count=2 * len(enc)).reshape(-1, 2).T
            out.append({"conv_id": conv, "n_turns": len(turns), "formatted": text, "input_ids": np.array(enc.ids, dtype=np.int32), "token_starts": starts,
                        "token_ends": ends, "loss_mask": loss_mask(starts, ends, spans)})
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], kind) for f, kind in zip(_SCHEMA, kinds, strict=True)], [f.name for f in _SCHEMA])

    def run(batches):
        tok, held, size = once(("chat", path), lambda: tokenizer(path)), [], 0
        for conv, turns in _conversations(batches):
            held.append((conv, turns))
            size += sum(len(t) for _, t in turns)
            if size >= batch_chars:
                yield rows(held, tok)
                held, size = [], 0
        if held:
            yield rows(held, tok)

    return run


def format_conversations(conversations: DataFrame, *, tokenizer_path: str | None = None, loss_role: str = "assistant",
                         batch_chars: int = 1 << 20) -> DataFrame:
    """One row a conversation: formatted text, token ids and offsets, and the loss mask by token."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_formatted(path, loss_role, batch_chars), _SCHEMA))


def _under(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[list[int], list[int]]:
    """The stretches of characters that the masked tokens cover."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return [], []
    # several tokens may share the bytes of one character
    new = np.concatenate(([True], s[1:] > np.maximum.accumulate(e)[:-1]))
    head = np.flatnonzero(new)
    return s[head].tolist(), np.maximum.reduceat(e, head).tolist()


def _digests(batches):
    """What a reader finds in the formatted output."""
    for batch in batches:
        lists = [batch.column(c) for c in ("token_starts", "token_ends", "loss_mask")]
        bounds = lists[0].offsets.to_numpy()
        bounds = bounds - bounds[0]
        starts, ends, mask = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        out = []
        for i, (conv, formatted) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
            turns = read_turns(formatted)
            part = slice(bounds[i], bounds[i + 1])
            loss = "".join(unescape(formatted[s:e]) for s, e in zip(*_under(starts[part], ends[part], mask[part]), strict=True))
            out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from the formatted output alone."""
    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op5_chat_format", ORACLE)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_conversations(conversations.unionByName(more)))
