import hashlib
import random

import pyarrow as pa
import pytest
from plain import prose

from parcelflow.llm.op5_chat_format import escape, format_conversations, read_back, read_turns, render, unescape

ROWS = "conv_id long, turn long, role string, text string"


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\>a") for _ in range(rng.randrange(12)))
        assert unescape(escape(t)) == t and "<|" not in escape(t)
    for t in ("<|turn|>", "<|done|><|says|>", "<\\|done|>", "</s>[INST] ok [/INST]"):
        turns = [("user", t), ("<|says|>", t), ("assistant", "")]
        assert read_turns(render(turns)[0]) == turns


def _conversations():
    rng = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", prose(rng, rng.randrange(0, 30))) for c in range(12) for t in range(rng.randrange(1, 7))]
    rows += [(50, t, "assistant", f" lead {t}\n\n") for t in range(700)]
    rows += [(60, 0, "user", None), (60, 1, "assistant", None), (61, 0, None, "x"), (61, None, "assistant", "first"), (62, 0, "assistant", "<|done|>!<\\|"),
             (63, 1, "assistant", "b"), (63, 1, "assistant", "a"), (63, 1, "assistant", "a"), (None, 0, "assistant", "null id"), (None, 1, "user", "y"),
             (64, 0, "assistant", "\n\n é日本‍👩‍👩‍👧 ́ \x1c<|endoftext|>  "), (64, 1, "assistant", "'s 12 ?!"), (65, 0, "assistant", "z" * 60_000),
             (66, 0, "Assistant", "other role")]
    return rows


@pytest.mark.parametrize("batch_chars", [1, 1 << 20])
def test_read_back_equals_input(spark, batch_chars):
    rows = _conversations()
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r["conv_id"]: r for r in read_back(format_conversations(frame, batch_chars=batch_chars)).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(render(turns)[0]))


def test_masks_follow_turns(spark):
    r = format_conversations(spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", " hello!"), (1, 2, "user", "x"), (1, 3, "assistant", "")], ROWS)).collect()[0]
    under = [r["formatted"][s:e] for s, e, m in zip(r["token_starts"], r["token_ends"], r["loss_mask"], strict=True) if m]
    assert "".join(under) == " hello!" and len(r["input_ids"]) == len(r["loss_mask"])
    assert "".join(r["formatted"][s:e] for s, e in zip(r["token_starts"], r["token_ends"], strict=True)) == r["formatted"]


def test_empty_table_and_more_columns(spark):
    assert read_back(format_conversations(spark.createDataFrame([], ROWS))).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "a", "mine", 3)], ROWS + ", formatted string, n_turns int")
    assert format_conversations(more).collect()[0]["n_turns"] == 1


def test_one_encoding_is_held_at_a_time(monkeypatch):
    """A batch's encodings are not all alive together."""
    import public_tokenizers
    from parcelflow.llm import op5_chat_format as op5

    real, calls = op5.tokenizer(public_tokenizers.path("byte_bpe_50k.json")), []

    class Single:
        def encode(self, text, **kwargs):
            calls.append(text)
            return real.encode(text, **kwargs)

    monkeypatch.setattr(op5, "once", lambda key, make: Single())
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1, 2], "role": ["user", "assistant", "user"], "text": ["a b", "c", ""]})
    rows = [r for b in op5._formatted("any", "assistant", 1 << 20)(iter([batch])) for r in b.to_pylist()]
    assert [r["formatted"] for r in rows] == calls and [r["n_turns"] for r in rows] == [2, 1]
    assert sum(rows[0]["loss_mask"]) == 1 and not any(rows[1]["loss_mask"])
