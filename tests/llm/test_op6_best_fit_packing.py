import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plain import DOCUMENTS, odd_documents
from tokenizers import Tokenizer

from parcelflow.llm.op6_best_fit_packing import best_fit_packing, cut, pack, plan, tokenised_pieces


def _filled(layouts):
    """The (offset, length) of each sequence."""
    out = {}
    for length, _, first, count, offset in layouts.places:
        for s in range(first, first + count):
            out.setdefault(s, []).append((offset, length))
    return out


@pytest.mark.parametrize("capacity", [12, 64, 2048])
def test_plans(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [min(capacity, 1 + int(rng.lognormvariate(0, 1.2) * capacity / 5)) for _ in range(rng.randrange(200))]
        counts = {x: lengths.count(x) for x in lengths}
        layouts = plan(counts, capacity)
        filled = _filled(layouts)
        assert len(filled) == layouts.sequences
        placed = [x for s in filled.values() for _, x in s]
        assert sorted(placed) == sorted(lengths)
        for s in filled.values():
            ends = 0
            for offset, length in sorted(s):
                assert offset == ends
                ends += length
            assert ends <= capacity and sum(x > capacity // 3 for _, x in s) <= 2
        # first-fit decreasing is the yardstick
        bins = []
        for x in sorted(lengths, reverse=True):
            for b in bins:
                if sum(b) + x <= capacity:
                    b.append(x)
                    break
            else:
                bins.append([x])
        assert layouts.sequences <= 1.1 * len(bins) + 1


def test_cut():
    for n in (1, 7, 8, 9, 16, 17, 100):
        pieces = cut(n, 8)
        assert sum(x for _, x in pieces) == n and all(x == 8 for _, x in pieces[1:]) and [s for s, _ in pieces] == list(np.cumsum([0, *(x for _, x in pieces)])[:-1])


@pytest.mark.parametrize("capacity", [32, 2048])
def test_round_trip(spark, capacity):
    rows = odd_documents()
    got = best_fit_packing(spark.createDataFrame(rows, DOCUMENTS), capacity=capacity).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(d, []).append(ids)
    texts, sequences = {}, {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        texts.setdefault((r["doc_id"]), []).append((r["piece"], r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, ids in want.items():
        assert sorted(x for _, _, part in texts[d] for x in part) == sorted(x for part in ids for x in part)
        if len(ids) == 1:
            assert [x for _, _, part in sorted(texts[d]) for x in part] == ids[0]
    for s in sequences.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= capacity
    total = sum(len(x) for ids in want.values() for x in ids)
    assert len(sequences) <= total / capacity * 1.15 + 2


def test_hot_length_and_empty(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "CAST(if(id % 3 = 0, 5, 10) AS BIGINT) AS length")
    got = pack(pieces, capacity=20, salts=7).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5000 and len({r["sequence_id"] for r in got}) == -(-(1667 * 5 + 3333 * 10) // 20)
    assert best_fit_packing(spark.createDataFrame([], DOCUMENTS)).count() == 0
    clash = best_fit_packing(spark.createDataFrame([(1, "a b", "en", "s", 3, -1)], DOCUMENTS + ", piece int")).collect()
    assert [(r["doc_id"], r["lang"], r["piece"], r["length"]) for r in clash] == [(1, "en", 0, 3)]


def test_added_tokens_are_single_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext", "don't<|endoftext|>'t stop <|endoftext|", "É  <|endoftext|>  日本",
             " " * 1_000_000 + "x", "y" + "\n" * 1_000_000 + "<|endoftext|>" + "z" * 300_000]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=2_000_000).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got and 50256 in {x for r in got for x in r["ids"]}


def test_ids_travel_as_bytes(spark):
    """Batches of lists of numbers took executors past their memory; the pieces hold bytes up to the last step."""
    docs = spark.createDataFrame(odd_documents(), DOCUMENTS)
    pieces = tokenised_pieces(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    assert dict(pieces.dtypes)["ids"] == "binary"
    sent = {(r["ids_crc32"], bytes(r["ids"])) for r in pieces.collect()}
    got = pack(pieces, packed="ids")
    assert dict(got.dtypes)["ids"] == "array<int>" and "ids" in got.columns
    assert {(r["ids_crc32"], np.array(r["ids"], "<i4").tobytes()) for r in got.collect()} == sent
