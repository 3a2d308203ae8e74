import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import DOCUMENTS, odd_documents, ordered
from tokenizers import Tokenizer

from parcelflow.llm.byte_bpe import plain_encoder, read_ranks
from parcelflow.llm.op11_tokenizer_alignment import align_tokenizers, op11_tokenizer_alignment, terminals

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters():
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, _byte_letters(), sentencepiece.SentencePieceProcessor(model_file=B)


def _piece(piece):
    return bytes([int(piece[3:5], 16)]) if piece[:3] == "<0x" and len(piece) == 6 else piece.replace("▁", " ").encode()


def _plain(rows, tools):
    """The rows of the definition, from a's own tokenizer and one token after the other."""
    a, letters, b = tools
    docs = []
    for doc_id, text, *_ in rows:
        one, two = [], []
        if text:
            coded = a.encode(" " + text, add_special_tokens=False)
            one = [(i, bytes(letters[c] for c in t)) for i, t in zip(coded.ids, coded.tokens, strict=True)]
            two = [(i, _piece(b.id_to_piece(i))) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
                one, two = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (one, two)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, start = [], [], 0
        for end in common:
            in_group = [[i for (i, _), e in zip(side, at, strict=True) if start < e <= end] for side, at in zip((one, two), ends, strict=True)]
            groups.append("|".join(",".join(map(str, ids)) for ids in in_group))
            links.append((in_group[0][-1], in_group[1][-1]))
            start = end
        docs.append((doc_id, len(one), len(two), groups, links))
    counts = Counter(x for d in docs for x in d[4])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return ordered((d, n, m, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for d, n, m, g, k in docs)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [(400, "a▁b", "en", "s", 1), (401, "<s> </s> <unk> <|endoftext|> [INST]", "en", "s", 1), (402, " lead and  two\t\ttabs \n", "en", "s", 1),
       (403, "nul \x00 byte ́ ퟿ \U0001f600\U0001f468‍\U0001f469", "en", "s", 1), (404, "日本語の文", "ja", "s", 1),
       (405, " " * 300 + "x" + "\n" * 200, "en", "s", 1), (406, "﻿start", "en", "s", 1), (407, "naïve café ẞ", "fr", "s", 1)]


def test_all_documents(spark, tools):
    rows = odd_documents() + ODD + [ODD[1], ODD[4]]
    got = align_tokenizers(spark.createDataFrame(rows, DOCUMENTS).repartition(3), carry=["doc_id"])
    assert got.columns == COLUMNS
    assert ordered(got.collect()) == _plain(rows, tools)


def test_query(spark, sf, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(op11_tokenizer_alignment(spark, sf).collect()) == _plain(rows, tools)


def test_long_chain_of_overlaps():
    # tokens that end together only at the last byte
    a_ends = np.append(np.arange(2, 20_001, 2), 20_002)
    b_ends = np.append(np.arange(1, 20_000, 2), 20_002)
    a_group, b_group = terminals(a_ends, b_ends)
    assert set(a_group) == set(b_group) == {len(b_ends) - 1}


def test_long_white_space_keeps_its_ids():
    encode = plain_encoder(read_ranks(A.removesuffix(".json") + ".tiktoken"))
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    for text in (" " * 2_000_000, "\n" * 2_000_000, "b" * 2_000_000, "x" + " " * 5000 + "y" + "\n" * 5000 + " z" + "\t" * 4096, "　" * 5000 + "'s"):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one text", 5, "b", {"k": "v"}), (2, None, 6, "c", None)], "doc_id long, text string, row int, block string, n_a map<string,string>")
    got = {r["doc_id"]: r for r in align_tokenizers(docs).collect()}
    assert got[1]["row"] == 5 and got[2]["block"] == "c" and got[1]["n_a"] == 2 and got[2]["groups_sha256"] == ""
    assert align_tokenizers(docs.limit(0)).collect() == []
