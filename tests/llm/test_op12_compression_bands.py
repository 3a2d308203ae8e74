import base64
import os
import random
from collections import Counter

import pytest
import zstandard
from plain import DOCUMENTS, SPACED, odd_documents, ordered, prose

from parcelflow.llm import op12_compression_bands as op12
from parcelflow.llm.op12_compression_bands import BANDS, compression_bands, op12_compression_bands, word_numbers


def _plain(text):
    """The counts and the verdict, one definition after the other."""
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    data, zip_ = text.encode(), zstandard.ZstdCompressor(level=3, write_content_size=False)

    def bad(piece):
        ratio = len(piece) / len(zip_.compress(piece))
        band = max(b for b in BANDS if b.from_bytes <= len(piece))
        return not band.least <= ratio <= band.most

    chunks = [data[i:i + 4096] for i in range(0, len(data), 4096)]
    outside = sum(len(c) for c in chunks if bad(c)) if len(chunks) > 1 else 0
    kept = not failed and not bad(data) and outside <= 0.25 * len(data)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed, kept)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _extra(rng):
    noise = base64.b64encode(os.urandom(30_000)).decode()
    good = prose(rng, 3000, 40_000)
    return [(400, " ".join(noise[i:i + 60] for i in range(0, len(noise), 60)), "en", "s", 1), (401, "\n".join([good, "a # b\r", "a # b\r", "a # b", " \t", " \t"]), "en", "s", 1),
            (402, good + " " + " ".join(noise[i:i + 40] for i in range(0, 20_000, 40)), "en", "s", 1), (403, "one two\x1cthree\x85four\xa0five " * 30, "en", "s", 1),
            (404, "a b c d a b c e " + prose(rng, 60, 9000), "en", "s", 1), (405, "#*$%&|<> " * 80, "en", "s", 1)]


def test_all_documents(spark):
    rows = odd_documents() + _extra(random.Random(2))
    got = compression_bands(spark.createDataFrame(rows, DOCUMENTS), carry=["doc_id"]).select(*COLUMNS)
    assert ordered(got.collect()) == ordered((d, *_plain(t)) for d, t, *_ in rows)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op12_compression_bands(spark, sf).select(*COLUMNS)
    assert ordered(got.collect()) == ordered((d, *_plain(t)) for d, t in rows)


def test_verdicts(spark):
    rng = random.Random(3)
    rows = _extra(rng)
    kept = {r["doc_id"]: r["kept"] for r in compression_bands(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    # encoded data, and a good text with an encoded half, go; prose stays
    assert not kept[400] and kept[401] and not kept[402]


def test_labelled_documents(spark):
    """Good documents of 50 words and more stay; repetitive ones go."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op12_compression_bands(spark, folder).join(labels, "doc_id").filter("NOT base_failed")
    assert got.filter("quality = 1").count() > 200 and got.filter("quality = 1 AND NOT kept").count() == 0
    assert got.filter("ratio > 5 AND kept").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_cut_no_word(monkeypatch, piece):
    monkeypatch.setattr(op12, "_PIECE_BYTES", piece)
    rng = random.Random(piece)
    for text in ("", " ", "x" * 9000, "x" * 9000 + " " + "y" * 5000, prose(rng, 200) + "\n\n" + "é" * 50, "  lead", "tail  "):
        data = text.encode()
        words = data.split()
        first = {w: i for i, w in reversed(list(enumerate(dict.fromkeys(words))))}
        assert word_numbers(data).tolist() == [first[w] for w in words]


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a text", True, 5.0, {"k": 1})], "doc_id long, text string, kept boolean, ratio double, tags map<string,int>")
    row = compression_bands(docs).first()
    assert row["tags"] == {"k": 1} and row["kept"] is False and row["n_words"] == 2
    assert compression_bands(docs.limit(0)).collect() == []
