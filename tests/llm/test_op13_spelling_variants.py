import random
import re
import zlib
from collections import Counter, defaultdict

from plain import DOCUMENTS, odd_documents, ordered

from parcelflow.llm.op13_spelling_variants import count_words, keys_of, last_forms, op13_spelling_variants, spelling_variants


def _words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _near(words):
    """Near words by deletion neighbourhoods: one replaced letter leaves the same text around the same gap."""
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    return near


def _plain(counts):
    near, out = _near(counts), []
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return ordered(out)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(got.collect()) == _plain(_words(rows))


def test_larger_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = _plain(_words(rows))
    assert ordered(op13_spelling_variants(spark, "/root/testdata/sf0.01").collect()) == want
    assert sum(r[4] > 0 for r in want) > 1000


def test_words_of_few_letters(spark):
    """Dense words: every edit, repeated letters, equal letters in another order."""
    rng = random.Random(1)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.choice([3, 3, 4, 6, 7, 12, 30, 100]) for _ in range(1500)}
    counts |= {"z" * n: 3 * n for n in (5, 6, 7, 40, 41)}
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert ordered(got.collect()) == _plain(counts)


def test_odd_rows(spark):
    rows = odd_documents() + [(500 + i, "Colour color COLOUR colours ÀgrÉment àgrément straße 한글 x×y" * (1 + i % 3), "en", "s", 1) for i in range(9)]
    rows += [rows[-1], (None, "colour colour colour", None, None, None), (600, "y" * 12_000 + " " + ("y" * 12_001 + " ") * 3, "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, DOCUMENTS)
    want = _words((r[0], r[1]) for r in rows)
    assert {r["word"]: r["n"] for r in count_words(docs).collect()} == want
    short = {w: n for w, n in want.items() if len(w) < 1000}
    assert ordered(r for r in spelling_variants(count_words(docs)).collect() if len(r["word"]) < 1000) == _plain(short)


def test_signatures_of_near_words_meet():
    rng, known = random.Random(3), {}
    for _ in range(3000):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 14)))
        i = rng.randrange(len(w))
        replaced = w[:i] + rng.choice("abcdefg") + w[i + 1:]
        assert set(keys_of(w, 0, known)) & set(keys_of(replaced, 0, known))
        longer = w[:i] + rng.choice("abcdefg") + w[i:]
        assert set(keys_of(w, 1, known)) & set(keys_of(longer, 2, known))


def test_chains_and_empty_table(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    got = {r["word"]: r["root"] for r in last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w40" for i in range(40)}
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n long, key int")
    assert spelling_variants(count_words(docs)).collect() == []
