"""Spelling variants of words: PartEnum signatures of letter multisets, exact verification, forms and roots.

A word's letters are a binary vector with one dimension for each (letter, how many of it so far).  Words that differ by one
replaced letter differ in two dimensions and have equal lengths; words that differ by one inserted letter differ in one
dimension and in length by one.  So each case is a join of its own:

* equal lengths: dimensions are dealt into four parts; two differences touch two parts at most, so some choice of two
  parts is equal, and every choice is a signature (six).
* one letter more: three parts, of which one at most is touched; every choice of two is a signature (three).

An edit also leaves the first or the last half of the shorter word as it is, so each signature is paired with either half: words
of equal letters in another order part, and a signature shared by a large part of all words does not pair them all.
Signatures are equi-joined in Spark, and a pair counts when its edit distance is one.  No bucket is collected: a sort-merge join
streams it, and AQE splits a large one.

Words are counted in the tasks first, so the shuffle has one row for each task and word.  A word's form has at least twice its
count, so chains of forms are as long as the logarithm of the largest count at most; pointer doubling follows them.

Nulls and odd rows: null texts have no words; a null doc_id is written as an empty string; repeated rows count each time; ties of
counts go to the smallest word in code-point order; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelflow.llm.registry import query, table
from parcelflow.sources.storage import materialise

MIN_CHARS = 5
MIN_COUNT = 3
#: a form has this many times the word's count
FORM_TIMES = 2
SLIP_EVERY = 97
#: (parts, parts that may differ) of words of equal length and of words with one letter more
SAME_PARTS, MORE_PARTS = (4, 2), (3, 1)
_RUN = re.compile("[a-zÀ-ÿ]+")
_FLUSH = 200_000
_BATCH_ROWS = 2_000


def slipped(run: str, prefix: int, every: int) -> str:
    """The run without one code point, if the CRC-32 that ``prefix`` starts and the run ends is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(documents: DataFrame, *, every: int = SLIP_EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""

    def run(batches):
        seen: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower changes A to Z alone
                for found, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
                    word = slipped(found, prefix, every)
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) >= _FLUSH:
                    yield flushed()
        if seen:
            yield flushed()

    counted = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def parts_of(word: str, parts: int, known: dict) -> list[int]:
    """The sum of the dimensions' hashes in each part; equal parts have equal sums."""
    import xxhash

    sums, times = [0] * parts, {}
    for letter in word:
        k = times[letter] = times.get(letter, 0) + 1
        h = known.get((letter, k))
        if h is None:
            h = known[letter, k] = xxhash.xxh3_64_intdigest(f"{letter}{k}".encode())
        sums[h % parts] += h
    return [x & 0xFFFFFFFFFFFFFFFF for x in sums]


def keys_of(word: str, role: int, known: dict) -> list[int]:
    """The join keys of a word as one of two equally long words (role 0), as the shorter (1) or the longer one (2)."""
    import xxhash

    parts, differ = MORE_PARTS if role else SAME_PARTS
    n = len(word) - (role == 2)  # letters of the shorter word
    sums = parts_of(word, parts, known)
    half = n // 2
    halves = ("first", word[:half]), ("last", word[len(word) - (n - half):])
    out = []
    for which in combinations(range(parts), parts - differ):
        chosen = ",".join(f"{p}={sums[p]}" for p in which)
        out += [xxhash.xxh3_64_intdigest(f"{role > 0} {n} {chosen} {side} {text}".encode()) for side, text in halves]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def signatures(words: DataFrame) -> DataFrame:
    """(key, role, word, n): every word in its three roles."""

    def run(batches):
        known: dict = {}
        for whole in batches:
            for i in range(0, whole.num_rows, _BATCH_ROWS):
                batch = whole.slice(i, _BATCH_ROWS)
                keys, roles, rows = [], [], []
                for k, word in enumerate(batch.column("word").to_pylist()):
                    for role in (0, 1, 2):
                        own = keys_of(word, role, known)
                        keys += own
                        roles += [role] * len(own)
                        rows += [k] * len(own)
                taken = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), taken.column("word"), taken.column("n")],
                                                 ["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of words at an edit distance of one, each pair once."""
    signed = materialise(signatures(words), "signatures")
    one = signed.filter("role < 2").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), "role")
    two = signed.filter("role <> 1").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    # keys of the two cases differ, so a shorter word meets longer ones only
    met = one.join(two, "key").filter((F.col("role") == 1) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the (word, form) rows: forms followed to the last."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        stepped = materialise(now.join(further, F.col("root") == F.col("__word"), "left")
                              .select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, *, form_times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct words and their counts n."""
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(near_pairs(words), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("times")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("times")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("times")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= form_times * F.col("n")
    named = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = last_forms(named.filter("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents")))
