"""Language ID by rank-order profiles of letter n-grams.

A profile is the ranking of the ``size`` most frequent n-grams (1 to 3 letters, with word edges) of
a language's training texts; a document gets the ranking of its own most frequent n-grams.  The out-of-place
distance adds up how far each of the document's n-grams is from its place in the profile, with ``size`` for
those the profile lacks; the nearest profile wins.  Equal counts rank by n-gram, equal distances by name.

Training counts run in the tasks and meet by (language, n-gram) in one aggregation, so no text is moved.
Profiles go to the tasks: ``size`` rows for each learned language, of which there may be ``MOST_LANGUAGES``.

The score is the winner's similarity (1 - distance / worst distance) among all similarities, 0 to 1.

Nulls and odd rows: null texts and texts without a letter are ``und`` with score 0, as is everything if
no language could be learned; rows with null lang or null doc_id are not learned from; a null
doc_id is not held out; rows are judged one by one, so repeated rows get equal results; input columns named
lang_pred or score give way to the output's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import slices
from parcelflow.llm.worker import tidy

ORDER = 3
PROFILE = 400
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
# a slice takes about 150 bytes of memory a byte of text
_SLICE_BYTES = 128 << 10
_SPACE, _UNSEEN = 0x20, 0xFFFFFFFF


class Alphabet:
    """Code points to lower-case letters; everything else is a space.  Filled as characters turn up."""

    def __init__(self):
        self.to = np.full(0x110000, _UNSEEN, dtype=np.uint32)

    def fold(self, codes: np.ndarray) -> np.ndarray:
        out = self.to[codes]
        new = out == _UNSEEN
        if new.any():
            for c in np.unique(codes[new]).tolist():
                ch = chr(c)
                self.to[c] = ord(ch.lower()[0]) if ch.isalpha() else _SPACE
            out = self.to[codes]
        return out


def grams(texts: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a batch as 64-bit codes, and the index of the text of each, in text order by length.

    Runs of other characters are one space; a gram may begin or end with it, but not contain it inside.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # one space in front of each text
    row = np.repeat(np.arange(len(n)), n)
    letters = np.full(len(codes) + len(n) + 1, _SPACE, dtype=np.uint32)
    letters[np.arange(len(codes)) + row + 1] = alphabet.fold(codes)
    owner = np.append(np.repeat(np.arange(len(n)), n + 1), len(n))
    blank = letters == _SPACE
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (owner[1:] != owner[:-1])
    c, owner, blank = letters[keep].astype(np.int64), owner[keep], blank[keep]
    found, of = [c[~blank]], [owner[~blank]]
    two = ~(blank[1:] & blank[:-1])
    # a space in front belongs to the text that follows it
    found.append((c[:-1] | c[1:] << 21)[two])
    of.append(np.where(blank[:-1], owner[1:], owner[:-1])[two])
    three = ~blank[1:-1]
    found.append((c[:-2] | c[1:-1] << 21 | c[2:] << 42)[three])
    of.append(owner[1:-1][three])
    return np.concatenate(found), np.concatenate(of)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[head], np.diff(np.append(head, len(x)))


def _training_counts(batches):
    alphabet, totals = Alphabet(), {}
    for batch in batches:
        for piece in slices(batch, "text", _SLICE_BYTES):
            langs = piece.column("lang").to_pylist()
            found, of = grams(piece.column("text"), alphabet)
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])[of]
            for k, lang in enumerate(names):
                mine = found[number == k]
                if len(mine):
                    totals.setdefault(lang, []).append(_counted(mine))
                    if len(totals[lang]) >= 8:
                        totals[lang] = [_summed(totals[lang])]
    for lang, parts in totals.items():
        g, n = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))],
                                         ["lang", "gram", "n"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[head], np.add.reduceat(n, head)


def learn_profiles(training: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams, most frequent first."""
    rows = training.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(tidy(_training_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place")
    top = ranked.limit(MOST_LANGUAGES * size + 1).collect()
    if len({r["lang"] for r in top}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: not a language column")
    profiles: dict[str, list[int]] = {}
    for r in sorted(top):
        profiles.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: [g for _, g in sorted(p)] for lang, p in profiles.items()}


def classify(texts: pa.Array, langs: list[str], known: np.ndarray, ranks: np.ndarray, size: int, alphabet: Alphabet):
    """(language, score) of each text; ``ranks`` has the place of each known n-gram by language, ``size`` if it has none."""
    found, of = grams(texts, alphabet)
    order = np.argsort(of, kind="stable")
    found, bounds = found[order], np.searchsorted(of[order], np.arange(len(texts) + 1))
    names, scores = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b or not langs:
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        g, n = _counted(found[a:b])
        top = g[np.argsort(-n, kind="stable")[:size]]
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        there = np.where(known[at] == top, ranks[:, at], size)
        out_of_place = np.where(there < size, np.abs(there - np.arange(len(top))), size).sum(axis=1)
        near = 1.0 - out_of_place / (size * len(top))
        best = int(np.argmax(near))
        names.append(langs[best])
        scores.append(float(near[best] / near.sum()) if near.sum() > 0 else 0.0)
    return names, scores


def predict_language(documents: DataFrame, profiles: dict[str, list[int]], *, size: int = PROFILE,
                     carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all), lang_pred and score."""
    carry = carried(documents, carry, ["lang_pred", "score"])
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    ranks = np.full((len(langs), len(known)), size, dtype=np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def run(batches):
        alphabet = Alphabet()
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                names, scores = classify(piece.column("text"), langs, known, ranks, size, alphabet)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carry], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 [*carry, "lang_pred", "score"])

    schema = T.StructType([*[documents.schema[c] for c in carry], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), schema)


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def keep_languages(documents: DataFrame, *, size: int = PROFILE) -> DataFrame:
    """The documents that have a language, columns unchanged; learns from those with a lang."""
    profiles = learn_profiles(documents.filter(fold_of("doc_id", 4) != 2), size)
    plain = documents.toDF(*[c if c == "text" else f"__{i}" for i, c in enumerate(documents.columns)])
    kept = predict_language(plain, profiles, size=size).filter(F.col("lang_pred") != UNDETERMINED)
    return kept.drop("lang_pred", "score").toDF(*documents.columns)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = learn_profiles(documents.filter(fold_of("doc_id", 4) != 2))
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict_language(documents, profiles, carry=["doc_id"]).select("doc_id", held_out, "lang_pred", "score")
