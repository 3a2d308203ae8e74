"""Quality classifier by Bradley-Terry pairwise ranking.

The chance that document a is better than b is logistic(s(a) - s(b)), with s linear in text features.
Preference pairs (label 1 over label 0) give the weights by logistic loss on feature differences; the
threshold is the score quantile that leaves the labelled share of good documents above it, taken by exact ranks over
the scores of all labelled rows.

One pass over the whole texts makes the features of all documents, which are written once, small;
labels meet them by doc_id.  The fit takes at most ``SAMPLE_ROWS`` labelled rows of either class (those
with the smallest hash of their doc_id) and ``PAIRS`` pairs among them; nothing else is sampled.

The score is logistic(s - threshold), so 0.5 is the threshold.

Nulls and odd rows: null and empty texts have all features zero and a score like any other; a label
row with null quality or doc_id says nothing, equal numbers of 0 and 1 for one doc_id neither; without both
classes every score is 0.5; a null doc_id is not held out and not learned from; repeated rows get equal scores; an empty table
gives no rows; carried columns named features, score or predicted give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.op3_language_id import fold_of
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import NOT_SPACE, Words, byte_class, byte_powers, slices, text_buffers
from parcelflow.operators.quantiles import grouped_ranks
from parcelflow.sources.storage import materialise

SAMPLE_ROWS = 10_000
PAIRS = 60_000
RIDGE = 1e-3
SEED = 7
_SLICE_BYTES = 4 << 20


def _bytes_of(characters: str) -> np.ndarray:
    return byte_class([(ord(c), ord(c)) for c in characters])


CLASSES = {
    "upper": byte_class([(0x41, 0x5A)]),
    "lower": byte_class([(0x61, 0x7A)]),
    "digit": byte_class([(0x30, 0x39)]),
    "wide": byte_class([(0x80, 0xFF)]),
    "stop": _bytes_of(".,;:"),
    "loud": _bytes_of("!?"),
    "mark": _bytes_of("#$%&*@^~|"),
    "bracket": _bytes_of("()[]{}<>"),
    "code": _bytes_of("=+/\\_`\"'"),
    "line": _bytes_of("\n"),
}
FEATURES = [*(f"{c}_{kind}" for c in CLASSES for kind in ("share", "any")), "length", "word_length", "short_words", "long_words",
            "distinct", "adjacent", "most_common", "marked_words", "loud_words", "bar_words"]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def features(texts: pa.Array, powers) -> np.ndarray:
    """One row of features for each text, over its whole length."""
    data, offsets = text_buffers(texts)
    words = Words(data, offsets, NOT_SPACE)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(words.bounds), 1)
    out = []
    for member in CLASSES.values():
        share = _per_text(member[data], offsets) / n_bytes
        out += [np.sqrt(share), share > 0]
    lens = words.ends - words.starts
    hashes, text = words.hashes(powers), words.text_of()
    order = np.lexsort((hashes, text))  # the words of a text stay together
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(order)))
    most = np.zeros(len(n_words))
    np.maximum.at(most, text[order][head], run)
    adjacent = np.zeros(len(hashes), dtype=bool)
    adjacent[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    last = data[words.ends - 1] if len(lens) else data[:0]
    marks, loud = _bytes_of("#$%&*@^~"), _bytes_of("!?")
    alone = (lens == 1) & _bytes_of("|-=")[last]
    shares = [lens <= 3, lens >= 12, new, adjacent, marks[last], loud[last], alone]
    short, long_, distinct, same, marked, shouted, bars = (_per_text(x, words.bounds) / n_words for x in shares)
    out += [np.log1p(np.diff(words.bounds)) / 8, np.log1p(_per_text(lens, words.bounds) / n_words), short, long_,
            distinct, np.sqrt(same), np.sqrt(most / n_words), np.sqrt(marked), np.sqrt(shouted), np.sqrt(bars)]
    return np.stack([np.asarray(x, dtype=np.float64) for x in out], axis=1) * (np.diff(offsets) > 0)[:, None]


def with_features(documents: DataFrame, carry: list[str]) -> DataFrame:
    carry = carried(documents, carry, ["features", "score", "predicted"])
    schema = T.StructType([*[documents.schema[c] for c in carry], T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches):
        powers = byte_powers()
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                x = features(piece.column("text"), powers).astype(np.float32)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carry], rows], [*carry, "features"])

    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the features, by Newton steps on the logistic loss of good minus bad."""
    width = good.shape[1]
    w = np.zeros(width)
    if not len(good) or not len(bad):
        return w
    rng = np.random.default_rng(SEED)
    n = max(pairs, len(good), len(bad))
    # every row takes part about equally often
    i = rng.permutation(np.resize(np.arange(len(good)), n))
    j = rng.permutation(np.resize(np.arange(len(bad)), n))
    x = good[i] - bad[j]
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(np.clip(x @ w, -30, 30)))
        slope = ridge * w - x.T @ p / n
        bend = (x * (p * (1 - p))[:, None]).T @ x / n + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _linear(weights: np.ndarray) -> Column:
    """The score before the logistic, from the features column."""
    terms = F.zip_with("features", F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x.cast("double") * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def quantile_threshold(scored: DataFrame, n_bad: int, n: int) -> float:
    """Halfway between the scores (column s) of ranks n_bad and n_bad + 1 of all n rows; 0.0 without both classes."""
    if not 0 < n_bad < n:
        return 0.0
    at = grouped_ranks(scored, [], "s", {"below": lambda _: F.lit(n_bad), "above": lambda _: F.lit(n_bad + 1)}).first()
    return (at["below"] + at["above"]) / 2


def _pick(labelled: DataFrame, total: int, sample_rows: int) -> np.ndarray:
    """The features of the ``sample_rows`` rows with the smallest hash of their doc_id.

    The hash has a bound below which twice as many rows are to be expected, so that partitions do not each send
    ``sample_rows`` of them; where repeated ids leave too few, all rows are ordered.
    """
    least = -(1 << 63)
    bound = least + (2 * sample_rows * (1 << 64)) // max(total, 1)
    key = F.xxhash64("doc_id")
    picked = []
    if bound < -least:
        picked = labelled.filter(key < F.lit(bound)).orderBy(key, "doc_id").limit(sample_rows).select("features").collect()
    if len(picked) < min(total, sample_rows):
        picked = labelled.orderBy(key, "doc_id").limit(sample_rows).select("features").collect()
    return np.array([r["features"] for r in picked], dtype=np.float64).reshape(len(picked), len(FEATURES))


def learn_quality(rows: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and threshold from (doc_id, features) rows and labels (doc_id, 0 or 1)."""
    told = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
            .agg(F.avg(label).alias("y")).filter("y <> 0.5").select("doc_id", (F.col("y") > 0.5).alias("y")))
    labelled = materialise(rows.select("doc_id", "features").join(told, "doc_id"), "quality-labelled")
    total = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = total.get(True, 0), total.get(False, 0)
    w = fit_bradley_terry(_pick(labelled.filter("y"), good, sample_rows), _pick(labelled.filter("NOT y"), bad, sample_rows))
    return w, quantile_threshold(labelled.select(_linear(w).alias("s")), bad, good + bad)


def score_quality(rows: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The rows with score and predicted in place of features."""
    score = 1.0 / (1.0 + F.exp(F.lit(threshold) - _linear(weights)))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("features")


@query("op7_quality_ranking")
def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(with_features(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-features")
    weights, threshold = learn_quality(rows.filter(fold_of("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score_quality(rows, weights, threshold).select("doc_id", held_out, "score", "predicted")
