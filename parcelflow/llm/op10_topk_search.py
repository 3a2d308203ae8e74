"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length (Euclidean norm) into buckets of descending length.  A query with length |q| and a
current k-th best score t can only gain from a vector of length l whose cosine reaches t / (|q| l): the local
threshold.  Per bucket and query it decides the pruning:

* above 1 for the bucket's longest vector: the bucket, and all after it, are skipped;
* high: coordinate pruning.  On the query's strongest coordinates a vector with that cosine must lie in
  a narrow range, so only vectors within the ranges are verified;
* else length pruning: only the vectors that are long enough are verified.

The products of what is left are computed in full and ranked, so the result is exact.

Candidates are dealt by norm in ranges, so each task holds neighbouring buckets; queries go to the tasks in blocks of
``BLOCK_QUERIES``.  Starting thresholds come from a first pass over the longest vectors (``SEED_ROWS``),
which can only be too low.  Each task returns at most k rows a query, which meet in one aggregation.

Components are floor(256 x) as whole numbers.  Odd rows: vectors that are null or hold null or non-finite
components, and rows with a null id, take no part; components are kept within 2**28 either way, so that
scores fit a long; a shorter vector counts as filled up with zeros; repeated candidate rows are separate
candidates; repeated query rows are answered once for each different vector of an id, with the id's rows
left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelflow.llm.registry import query, table
from parcelflow.sources.storage import materialise

TOP = 5
SCALE = 256
SEED_ROWS = 4096
BLOCK_QUERIES = 8192
BUCKET_ROWS = 1024
#: Local cosine above which coordinate pruning is tried, and the coordinates it looks at.
COORDINATE_COSINE = 0.6
FOCUS = 4
#: doubles from here on are whole numbers; scores beyond a long are held at its ends
_WHOLE, _LONG = float(1 << 53), (1 << 63) - 1
_RESULT = "query long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): the rows that take part, with whole-number components."""
    x = F.col(vector_column)
    usable = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    def scaled(c):
        y = c.cast("double") * SCALE
        return F.when(F.abs(y) < _WHOLE, F.floor(y).cast("double")).otherwise(y)

    whole = F.transform(x, scaled)
    rows = vectors.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows of ``width``, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lens)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in floating point or 64-bit integers while these are exact, else in Python's integers."""
    width = max(1, q.shape[1])
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    safe = np.sqrt(2.0**62 / width)
    large_q, large_c = (np.flatnonzero(np.abs(m).max(axis=1, initial=0) >= safe) for m in (q, c))
    out = np.clip(q, -safe, safe).astype(np.int64) @ np.clip(c, -safe, safe).astype(np.int64).T

    def exact(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        one, two = ([[int(x) for x in r] for r in m] for m in (rows, columns))
        found = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in two] for r in one]
        return np.array([[max(-_LONG, min(_LONG, x)) for x in r] for r in found], dtype=np.int64).reshape(len(one), len(two))

    if len(large_q):
        out[large_q] = exact(q[large_q], c)
    if len(large_c):
        out[:, large_c] = exact(q, c[large_c])
    return out


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` rows of each query, by score and then id."""
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    head = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    keep = order[place < top]
    return query[place < top], ids[keep], scores[keep]


class Searcher:
    """A block of queries that meets buckets of descending length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, thresholds: np.ndarray, top: int):
        self.ids, self.vectors, self.top = ids, vectors, top
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        #: a lower bound of each query's k-th best score
        self.floor = thresholds.astype(np.float64)
        unit = vectors / np.maximum(self.norms, 1)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.unit = unit
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """Take in one bucket, its rows in descending length."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.norms * norms[0] > 0, self.floor / (self.norms * norms[0]), np.where(self.floor > 0, np.inf, -np.inf))
        slack = 1e-9
        live = np.flatnonzero(cosine <= 1 + slack)
        if not len(live):
            return
        steep = cosine[live] >= COORDINATE_COSINE
        gentle = live[~steep]
        if len(gentle):
            # long enough for the least demanding of these queries; the rest fall to the product
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norms[gentle] > 0, self.floor[gentle] / self.norms[gentle], -np.inf).min()
            n = int(np.searchsorted(-norms, -need * (1 - slack), side="right")) if need > 0 else len(norms)
            scores = _products(self.vectors[gentle], vectors[:n])
            row, col = np.nonzero(scores >= self.floor[gentle][:, None])
            self.add(gentle[row], ids[col], scores[row, col])
        unit = vectors / np.maximum(norms, 1)[:, None]
        for q, least in zip(live[steep].tolist(), cosine[live[steep]].tolist(), strict=True):
            near = self._within(q, least - slack, unit)
            if len(near):
                scores = _products(self.vectors[q:q + 1], vectors[near])[0]
                ok = scores >= self.floor[q]
                self.add(np.full(ok.sum(), q), ids[near[ok]], scores[ok])
        self.trim()

    def _within(self, q: int, least: float, unit: np.ndarray) -> np.ndarray:
        """Rows of the bucket whose focus coordinates allow a cosine of ``least``."""
        least = min(1.0, least)
        rows = np.arange(len(unit))
        for f in self.focus[q]:
            x = self.unit[q, f]
            swing = np.sqrt(max(0.0, (1 - least * least) * (1 - x * x))) + 1e-9
            low = least * x - swing if -x <= least else -1.0
            high = least * x + swing if x <= least else 1.0
            y = unit[rows, f]
            rows = rows[(y >= low) & (y <= high)]
        return rows

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids == self.ids[query]
        self.found = tuple(np.concatenate(x) for x in zip(self.found, (query[~own], ids[~own], scores[~own]), strict=True))

    def trim(self) -> None:
        query, ids, scores = self.found = _best(*self.found, self.top)
        if len(query):
            last = np.flatnonzero(np.concatenate((query[1:] != query[:-1], [True])))
            full = np.bincount(query, minlength=len(self.ids))[query[last]] >= self.top
            at = query[last[full]]
            self.floor[at] = np.maximum(self.floor[at], scores[last[full]])


def _buckets(ids: list, vectors: list, thresholds: list, width: int, top: int):
    """Candidates of a task, bucket by bucket, against one block of queries."""

    def run(batches):
        search = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if search is None:
                q = np.zeros((len(ids), width))
                for i, v in enumerate(vectors):
                    q[i, :len(v)] = v
                search = Searcher(np.array(ids, np.int64), q, np.array(thresholds, np.float64), top)
            norms = batch.column("norm").to_numpy()
            order = np.argsort(-norms, kind="stable")
            vec_ids, matrix = batch.column("vec_id").to_numpy()[order], _matrix(batch.column("v"), width)[order]
            norms = norms[order]
            for a in range(0, len(norms), BUCKET_ROWS):
                search.meet(vec_ids[a:a + BUCKET_ROWS], matrix[a:a + BUCKET_ROWS], norms[a:a + BUCKET_ROWS])
        if search is not None:
            query, vec_ids, scores = search.found
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec_ids), pa.array(scores)], ["query", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, block: int):
    ids, vectors = [], []
    for r in queries.select("vec_id", "v").toLocalIterator():
        ids.append(r["vec_id"])
        vectors.append(r["v"])
        if len(ids) == block:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def _ranked(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top)


def top_k_search(candidates: DataFrame, queries: DataFrame, *, top: int = TOP, block: int = BLOCK_QUERIES,
                 id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` best rows of other ids, ties to the smaller id."""
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = whole_vectors(candidates, id_column=id_column, vector_column=vector_column)
    # neighbouring lengths share a partition, longest first; the id splits up a very common length
    rows = materialise(whole.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "vectors")
    asked = materialise(whole_vectors(queries, id_column=id_column, vector_column=vector_column).select("vec_id", "v").distinct(), "queries")
    width = max(d.agg(F.max(F.size("v"))).first()[0] or 0 for d in (rows, asked)) or 1
    longest = materialise(rows.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS), "longest")
    answers = []
    for ids, vectors in _blocks(asked, block):
        start = [-np.inf] * len(ids)
        seed = longest.mapInArrow(_buckets(ids, vectors, start, width, top), _RESULT)
        for r in _ranked(seed, top).filter(F.col("rank") == top).select("query", "score").collect():
            start[r["query"]] = float(r["score"])
        found = rows.mapInArrow(_buckets(ids, vectors, start, width, top), _RESULT)
        names = spark.createDataFrame(list(enumerate(ids)), "query long, query_id long")
        answers.append(_ranked(found, top).join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


@query("op10_topk_search", ORACLE)
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
