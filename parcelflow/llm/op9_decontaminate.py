"""Benchmark decontamination by training suffix arrays.

Documents are taken in shards of bounded size.  A shard's suffixes are sorted into a suffix array
(by word hashes, ``window`` words deep), every benchmark suffix is looked up in it by binary search, and
equal runs give all places of the benchmark's windows.  Touching windows on one diagonal merge into the
longest verbatim matches.  A shard only sorts suffixes that start with a word pair (or a word, for
one-word items) some window starts with; others cannot be found by any search.

The benchmark is taken in blocks of bounded size, each sent to all shards in one pass; blocks
meet per document by aggregation.  A benchmark of ordinary size is one block.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters, compared by 64-bit
hashes.  A window is ``window`` consecutive words of an item; a shorter item is one window.

Nulls and odd rows: null and empty texts have no words; an item without words has no window; a null
item_id marks words but is not listed; items that share an id count once; documents are judged
row by row, so repeated doc_ids and nulls are fine; input columns with an output's name give way to it; an empty
table gives no rows, an empty benchmark finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.carry import carried, named_apart, named_back
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import LOWER, WORD_BYTES, Words, byte_powers, mix, slices, text_buffers
from parcelflow.llm.worker import tidy

WINDOW = 10
#: Benchmark rows a block sends to the tasks: its bound for memory.
BLOCK_BYTES = 32 << 20
_SLICE_BYTES = 1 << 20
_FILTER_BITS = 22
_END = np.uint64(0)

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("item_start", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _letters(texts: pa.Array, powers) -> tuple[Words, np.ndarray]:
    data, offsets = text_buffers(texts)
    words = Words(LOWER[data], offsets, WORD_BYTES)
    hashes = words.hashes(powers)
    hashes[hashes == _END] = np.uint64(1)
    return words, hashes


def _suffixes(letters: np.ndarray, room: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words from each place, end marks behind the text's last word."""
    out = np.full((len(at), depth), _END, dtype=np.uint64)
    for k in range(depth):
        ok = room[at] > k
        out[ok, k] = letters[at[ok] + k]
    return out


class Probe:
    """Windows of a benchmark block: item, start, length and the words of each, and a filter of their first words."""

    def __init__(self, item_ids: np.ndarray, texts: pa.Array, window: int):
        words, letters = _letters(texts, byte_powers())
        room, text = words.room(), words.text_of()
        start = np.arange(len(letters)) - words.bounds[text]
        total = np.diff(words.bounds)[text]
        pick = np.flatnonzero((room >= window) | ((total < window) & (start == 0)))
        self.window = window
        self.items, self.starts = item_ids[text[pick]], start[pick]
        self.lengths = np.minimum(total[pick], window)
        self.rows = _suffixes(letters, room, pick, window)
        self.filter = np.zeros((2, 1 << _FILTER_BITS), dtype=bool)
        one = self.lengths == 1
        self.filter[0, self.bucket(self.rows[one, 0])] = True
        if window > 1:
            self.filter[1, self.bucket(mix(self.rows[~one, 0]) + self.rows[~one, 1])] = True

    @staticmethod
    def bucket(x: np.ndarray) -> np.ndarray:
        return (mix(x) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def places(self, letters: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Places of a shard where a window may start."""
        may = self.filter[0, self.bucket(letters)]
        pair = np.flatnonzero(room[:-1] > 1)
        may[pair] |= self.filter[1, self.bucket(mix(letters[pair]) + letters[pair + 1])]
        return np.flatnonzero(may)


def _before(rows: np.ndarray, probes: np.ndarray, depth: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether each row sorts before its probe, by the probe's first ``depth`` words."""
    differs = (rows != probes) & (np.arange(rows.shape[1]) < depth[:, None])
    some = differs.any(axis=1)
    k = differs.argmax(axis=1)
    i = np.arange(len(rows))
    return np.where(some, rows[i, k] < probes[i, k], or_equal)


def _search(sorted_rows: np.ndarray, probe: Probe, right: bool) -> np.ndarray:
    """Binary search of all windows at once in a suffix array."""
    lo, hi = np.zeros(len(probe.rows), np.int64), np.full(len(probe.rows), len(sorted_rows), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        down = _before(sorted_rows[mid], probe.rows[open_], probe.lengths[open_], right)
        lo[open_[down]], hi[open_[~down]] = mid[down] + 1, mid[~down]
    return lo


def find(texts: pa.Array, probe: Probe) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """All places of the probe's windows in one shard: its words; and the text, start and window of each hit."""
    words, letters = _letters(texts, byte_powers())
    empty = np.zeros(0, np.int64)
    if not len(letters) or not len(probe.rows):
        return words, empty, empty, empty
    room = words.room()
    at = probe.places(letters, room)
    suffixes = _suffixes(letters, room, at, probe.window)
    order = np.lexsort(suffixes.T[::-1])
    array, at = suffixes[order], at[order]
    lo, hi = _search(array, probe, False), _search(array, probe, True)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    hit = at[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    text = words.text_of()[hit]
    return words, text, hit - words.bounds[text], window


def _merged(start: np.ndarray, stop: np.ndarray, key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching or overlapping ranges of one key joined: the first row, and the merged starts and stops."""
    order = np.lexsort((start, *reversed(key)))
    start, stop = start[order], stop[order]
    new = np.ones(len(order), dtype=bool)
    for k in key:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[0] = False
    same_key = new
    # where lengths differ a range may still overlap an earlier, longer one; readers take the union
    reach = np.zeros(len(order), dtype=bool)
    reach[1:] = same_key[1:] & (start[1:] <= stop[:-1])
    head = np.flatnonzero(~reach)
    return order[head], start[head], np.maximum.reduceat(stop, head)


def _shards(window: int, probe_ids: list, probe_texts: list, carry: list[str], with_matches: bool):
    def run(batches):
        ids = pa.array(probe_ids, pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # items are numbered within the block; equal ids share a number
        distinct, item_of = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        item_of = np.where(known, item_of, -1)
        probe = Probe(np.arange(len(probe_ids)), pa.array(probe_texts, pa.string()), window)
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                words, text, start, hit = find(piece.column("text"), probe)
                n = len(words.bounds) - 1
                made = {"n_words": pa.array(np.diff(words.bounds), pa.int64())}
                stop = start + probe.lengths[hit]
                spans, items, matches = [None] * n, [None] * n, [None] * n
                if len(hit):
                    _, a, b = _merged(words.bounds[text] + start, words.bounds[text] + stop, [text])
                    for i, s, e in zip(*_by_text(words, a, b), strict=True):
                        spans[i] = (spans[i] or []) + [{"start": s, "stop": e}]
                    number = item_of[probe.items[hit]]
                    listed = number >= 0
                    pairs = np.unique(np.stack([text[listed], number[listed]]), axis=1)
                    for i, k in zip(*pairs.tolist(), strict=True):
                        items[i] = (items[i] or []) + [int(distinct[k])]
                    if with_matches:
                        first, a, b = _merged(start, stop, [text, probe.items[hit], start - probe.starts[hit]])
                        for f, s, e in zip(first.tolist(), a.tolist(), b.tolist(), strict=True):
                            item = probe.items[hit[f]]
                            row = {"item_id": probe_ids[item], "item_start": int(probe.starts[hit[f]]), "start": s, "length": e - s}
                            matches[text[f]] = (matches[text[f]] or []) + [row]
                columns = [*[piece.column(c) for c in carry], made["n_words"],
                           pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                           pa.array(items, pa.list_(pa.int64()))]
                names = [*carry, "n_words", "hit_spans", "item_ids"]
                if with_matches:
                    columns.append(pa.array(matches, pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "item_start", "start", "length")]))))
                    names.append("matches")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _by_text(words: Words, a: np.ndarray, b: np.ndarray) -> tuple[list, list, list]:
    text = np.searchsorted(words.bounds, a, side="right") - 1
    return text.tolist(), (a - words.bounds[text]).tolist(), (b - words.bounds[text]).tolist()


def _blocks(benchmark: DataFrame):
    """The benchmark's (ids, texts) in blocks of bounded size."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter("length(text) > 0").select(F.col("item_id").cast("long"), "text")
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, carry: list[str] | None = None,
                  matches: bool = True) -> DataFrame:
    """The carried columns (default: all), n_words, n_hit, item_ids, contaminated and, with ``matches``,
    the longest verbatim matches as (item_id, item_start, start, length) in words from 0."""
    made = ["n_words", "hit_spans", "item_ids", *(["matches"] if matches else [])]
    carry = carried(documents, carry, [*made, "n_hit", "contaminated"])
    documents, plain = named_apart(documents)
    carry = [plain[c] for c in carry]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kinds = {"n_words": T.LongType(), "hit_spans": spans, "item_ids": T.ArrayType(T.LongType()), "matches": MATCHES}
    out = documents
    blocks = 0
    for ids, texts in _blocks(benchmark):
        # a later block adds to the columns that the blocks before it made
        names = [c for c in out.columns if c in carry or c == "text" or c.startswith("__")]
        schema = T.StructType([*[out.schema[c] for c in names], *[T.StructField(c, kinds[c]) for c in made]])
        out = out.select(*names).mapInArrow(tidy(_shards(window, ids, texts, names, matches)), schema)
        if blocks:
            for c in made[1:]:
                out = out.withColumn(c, F.concat(F.coalesce(c, F.array().cast(kinds[c])), F.coalesce(f"__{c}", F.array().cast(kinds[c]))))
        out = out.withColumns({f"__{c}": F.col(c) for c in made[1:]})
        blocks += 1
    # spans of several blocks may overlap: the words hit are counted on their union
    ordered = F.array_sort(F.coalesce("hit_spans", F.array().cast(spans)))
    union = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["to"], x["start"]))).alias("n"),
        F.greatest(s["to"], x["stop"]).alias("to")))["n"]
    extra = ["matches"] if matches else []
    found = (out.withColumn("n_hit", union)
             .withColumn("item_ids", F.array_distinct(F.coalesce("item_ids", F.array().cast("array<bigint>"))))
             .select(*carry, "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"), *extra))
    return named_back(found, plain)


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, columns unchanged."""
    plain = documents.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(documents.columns)])
    found = decontaminate(plain, benchmark, window=window, matches=False)
    return found.filter("NOT contaminated").select(*plain.columns).toDF(*documents.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
q AS (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(greatest(len(words) - 9, 1))) AS pos FROM b WHERE len(words) > 0),
v AS (SELECT DISTINCT item_id, size, array_to_string(words[pos + 1:pos + size], ' ') AS seq FROM q),
z AS (SELECT DISTINCT size FROM v),
g AS (SELECT doc_id, size, words, unnest(range(greatest(len(words) - size + 1, 0))) AS pos FROM d, z),
h AS (SELECT g.doc_id, g.pos, g.size, v.item_id FROM g JOIN v ON v.size = g.size AND v.seq = array_to_string(g.words[g.pos + 1:g.pos + g.size], ' ')),
n AS (SELECT doc_id, count(DISTINCT pos + t.i) AS n_hit FROM h, range(10) t(i) WHERE t.i < size GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


@query("op9_decontaminate", ORACLE)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"], matches=False)
    listed = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), "contaminated")
