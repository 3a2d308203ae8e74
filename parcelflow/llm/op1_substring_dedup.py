"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``size`` consecutive words of one document.  A word goes when some window over it has a
word sequence that also starts earlier: in a smaller doc_id, or earlier in the same document.

1. Each task hashes the windows of its documents, deals them into buckets by a second, independent
   hash and sends each bucket one packed row (hash, document, start).  Windows that repeat inside the
   task leave only their first place in the bucket; the other places are known repeats already, and
   travel packed by document.  So a hot window costs each bucket one entry a task.
2. Each bucket finds the hashes with several places; all places but the first are repeats.
3. Repeats return to their documents, where touching windows merge into maximal removal intervals.

Two windows are equal when both 64-bit hashes agree (one carried, one through the bucket number).

Nulls and odd rows: a null text has no words; a null doc_id sorts before all others and stays null;
rows with the same doc_id are judged one by one at the place (doc_id, start), so identical rows get
the same result and do not remove each other's first place.  Other columns are carried through untouched;
an input column with the name of an output gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.carry import carried, named_apart, named_back
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import NOT_SPACE, Powers, Words, byte_powers, mix, slices, spark_xxhash64, text_buffers, window_hashes
from parcelflow.llm.worker import tidy

WINDOW = 20
_FIRST_BASE, _SECOND_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
_SECOND_SALT = np.uint64(0xA0761D6478BD642F)
_NO_ID = np.iinfo(np.int64).min
_FLUSH_WINDOWS = 500_000
_FLUSH_BUCKETS = 64
_SLICE_BYTES = 512 << 10

_PACKED = T.StructType([
    T.StructField("part", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("body", T.BinaryType()),
])
_ENTRIES, _REPEATS = 0, 1


def _pack(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Hashes as they are, places as byte planes of differences, which compress to a byte or so."""
    n = len(hashes)
    doc_steps = np.diff(docs, prepend=0).view(np.uint8).reshape(n, 8).T
    start_steps = np.diff(starts.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(n, 4).T
    places = zstandard.ZstdCompressor(level=1).compress(doc_steps.tobytes() + start_steps.tobytes())
    return np.int64(n).tobytes() + hashes.tobytes() + places


def _unpack(bodies: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = np.dtype(kind).itemsize
    parts = []
    for body in bodies:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        hashes = np.frombuffer(body, kind, n, 8)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[8 + width * n:]), np.uint8)
        docs = np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view(np.int64).ravel().cumsum()
        starts = np.ascontiguousarray(raw[8 * n:].reshape(4, n).T).view(np.int32).ravel().cumsum()
        parts.append((hashes, docs, starts))
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _doc_part(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part that pmod(xxhash64(doc_id), parts) gives in Spark."""
    return spark_xxhash64(docs) % parts


def _windows(words: Words, size: int, powers: tuple[Powers, Powers, Powers]) -> tuple:
    """Of all windows of a batch: both hashes, the text's index and the start in it."""
    bytes_, first, second = powers
    letters = words.hashes(bytes_)
    n = max(0, len(letters) - size + 1)
    whole = np.flatnonzero(words.room()[:n] >= size)
    one = window_hashes(letters, size, first)[whole]
    two = window_hashes(mix(letters ^ _SECOND_SALT), size, second)[whole]
    text = words.text_of()[whole]
    return one, two, text, whole - words.bounds[text]


def _all_powers() -> tuple[Powers, Powers, Powers]:
    return byte_powers(), Powers(_FIRST_BASE), Powers(_SECOND_BASE)


def _by_part(part: np.ndarray, kind: int, hashes, docs, starts) -> Iterator[tuple]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(part[group[0]]), kind, _pack(hashes[group], docs[group], starts[group])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], ["part", "kind", "body"])


def _earlier(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries share their hash with an earlier place."""
    ordered = np.sort(hashes)
    doubled = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(hashes), dtype=bool)
    if not len(doubled):
        return out
    at = np.searchsorted(doubled, hashes)
    some = np.flatnonzero(doubled[np.minimum(at, len(doubled) - 1)] == hashes)
    order = some[np.lexsort((starts[some], docs[some], hashes[some]))]
    h, d, s = hashes[order], docs[order], starts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out[order] = (d != d[first]) | (s != s[first])
    return out


def _hash_windows(size: int, buckets: int, parts: int):
    def run(batches):
        powers, held, count = _all_powers(), [], 0

        def flush():
            one, two, docs, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (two % np.uint64(buckets)).astype(np.int64)
            two = mix(two)
            two ^= one
            # equal windows in this flush: the first place speaks for them
            known = _earlier(two, docs, starts)
            del two
            stay = np.flatnonzero(known)
            if len(stay):
                yield _rows(list(_by_part(_doc_part(docs[stay], parts), _REPEATS, one[stay].astype(np.uint32), docs[stay], starts[stay])))
            bucket[stay] = buckets
            order = np.argsort(bucket, kind="stable")[:len(bucket) - len(stay)]
            cuts = np.searchsorted(bucket[order], np.arange(0, buckets, _FLUSH_BUCKETS))
            for part in np.split(order, cuts[1:]):
                if len(part):
                    yield _rows(list(_by_part(bucket[part], _ENTRIES, one[part], docs[part], starts[part])))

        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                ids = _doc_ids(piece.column("doc_id"))
                words = Words(*text_buffers(piece.column("text")), NOT_SPACE)
                one, two, text, starts = _windows(words, size, powers)
                if len(one):
                    held.append((one, two, ids[text], starts.astype(np.int32)))
                    count += len(one)
                if count >= _FLUSH_WINDOWS:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    return run


def _count_windows(parts: int):
    """Entries of whole buckets in, packed repeats out, one row for each part; repeats that are known pass through."""

    def run(batches):
        bodies: dict[int, list[bytes]] = {}
        for batch in batches:
            known = []
            for part, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == _REPEATS:
                    known.append((part, kind, body))
                else:
                    bodies.setdefault(part, []).append(body)
            if known:
                yield _rows(known)
        found = []
        for part in list(bodies):
            one, docs, starts = _unpack(bodies.pop(part), np.uint64)
            again = np.flatnonzero(_earlier(one, docs, starts))
            found.append((one[again].astype(np.uint32), docs[again], starts[again]))
        if found:
            tags, docs, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((starts, docs))
            tags, docs, starts = tags[order], docs[order], starts[order]
            yield _rows(list(_by_part(_doc_part(docs, parts), _REPEATS, tags, docs, starts)))

    return run


def _remove(size: int, fields: list[str]):
    """Rows sorted by part, its repeats before its documents."""

    def run(batches):
        powers, part, bodies, table_ = _all_powers(), None, [], None
        for batch in batches:
            parts = batch.column("__part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                run_of = batch.slice(a, b - a)
                if parts[a] != part:
                    part, bodies, table_ = parts[a], [], None
                is_doc = run_of.column("__body").is_null().to_numpy(zero_copy_only=False)
                n = int(np.argmax(is_doc)) if is_doc.any() else len(is_doc)
                bodies += run_of.column("__body").slice(0, n).to_pylist()
                if n == len(is_doc):
                    continue
                if table_ is None:
                    tags, docs, starts = _unpack(bodies, np.uint32)
                    order = np.lexsort((starts, docs))
                    table_, bodies = (docs[order], starts[order], tags[order]), []
                for piece in slices(run_of.slice(n), "text", _SLICE_BYTES):
                    yield _kept(piece, table_, size, powers, fields)

    return run


def _matches(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All indices in the ranges lo to hi, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _kept(piece: pa.RecordBatch, repeats: tuple, size: int, powers: tuple, fields: list[str]):
    ids = _doc_ids(piece.column("doc_id"))
    words = Words(*text_buffers(piece.column("text")), NOT_SPACE)
    one, _, text, starts = _windows(words, size, powers)
    docs, at, tags = repeats
    gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
    lo, hi = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
    # window of text i at start s is entry offset[i] + s of this batch's window arrays
    counts = np.bincount(text, minlength=len(ids))
    offset = np.concatenate(([0], np.cumsum(counts)[:-1]))
    pick, row = _matches(lo, hi), np.repeat(np.arange(len(ids)), hi - lo)
    ok = at[pick] < counts[row]
    pick, row = pick[ok], row[ok]
    window = offset[row] + at[pick]
    window = window[one[window].astype(np.uint32) == tags[pick]]  # rows may share a doc_id
    begin = np.unique(words.bounds[text[window]] + starts[window])
    np.add.at(gone, begin, 1)
    np.add.at(gone, begin + size, -1)
    covered = np.cumsum(gone[:-1]) > 0
    n_words = np.diff(words.bounds)
    sums = np.concatenate(([0], np.cumsum(covered)))
    n_removed = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
    data = words.data.tobytes()
    kept, spans = [], []
    for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
        keep = np.flatnonzero(~covered[a:b]) + a if n_removed[i] else np.arange(a, b)
        s, e = words.starts[keep].tolist(), words.ends[keep].tolist()
        kept.append(b" ".join([data[x:y] for x, y in zip(s, e, strict=True)]))
        if "removed_spans" in fields:
            edge = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
    made = {
        "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
    }
    if "kept_text" in fields:
        made["kept_text"] = pa.array([x.decode("utf-8") for x in kept])
    if "removed_spans" in fields:
        made["removed_spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays([made[f] if f in made else piece.column(f) for f in fields], fields)


def substring_dedup(documents: DataFrame, *, size: int = WINDOW, buckets: int | None = None,
                    carry: list[str] | None = None, outputs: tuple[str, ...] = ("kept_text", "removed_spans")) -> DataFrame:
    """Documents with n_words, n_removed, kept_sha256 and the named ``outputs``.

    ``carry`` names the input columns to keep (default: all but text).  ``buckets`` sets how finely
    windows are dealt (default: two for each shuffle partition); one bucket must fit in a task's memory.  ``removed_spans`` are word ranges, the first word being 0.
    """
    spark = documents.sparkSession
    made = ["n_words", "n_removed", "kept_sha256", *outputs]
    carry = carried(documents, carry, made, drop=("text",))
    documents, plain = named_apart(documents)
    carry = [plain[c] for c in carry]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 2 * parts
    packed = documents.select("doc_id", "text").mapInArrow(tidy(_hash_windows(size, buckets, parts)), _PACKED)
    repeats = packed.repartition(parts, "part").mapInArrow(tidy(_count_windows(parts)), _PACKED)
    needed = list(dict.fromkeys([*carry, "doc_id", "text"]))
    own = documents.select(*needed, F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))), F.lit(parts)).alias("__part"), F.lit(None).cast("binary").alias("__body"))
    there = repeats.select(*[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in needed],
                           F.col("part").alias("__part"), F.col("body").alias("__body"))
    both = (own.unionByName(there).repartition(parts, "__part")
            .sortWithinPartitions("__part", F.col("__body").isNull()))
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType(),
             "removed_spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))}
    fields = [*carry, *made]
    schema = T.StructType([T.StructField(c, kinds[c] if c in kinds and c in made else documents.schema[c].dataType) for c in fields])
    return named_back(both.mapInArrow(tidy(_remove(size, fields)), schema), plain)


def without_repeats(documents: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """The documents with their repeats cut out, columns as they were; untouched texts stay as they are.

    A text that lost words is its kept words joined by one space, and n_chars, if there is such a column, is its length.
    """
    plain = documents.toDF(*[c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(documents.columns)])
    cut = substring_dedup(plain, size=size, carry=plain.columns, outputs=("kept_text",))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = {c: F.col(p) for c, p in zip(documents.columns, plain.columns, strict=True)}
    if "n_chars" in out:
        kept = F.char_length("kept_text").cast(documents.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_removed") > 0, kept).otherwise(out["n_chars"])
    return cut.select(*[x.alias(c) for c, x in (out | {"text": text}).items()])


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(len(words) - 19)) AS pos, words FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, pos, md5_number(array_to_string(words[pos + 1:pos + 20], ' ')) AS seq FROM g),
r AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, pos + t.i AS pos FROM r, range(20) t(i)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
k AS (SELECT p.doc_id, count(c.pos) AS gone, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


@query("op1_substring_dedup", ORACLE)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"], outputs=())
