"""SimHash near-duplicates: Golay keys of fingerprint segments, pigeonhole, join and verify.

A document's fingerprint has a bit set where over half of its shingle hashes have it.  Fingerprints
that differ in at most two bits are linked, and documents of linked fingerprints share a component.

* The 64 bits are cut into segments of 23, 23 and 18 bits.  Two errors leave one segment free of
  errors, and the segment after it (cyclically) has two errors at most, so both fingerprints share one of
  its nearby Golay codewords.  The pair (exact segment, codeword index) is a key; a fingerprint has 3 to 18.
* Only distinct fingerprints are keyed, so exact copies cost one row whatever their number.
* A bucket never pairs its members off.  Two fingerprints are within two bits when they have a value within
  one bit of both in common, so each member is listed under its one-bit neighbours (only those that keep
  the exact segment), members that meet are compared by their actual distance, and a bucket
  returns a spanning forest: one edge a member at most.
* Components come from large-star and small-star rounds over these edges.

Nulls and odd rows: null and empty texts have fingerprint zero and are linked like any other; a null
doc_id stays null and takes no part in the smallest doc_id; repeated rows stay, in one component; a
component of null doc_ids only has a null component_id; an empty table gives no rows; input columns named fp, fingerprint
or component_id give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.components import connected_components
from parcelflow.llm.golay import nearby_indices
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import LOWER, NOT_SPACE, Words, mix, slices, text_buffers
from parcelflow.sources.storage import materialise

SHINGLE = 3
SEED = 42
MOST_BITS = 2
_NO_ID = -(1 << 63)
#: (lowest bit, number of bits) of the segments
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_SLICE_BYTES = 4 << 20
_BLOCK = 2_000_000


def _shingle_digests(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 digests of all shingles (eight bytes each, high byte first) and the range of each text."""
    lens = words.ends - words.starts
    begins = np.concatenate(([0], np.cumsum(lens + 1)))
    joined = np.full(begins[-1], 0x20, dtype=np.uint8)
    to = np.arange(lens.sum()) + np.repeat(np.arange(len(lens)), lens)
    joined[to] = words.data[np.repeat(words.starts - (begins[:-1] - np.arange(len(lens))), lens) + np.arange(lens.sum())]
    text = joined.tobytes()
    n_words = np.diff(words.bounds)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(words.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    last = np.minimum(first + size, np.repeat(words.bounds[1:], n)) - 1
    digest = xxhash.xxh64_digest
    out = b"".join([digest(text[a:b], SEED) for a, b in zip(begins[first].tolist(), (begins[last] + lens[last]).tolist(), strict=True)])
    return np.frombuffer(out, dtype=np.uint8).reshape(-1, 8), bounds


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as a signed 64-bit number."""
    data, offsets = text_buffers(texts)
    digests, bounds = _shingle_digests(Words(LOWER[data], offsets, NOT_SPACE), size)
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            ones = np.zeros(64, dtype=np.int64)
            for c in range(a, b, 1 << 16):
                ones += np.unpackbits(digests[c:min(b, c + (1 << 16))], axis=1).sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > b - a).view(">i8")[0]
    return out


def with_fingerprints(documents: DataFrame, carry: list[str], size: int = SHINGLE) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a long."""
    fields = [f for f in documents.select(*carry).schema]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                fp = pa.array(fingerprints(piece.column("text"), size))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carry], fp], [*carry, "fp"])

    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) for each key of each fingerprint; the top bits of a key say which segment is exact."""
    bits = fp.view(np.uint64).astype(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    keys, owners = [], []
    for which, exact in enumerate(parts):
        near = nearby_indices(parts[(which + 1) % len(parts)])
        key = (which << 35) | (exact[:, None] << 12) | near
        ok = near >= 0
        keys.append(key[ok])
        owners.append(np.broadcast_to(fp[:, None], near.shape)[ok])
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(batches):
    for batch in batches:
        key, fp = golay_keys(batch.column("fp").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _masks(which: int) -> np.ndarray:
    """No change, and each one-bit change outside the exact segment."""
    low, n = SEGMENTS[which]
    return np.array([0, *(1 << b for b in range(64) if not low <= b < low + n)], dtype=np.uint64)


def _forest(group: np.ndarray, fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each member of the (sorted) groups, the index of its tree's root."""
    root = np.arange(len(fp))
    bits = fp.view(np.uint64)
    salt = mix(group.astype(np.uint64))
    rounds = -(-len(fp) * len(masks) // _BLOCK)
    for r in range(rounds):
        met, who = [], []
        for m in masks:
            h = mix((bits ^ m) ^ salt)
            mine = np.flatnonzero(h % np.uint64(rounds) == r) if rounds > 1 else np.arange(len(h))
            met.append(h[mine])
            who.append(mine)
        met, who = np.concatenate(met), np.concatenate(who)
        order = np.argsort(met, kind="stable")
        met, who = met[order], who[order]
        same = np.flatnonzero(met[1:] == met[:-1])
        a, b = who[same], who[same + 1]
        ok = (group[a] == group[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= MOST_BITS)
        root = _union(root, a[ok], b[ok])
    return root


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of a and b, smallest index on top, until no edge joins two trees."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _bucket_edges(batches):
    """Rows sorted by key; complete buckets are linked, the last one waits for the next batch."""
    schema = ["a", "b"]

    def linked(key, fp):
        again = np.zeros(len(key), dtype=bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= key[1:] == key[:-1]
        key, fp = key[again], fp[again]
        for which in range(len(SEGMENTS)):
            lo, hi = np.searchsorted(key, [which << 35, (which + 1) << 35])
            k, f = key[lo:hi], fp[lo:hi]
            if len(f):
                group = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
                root = _forest(group, f, _masks(which))
                child = np.flatnonzero(root != np.arange(len(f)))
                yield pa.RecordBatch.from_arrays([pa.array(f[child]), pa.array(f[root[child]])], schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            held.append((key[:cut], fp[:cut]))
        if cut or (held and held[-1][0][-1] != key[0]):
            yield from linked(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield from linked(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_edges(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the linked fingerprints of a table of distinct ones."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(_key_rows, "key long, fp long")
    return (keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(_bucket_edges, "a long, b long").distinct())


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """A table of distinct fingerprints with the ``label`` of each one's component."""
    labels = connected_components(fingerprint_edges(distinct))
    return (distinct.join(labels, distinct["fp"] == labels["node"], "left")
            .select(*distinct.columns, F.coalesce("label", "fp").alias("label")))


def simhash_components(documents: DataFrame, *, carry: list[str] | None = None, size: int = SHINGLE) -> DataFrame:
    """The carried columns (default: all but text), fingerprint and component_id of every row."""
    carry = carried(documents, carry, ["fp", "fingerprint", "component_id"], drop=("text",))
    rows = materialise(with_fingerprints(documents, list(dict.fromkeys([*carry, "doc_id"])), size), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    named = fingerprint_components(distinct)
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(smallest, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, *, size: int = SHINGLE) -> DataFrame:
    """The documents with one row of each component: the one with the smallest doc_id.

    Rows that share a doc_id (or have none) and a fingerprint collapse to the one with the smallest text hash.
    """
    plain = documents.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(documents.columns)])
    # keys without nulls: the join's partitioning then serves the last step as well, and texts move once
    row = ["__text_key", "__id"]
    marked = plain.withColumns({"__text_key": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))})
    found = simhash_components(marked, carry=["doc_id", *row], size=size)
    keep = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("__id", "fingerprint").agg(F.min("__text_key").alias("__text_key")))
    return marked.join(keep, row, "left_semi").dropDuplicates(row).select(*plain.columns).toDF(*documents.columns)


@query("op8_simhash_golay")
def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), carry=["doc_id"])
