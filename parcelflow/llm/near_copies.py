"""One document of each group of near copies: SimHash and MinHash find candidates, exact Jaccard similarity decides.

A document is the set of its 5-word shingles (lower-case ASCII; a text of fewer words is one shingle).  Documents with a
Jaccard similarity of 0.8 or more are linked, and linked documents share a group.

* Documents with equal sets are one node, so exact copies cost one row whatever their number.
* Operator 8 links the nodes' fingerprints (SimHash by Golay keys, two bits); nodes of one of its components share a bucket.  Two bits
  find very small edits only, so there are more buckets:
* A node has 32 bands of four MinHash values.  Two nodes of similarity s share a band with probability
  1 - (1 - s**4)**32: all but 5 of 100 million pairs at 0.8, more above.  Pairs whose set sizes alone rule out 0.8 are never formed.
* Leader rounds: the node of a bucket that meets most others over all its buckets leads it (the original of a family of copies does),
  and every other node of the bucket is compared with it.  The second round does so among the nodes that the largest group of
  a bucket left out.  A round costs one row for each place in a bucket, whatever its size.
* Nodes whose buckets still hold several groups are settled by an exact prefix join: shingles that only one of these nodes has are
  rarest, then the others by how many nodes have them; nodes of similarity 0.8 share one of their n - ceil(0.8 n) + 1 rarest
  shingles.  A passage that many documents share is no rare shingle of any of them.
* A pair counts when the intersection of the whole shingle sets says so; sets are made for nodes that share a bucket only.

Nulls and odd rows: texts without words are copies of each other; of a group, the row with the smallest doc_id stays (null ids
last), and of its rows the one with the smallest text hash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parcelflow.llm.components import connected_components
from parcelflow.llm.op8_simhash_golay import fingerprint_components, fingerprints
from parcelflow.llm.textbatch import LOWER, NOT_SPACE, Powers, Words, byte_powers, mix, slices, text_buffers, window_hashes
from parcelflow.llm.worker import tidy
from parcelflow.sources.storage import materialise

SHINGLE = 5
ALIKE = 0.8
BANDS, BAND_ROWS = 32, 4
_NO_ID = -(1 << 63)
_SLICE_BYTES = 512 << 10
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    data, offsets = text_buffers(texts)
    words = Words(LOWER[data], offsets, NOT_SPACE)
    hashes, powers = words.hashes(byte_powers()), Powers(_WORD_BASE)
    whole = window_hashes(hashes, size, powers)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a:b - size + 1]))
        else:
            out.append(mix(window_hashes(hashes[a:b], b - a, powers) + np.uint64(b - a)) if b > a else hashes[:0])
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; sets must not be empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.stack([np.minimum.reduceat((values ^ x) * (m | np.uint64(1)), starts) for x, m in _SEEDS.T], axis=1)
    least = mix(least).reshape(len(sets), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
    for i in range(BAND_ROWS):
        key = mix(key * np.uint64(3) + least[:, :, i])
    return key.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def _with_keys(documents: DataFrame, carry: list[str], size: int) -> DataFrame:
    """The carried columns, ``fp`` (operator 8's fingerprint), ``digest`` and ``size`` of the shingle set and its band ``keys``."""
    schema = T.StructType([*documents.select(*carry).schema, T.StructField("fp", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                sets = shingle_sets(part.column("text"), size)
                some = [s for s in sets if len(s)]
                made = iter(band_keys(some).view(np.uint64)) if some else iter(())
                keys = [next(made) if len(s) else s for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(fingerprints(part.column("text"))), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), _lists(keys)], schema.names)

    return documents.select(*carry, "text").mapInArrow(tidy(run), schema)


def _with_sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(shingle_sets(part.column("text"), size))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"__{n}")) for n in "ab")
    both = F.size(F.array_intersect("__a", "__b"))
    near = pairs.join(one, "a").join(two, "b")
    # the quotient of two whole numbers is rounded as the bound itself is
    return near.filter(both / (F.size("__a") + F.size("__b") - both) >= alike).select("a", "b")


def _sizes_allow(a: str, b: str, alike: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= alike


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _simhash_postings(nodes: DataFrame) -> DataFrame:
    """(node, size, key): a bucket for each component of the nodes' fingerprints ``fp``."""
    distinct = materialise(nodes.select("fp").distinct(), "distinct-fingerprints")
    return nodes.join(fingerprint_components(distinct), "fp").select("node", "size", F.xxhash64(F.lit("simhash"), "label").alias("key"))


def _shared_buckets(postings: DataFrame) -> DataFrame:
    """(key, node, size, meets) of the buckets that nodes share; ``meets`` adds up the node's buckets."""
    counts = postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    live = materialise(postings.join(counts, "key"), "shared-buckets")
    meets = live.groupBy("node").agg(F.sum("members").alias("meets"))
    return materialise(live.join(meets, "node").select("key", "node", "size", "meets"), "bucket-places")


def _led(places: DataFrame, alike: float) -> DataFrame:
    """Pairs (a, b) of each bucket's leader and its other nodes."""
    lead = places.groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("less"), "size")).alias("lead")).select(
        "key", (-F.col("lead.less")).alias("a"), F.col("lead.size").alias("size_a"))
    met = places.select("key", F.col("node").alias("b"), F.col("size").alias("size_b")).join(lead, "key")
    return _pairs(met.filter((F.col("a") != F.col("b")) & _sizes_allow("size_a", "size_b", alike)))


def _open(places: DataFrame, edges: DataFrame) -> DataFrame:
    """The places of buckets that hold several groups, with each node's ``label`` and the bucket's largest one, ``most``."""
    named = places.join(connected_components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    several = per.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    return materialise(named.join(several.select("key", "most"), "key"), "open-buckets")


def _prefix_pairs(open_: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """All pairs (a, b) of nodes in open buckets that are in different groups and may be similar enough."""
    nodes = open_.select("node", "label", "size").distinct()
    has = materialise(sets.join(nodes, "node").select("node", "label", "size", F.explode("shingles").alias("shingle")), "open-shingles")
    common = has.groupBy("shingle").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    shared = has.join(common, "shingle")
    order = Window.partitionBy("node").orderBy("nodes", "shingle")
    # the size less the shared shingles are the node's own, which are rarest
    ranked = shared.withColumns({"rank": F.row_number().over(order), "own": F.col("size") - F.count("*").over(Window.partitionBy("node"))})
    prefix = F.col("size") - F.ceil(F.col("size") * alike - 1e-9) + 1
    left = F.col("size") - F.col("rank") - F.col("own") + 1
    rare = materialise(ranked.filter(F.col("rank") + F.col("own") <= prefix).select("shingle", "node", "label", "size", left.alias("left")), "rare-shingles")
    one, two = (rare.select("shingle", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "label", "size", "left")]) for n in "ab")
    # at the first shingle that two nodes share, all they share is still to come
    enough = F.least("left_a", "left_b") >= alike / (1 + alike) * (F.col("size_a") + F.col("size_b")) - 1e-9
    met = one.join(two, "shingle").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _sizes_allow("size_a", "size_b", alike) & enough)
    return _pairs(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def one_of_near_copies(documents: DataFrame, *, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """The documents with one row of each group of near copies."""
    plain = documents.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(documents.columns)])
    # keys without nulls: the join's partitioning then serves the last step as well
    row = ["__text_key", "__id"]
    marked = plain.withColumns({"__text_key": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))})
    # a node's fingerprint is that of its best row
    best = F.struct(F.col("__null"), F.col("__id"), F.col("__text_key"), F.col("fp"))
    keyed = _with_keys(marked.withColumn("__null", F.col("doc_id").isNull()), ["__null", *row], size)
    nodes = materialise(keyed.groupBy("digest").agg(F.min(best).alias("best"), F.first("size").alias("size"), F.first("keys").alias("keys"))
                        .select(F.monotonically_increasing_id().alias("node"), "best", "best.fp", "size", "keys"), "shingle-nodes")
    places = _shared_buckets(nodes.select("node", "size", F.explode("keys").alias("key")).unionByName(_simhash_postings(nodes)))
    wanted = places.select("node").distinct().join(nodes, "node").select("node", "best.__text_key", "best.__id")
    sets = materialise(_with_sets(marked.join(wanted, row).dropDuplicates(row), size), "shingle-sets")
    edges = materialise(_alike(_led(places, alike), sets, alike), "near-copies")
    strays = _open(places, edges).filter("label <> most")
    edges = materialise(edges.unionByName(_alike(_led(strays, alike), sets, alike)), "near-copies")
    edges = edges.unionByName(_alike(_prefix_pairs(_open(places, edges), sets, alike), sets, alike))
    labels = connected_components(edges)
    keep = (nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("best").alias("best"))
            .select("best.__text_key", "best.__id"))
    return marked.join(keep, row, "left_semi").dropDuplicates(row).select(*plain.columns).toDF(*documents.columns)
