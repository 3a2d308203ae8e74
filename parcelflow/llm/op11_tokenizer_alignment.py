"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Each text is encoded by A (byte-level BPE) and B (pieces).  Both token lists tile the same bytes.  Every token points to
its farthest-right overlapping token of the other side, the one that holds its last byte; where an A and a B token end
together, A points to B and B to itself.  All pointers of a slice of texts are doubled at once (successor of the
successor) until none moves; every token then points to the last token of its component, which names its group.

A pair of ids is linked where two tokens end together.  Links are counted over the corpus:

* A block of texts (about 1 MB, one text at least) lists its distinct pairs once, so what is counted and what is sent
  back is one row for each block and pair, not one for each link.  Frequent pairs combine before the shuffle.
* Counts come back to their blocks by (block, place in the block's list); documents hold places and how often they use them.
* No count table stands in the driver or is broadcast.

Blocks are written to the shared folder once, so block numbers stay what they are when executors are lost.

Nulls and odd rows: texts that are null, empty, or whose tokens do not give the text's bytes back (a text that holds U+2581,
for example) have no tokens: zeros and an empty digest; repeated rows and null doc_ids are rows of their own and count each time;
an empty table gives no rows; strings of special tokens are plain text; input columns with an output's name give way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.byte_bpe import plain_encoder, read_ranks
from parcelflow.llm.carry import carried
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import slices
from parcelflow.llm.worker import once
from parcelflow.sources.storage import materialise

BLOCK_BYTES = 1 << 20
#: a pair of ids in one number
_ID_BITS = 32
_MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: <0xHH> is a byte, U+2581 a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer: its encoder, and the bytes, byte length and decimal digits of every id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        written = [str(i).encode() for i in range(len(tokens))]
        self.n_digits = np.array([len(w) for w in written], dtype=np.int64)
        self.digits = np.zeros((len(tokens), 7), dtype=np.uint8)
        for i, w in enumerate(written):
            self.digits[i, :len(w)] = np.frombuffer(w, dtype=np.uint8)

    def ids(self, text: str, meant: bytes) -> list[int] | None:
        """The ids of a text, if their bytes are the ones meant."""
        ids = self.encode(text)
        return ids if b"".join([self.tokens[i] for i in ids]) == meant else None


def byte_side(path: str) -> Side:
    """The byte-level BPE of a tokenizers file, read from the rank list of the same vocabulary."""
    ranks = read_ranks(path.removesuffix(".json") + ".tiktoken")
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Side(plain_encoder(ranks), tokens)


def piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Side(lambda text: model.encode(text, num_threads=1), [piece_bytes(p) for p in model.id_to_piece(list(range(model.get_piece_size())))])


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the B token that ends its group; ends rise, and the last two are equal."""
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    nodes = np.arange(n, n + len(b_ends))
    # nodes: A tokens, then B tokens
    pointer = np.concatenate([to_b + n, np.where(a_ends[to_a] == b_ends, nodes, to_a)])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer[:n] - n, pointer[n:] - n
        pointer = further


def written_groups(a: Side, b: Side, a_ids, b_ids, a_group, b_group, a_bounds, b_bounds) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text; groups are numbered over all texts in order."""
    n, m = len(a_ids), len(b_ids)
    # groups are in order on both sides: a token stands behind the other side's tokens of the groups before it
    a_at = np.arange(n) + np.searchsorted(b_group, a_group, side="left")
    b_at = np.arange(m) + np.searchsorted(a_group, b_group, side="right")
    size = np.empty(n + m, dtype=np.int64)
    size[a_at], size[b_at] = a.n_digits[a_ids] + 1, b.n_digits[b_ids] + 1
    grid = np.empty((n + m, a.digits.shape[1]), dtype=np.uint8)
    grid[a_at], grid[b_at] = a.digits[a_ids], b.digits[b_ids]
    a_last = np.append(a_group[1:] != a_group[:-1], True)
    b_last = np.append(b_group[1:] != b_group[:-1], True)
    mark = np.empty(n + m, dtype=np.uint8)
    mark[a_at] = np.where(a_last, ord("|"), ord(","))
    mark[b_at] = np.where(b_last, ord(";"), ord(","))
    grid[np.arange(n + m), size - 1] = mark
    flat = grid[np.arange(grid.shape[1]) < size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[a_bounds + b_bounds]
    # the last mark of a text is no separator
    return [flat[x:y - 1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def aligned(texts: list[str | None], a: Side, b: Side) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text (n_a, n_b, n_groups, digest) and its links as places and times; the block's distinct pairs and their times."""
    a_lists, b_lists, some = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        meant = b" " + text.encode()
        a_ids = a.ids(" " + text, meant)
        b_ids = b.ids(text, meant) if a_ids is not None else None
        if b_ids is not None:
            a_lists.append(a_ids)
            b_lists.append(b_ids)
            some.append(i)
    facts = [(0, 0, 0, "")] * len(texts)
    none = np.zeros(0, dtype=np.int64)
    places, times = [none] * len(texts), [none] * len(texts)
    if not some:
        return facts, places, times, none, none
    a_bounds, b_bounds = (np.cumsum([0, *map(len, x)]) for x in (a_lists, b_lists))
    a_ids, b_ids = (np.concatenate([np.array(x, dtype=np.int64) for x in lists]) for lists in (a_lists, b_lists))
    a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    a_group, b_group = terminals(a_ends, b_ends)
    digests = written_groups(a, b, a_ids, b_ids, a_group, b_group, a_bounds, b_bounds)
    a_last = np.flatnonzero(np.append(a_group[1:] != a_group[:-1], True))
    b_last = a_group[a_last]
    links = (a_ids[a_last] << _ID_BITS) | b_ids[b_last]
    pairs, place, n = np.unique(links, return_inverse=True, return_counts=True)
    cuts = np.searchsorted(a_last, a_bounds)
    for k, i in enumerate(some):
        own = place[cuts[k]:cuts[k + 1]]
        places[i], times[i] = np.unique(own, return_counts=True)
        facts[i] = (len(a_lists[k]), len(b_lists[k]), len(own), hashlib.sha256(digests[k]).hexdigest())
    return facts, places, times, pairs, n


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def _blocks(documents: DataFrame, carry: list[str], path_a: str, path_b: str) -> DataFrame:
    """One row a document; the first row of a block also has the block's pairs."""
    row = documents.select(F.struct(*carry).alias("row") if carry else F.lit(None).cast("int").alias("row"), "text")
    schema = T.StructType([row.schema["row"], *T.StructType.fromDDL(
        "block long, n_a long, n_b long, n_groups long, groups_sha256 string, places array<int>, times array<int>, pairs array<long>, pair_times array<long>")])

    def run(batches):
        a, b = once(("aligned", path_a, path_b), lambda: (byte_side(path_a), piece_side(path_b)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                facts, places, times, pairs, n = aligned(part.column("text").to_pylist(), a, b)
                rest = [None] * (len(facts) - 1)
                numbers = list(zip(*facts, strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array([block] * len(facts), pa.int64()), *[pa.array(x, pa.int64()) for x in numbers[:3]], pa.array(numbers[3]),
                    _lists(places, pa.int32()), _lists(times, pa.int32()),
                    pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([n, *rest], pa.list_(pa.int64()))], schema.names)
                block += 1

    return row.mapInArrow(run, schema)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, count, best) of the listed (pair, times): links over the corpus, and whether no other A id has more with the B id."""
    counts = listed.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(documents: DataFrame, *, tokenizer_a: str | None = None, tokenizer_b: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row a document: carried columns (default: all but text), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``tokenizer_a`` is a byte-level BPE file, ``tokenizer_b`` a piece model.
    """
    carry = carried(documents, carry, _MADE, drop=("text",))
    path_a, path_b = tokenizer_a or public_tokenizers.path("byte_bpe_50k.json"), tokenizer_b or public_tokenizers.path("piece_bpe_32k.model")
    blocks = materialise(_blocks(documents, carry, path_a, path_b), "aligned-blocks")
    listed = (blocks.filter("pairs IS NOT NULL")
              .select("block", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("place", "link"))
              .select("block", "place", F.col("link.pairs").alias("pair"), F.col("link.pair_times").alias("times")))
    counts = materialise(pair_counts(listed), "pair-counts")
    counted = listed.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    own = blocks.select("block", "row", "n_a", "n_b", "n_groups", "groups_sha256", "places", "times")
    schema = T.StructType([own.schema["row"], *T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")])

    def summed(docs: pa.Table, links: pa.Table) -> pa.Table:
        size = links.num_rows
        count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        place = links.column("place").to_numpy()
        count[place], best[place] = links.column("count").to_numpy(), links.column("best").to_numpy(zero_copy_only=False)
        places, times = (docs.column(c).combine_chunks() for c in ("places", "times"))
        ends = np.concatenate([[0], np.cumsum(np.diff(places.offsets.to_numpy()))])
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def total(x):
            sums = np.concatenate([[0], np.cumsum(x)])
            return pa.array(sums[ends[1:]] - sums[ends[:-1]])

        n_groups = docs.column("n_groups")
        return pa.Table.from_arrays([
            docs.column("row"), docs.column("n_a"), docs.column("n_b"), n_groups, n_groups,
            total(n * best[at]), total(n * count[at]), docs.column("groups_sha256")], schema.names)

    out = own.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(summed, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in carry], *_MADE)


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), carry=["doc_id"])
