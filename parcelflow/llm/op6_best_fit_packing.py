"""Best-fit packing of tokenised documents into sequences, by large-item matching.

Pieces above a third of the capacity are large: at most two share a sequence.  The largest unpaired one takes
the largest partner that still fits (greedy matching); smaller pieces then go, largest first, where they fit
best: into the sequence with the least room that still takes them, or a new one.

Lengths are whole numbers up to the capacity, so all of this is done on the histogram of lengths, at most
``capacity`` counts, and yields layouts that repeat over a range of sequences.  The number of layouts
depends on the capacity, not on the corpus.  Each piece then finds its place from its rank among the pieces of its
length.  Ranks are counted inside salted groups (length, salt), so a length that a third of all pieces
share is ranked in parallel.

Nulls and odd rows: null and empty texts are one piece of the end token alone; rows are packed one by
one, so repeated rows and null doc_ids each get a place of their own; an empty table gives no rows; input columns with
an output's name give way to it.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from parcelflow.llm.byte_bpe import plain_encoder, read_ranks
from parcelflow.llm.carry import carried, named_apart, named_back
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import slices, text_buffers
from parcelflow.llm.worker import once, tidy
from parcelflow.sources.storage import materialise

CAPACITY = 2048
END = 0
_SLICE_BYTES = 512 << 10
_PLACED_ROWS = 512


def _encoder(path: str):
    """The byte-level BPE of the tokenizers file ``path``, through its rank list (the same ids, several times faster).

    The file's added tokens are one id each wherever a text holds them, and cut the text around them, as in tokenizers.
    """
    with open(path, encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    ordinary = plain_encoder(read_ranks(path.removesuffix(".json") + ".tiktoken"))
    if not added:
        return ordinary
    # where several begin at one place, the longest is meant
    any_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        parts = any_added.split(text)
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) for i in ((added[part],) if k % 2 else ordinary(part))]

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole pieces behind a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def tokenised_pieces(documents: DataFrame, *, tokenizer: str, capacity: int = CAPACITY, carry: list[str], ids: bool = True) -> DataFrame:
    """One row a piece: carried columns, piece, start, length, ids_crc32 and, with ``ids``, its token ids.

    The ids are little-endian 32-bit bytes; :func:`pack` turns them into numbers.  Spark reads a batch of lists of numbers with
    levels for each number, several times the memory of the same bytes.
    """
    fields = [documents.schema[c] for c in carry]
    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.BinaryType())] if ids else [])

    def run(batches):
        encode = once(("encoder", tokenizer), lambda: _encoder(tokenizer))
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                row, rows, tokens = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    all_ids = np.array([*encode(text or ""), END], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(all_ids), capacity)):
                        piece = all_ids[start:start + length]
                        row.append(i)
                        rows.append((k, start, length, zlib.crc32(piece.tobytes())))
                        if ids:
                            tokens.append(piece.tobytes())
                taken = part.select(carry).take(pa.array(row, pa.int64()))
                numbers = list(zip(*rows, strict=True))
                columns = [*taken.columns, *[pa.array(x, kind) for x, kind in zip(numbers, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]]
                if ids:
                    columns.append(pa.array(tokens, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*fields, *made]])

    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), T.StructType([*fields, *made]))


def _id_lists(column: pa.Array) -> pa.Array:
    """Lists of 32-bit numbers out of their bytes."""
    data, offsets = text_buffers(column)
    return pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(np.frombuffer(data.tobytes(), "<i4").astype(np.int32)))


class Layouts:
    """Ranges of equal sequences under construction, by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.by_room: dict[int, list[list[int]]] = {}
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        #: (length, first rank, first sequence, count, offset): ranks map to sequences one by one
        self.places: list[tuple[int, int, int, int, int]] = []

    def open(self, count: int) -> list[int]:
        self.sequences += count
        return [self.sequences - count, count, 0]

    def put(self, where: list[int], length: int) -> None:
        first, count, filled = where
        self.places.append((length, int(self.used[length]), first, count, filled))
        self.used[length] += count
        where[2] += length

    def keep(self, where: list[int]) -> None:
        if where[1]:
            self.by_room.setdefault(self.capacity - where[2], []).append(where)

    def split(self, where: list[int], count: int) -> list[int]:
        """The first ``count`` sequences of a range; the rest stays in it."""
        head = [where[0], count, where[2]]
        where[0] += count
        where[1] -= count
        return head


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Layouts:
    """Where the pieces of each length go, by their rank among equals."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = Layouts(capacity)
    large = capacity // 3
    for length in range(capacity, large, -1):
        while left[length]:
            fits = np.flatnonzero(left[large + 1:min(capacity - length, length) + 1]) if capacity - length > large else []
            partner = large + 1 + int(fits[-1]) if len(fits) else 0
            n = int(left[length] // 2 if partner == length else min(left[length], left[partner]) if partner else left[length])
            if n == 0:  # a single one, whose only partner would be itself
                smaller = [x for x in fits[:-1]]
                partner = large + 1 + int(smaller[-1]) if len(smaller) else 0
                n = 1
            where = out.open(n)
            for x in (length, partner) if partner else (length,):
                out.put(where, x)
                left[x] -= n
            out.keep(where)
    for length in range(large, 0, -1):
        while left[length]:
            room = min((r for r, ranges in out.by_room.items() if r >= length and ranges), default=None)
            if room is None:
                where, room = out.open(int(-(-left[length] // (capacity // length)))), capacity
            else:
                where = out.by_room[room].pop()
            each = room // length
            whole = min(where[1], int(left[length] // each))
            if whole:
                head = out.split(where, whole)
                for _ in range(each):
                    out.put(head, length)
                left[length] -= whole * each
                out.keep(head)
            if left[length] and where[1]:  # the last sequence takes what is left, less than it could hold
                head = out.split(where, 1)
                for _ in range(int(left[length])):
                    out.put(head, length)
                left[length] = 0
                out.keep(head)
            out.keep(where)
    return out


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, salts: int | None = None, packed: str | None = None) -> DataFrame:
    """The pieces (with a ``length``) and their sequence_id and offset.

    ``salts`` is the number of groups that share the ranking of one length (default: four for each
    shuffle partition).  The bytes in the column ``packed`` become lists of numbers.
    """
    salts = salts or 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    identity = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*identity), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    # one row for each length there is, so the capacity bounds what comes to the driver
    layouts = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    places = np.array(layouts.places, dtype=np.int64).reshape(-1, 5)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    # (length, rank) in one number, in order
    firsts = places[:, 0] * (1 << 48) + places[:, 1]
    carried = pieces.columns
    columns = [*carried, "sequence_id", "offset"]

    def place(batches):
        for batch in (whole.slice(i, _PLACED_ROWS) for whole in batches for i in range(0, whole.num_rows, _PLACED_ROWS)):
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(firsts, batch.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            sequence = places[at, 2] + rank - places[at, 1]
            kept = [_id_lists(batch.column(c)) if c == packed else batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(places[at, 4])], columns)

    order = Window.partitionBy("length", "__salt").orderBy(*identity)
    ranked = (salted.withColumn("__n", F.row_number().over(order) - 1).join(before, ["length", "__salt"])
              .select(*carried, (F.col("__before") + F.col("__n")).alias("__rank")))
    fields = [T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name == packed else f for f in pieces.schema]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(place), schema)


def best_fit_packing(documents: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, carry: list[str] | None = None,
                     ids: bool = True) -> DataFrame:
    """One row a piece: carried columns (default: all but text), piece, start, length, ids_crc32, ids, sequence_id and offset."""
    made = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    carry = carried(documents, carry, made, drop=("text",))
    documents, plain = named_apart(documents)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = tokenised_pieces(documents, tokenizer=path, capacity=capacity, carry=[plain[c] for c in carry], ids=ids)
    return named_back(pack(materialise(pieces, "pieces"), capacity=capacity, packed="ids" if ids else None), plain)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), carry=["doc_id"], ids=False)
