"""Quality rules: base counts, and zstandard ratios that must lie in a band for the text's length.

A text's ratio is its UTF-8 bytes over its compressed bytes.  Prose compresses better the longer it is, so each length has
limits of its own: a smaller ratio is incompressible text (encoded data, noise), a larger one is repetitive.  Limits are wider
than what prose shows at that length, so that plain documents stay.

A text is rejected when its whole ratio leaves the band of its length, or when more than ``most_bad`` of its bytes lie in
fixed chunks whose own ratios leave theirs.  The whole finds repeats far apart, the chunks find a bad part that a long good
text hides.

Every text is read once, whole, in pieces cut at white space; a task holds one text, its distinct words and one number a word.

Nulls and odd rows: null and empty texts have zero words and fail; repeated rows and null doc_ids are judged one by one; an empty
table gives no rows; input columns with an output's name give way to it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.registry import query, table
from parcelflow.llm.textbatch import slices

LEVEL = 3
CHUNK_BYTES = 4096
MOST_BAD = 0.25
MIN_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
_WHITE_BYTE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_PIECE_BYTES = 1 << 20
_SLICE_BYTES = 2 << 20
_FACTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
          ("ratio", T.DoubleType()), ("bad_chunk_bytes", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


class Band(NamedTuple):
    """The limits of the ratio for texts of ``from_bytes`` and more."""

    from_bytes: int
    least: float
    most: float


#: Parameter.  Below 64 bytes the compressor's own header decides, so there is no limit.
BANDS = [Band(0, 0.0, float("inf")), Band(64, 0.7, 2.5), Band(256, 1.05, 3.0), Band(512, 1.2, 3.2), Band(1024, 1.4, 3.4), Band(4096, 1.6, 3.6),
         Band(16384, 1.7, 4.0), Band(65536, 1.75, 4.5), Band(1 << 20, 1.75, 5.0)]


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word of a UTF-8 text, the same for equal words."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        cut = _WHITE_BYTE.search(data, at + _PIECE_BYTES)
        end = cut.start() if cut else len(data)
        # bytes.split cuts at space and the ASCII controls tab to carriage return
        piece = data[at:end]
        parts.append(np.array([known.setdefault(w, len(known)) for w in piece.split()], dtype=np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def repeated_words(numbers: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    key = numbers[:n]
    for i in range(1, size):  # pairs of (numbered prefix, next word), numbered again so that keys stay small
        pair = key * (int(numbers.max()) + 1) + numbers[i:n + i]
        _, key = np.unique(pair, return_inverse=True)
    again = np.bincount(key)[key] > 1
    edges = np.zeros(len(numbers) + 1, dtype=np.int64)
    edges[:n] += again
    edges[size:size + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


class Judge:
    """Ratios of texts against the bands."""

    def __init__(self, bands: list[Band], level: int, chunk_bytes: int):
        import zstandard

        self.starts = [b.from_bytes for b in bands]
        self.bands, self.chunk_bytes = bands, chunk_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 0.0

    def inside(self, n: int, ratio: float) -> bool:
        band = self.bands[int(np.searchsorted(self.starts, n, side="right")) - 1]
        return band.least <= ratio <= band.most

    def bad_chunk_bytes(self, data: bytes) -> int:
        """Bytes in chunks that leave their band; a text of one chunk is judged whole only."""
        if len(data) <= self.chunk_bytes:
            return 0
        chunks = (data[i:i + self.chunk_bytes] for i in range(0, len(data), self.chunk_bytes))
        return sum(len(c) for c in chunks if not self.inside(len(c), self.ratio(c)))


def compression_bands(documents: DataFrame, *, bands: list[Band] = BANDS, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES,
                      most_bad: float = MOST_BAD, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, carry: list[str] | None = None) -> DataFrame:
    """One row a document: carried columns (default: all but text), the base counts, ratio, bad_chunk_bytes, base_failed and kept.

    ``bands`` rise by from_bytes and start at 0; ``most_bad`` is a share of the text's bytes, ``most_repeated`` a percentage of its words.
    """
    carry = carried(documents, carry, [name for name, _ in _FACTS], drop=("text",))
    made = [T.StructField(name, kind) for name, kind in _FACTS]

    def run(batches):
        judge = Judge(bands, level, chunk_bytes)

        def facts(text: str | None) -> tuple:
            text = text or ""
            data = text.encode()
            numbers = word_numbers(data)
            n, repeated = len(numbers), repeated_words(numbers)
            failed = n < min_words or 100 * repeated > most_repeated * n
            ratio, bad = judge.ratio(data), judge.bad_chunk_bytes(data)
            kept = not failed and judge.inside(len(data), ratio) and bad <= most_bad * len(data)
            return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, ratio, bad, failed, kept)

        arrow = (*[pa.int64()] * 5, pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                numbers = zip(*map(facts, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *[pa.array(x, kind) for x, kind in zip(numbers, arrow, strict=True)]],
                                                 [*carry, *[name for name, _ in _FACTS]])

    fields = [documents.schema[c] for c in carry]
    return documents.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, T.StructType([*fields, *made]))


@query("op12_compression_bands")
def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"), carry=["doc_id"])
