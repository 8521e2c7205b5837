"""Helpers shared by the training-data operators.

Text work that built-in functions cannot express runs on Arrow batches inside
Spark tasks.  The helpers here lay a batch of texts out as one byte array so
that numpy handles all documents of a slice at once; slices are bounded in
bytes, so memory does not follow the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.stage import discard, shared_dir, stored  # noqa: F401  (re-exported to the operators)

SLICE_BYTES = 2 << 20

#: Bytes of the separator class [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text, null as 0."""
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def row_key(*columns: Column) -> Column:
    """128-bit key of a row's contents as text; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("\x01", *parts))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch into runs of whole rows of about `limit` text bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo, base = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        base, lo = ends[hi - 1], hi


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, index, data = column.buffers()
    offsets = np.frombuffer(index, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of `member` bytes, and the first word of each document (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    before = edge[edge > 0] - 1
    stops[before] = inside[before]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = _powers(1 << 12)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not overlap and come in order."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    if (most := int(size.max())) > len(_POWERS):
        _POWERS = _powers(1 << most.bit_length())
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _BYTES[data[within + np.repeat(starts, size)]] * _POWERS[within]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * _ODD)


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each `width` consecutive words inside a document, and the document's first one (n + 1 entries).

    A document of fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(firsts)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    index = np.concatenate([[0], np.cumsum(made)])
    total = int(index[-1])
    if not total:
        return np.zeros(0, np.uint64), index
    at = np.arange(total) - np.repeat(index[:-1], made) + np.repeat(firsts[:-1], made)
    left = np.repeat(firsts[1:], made) - at
    out = np.full(total, 7, np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out = mix(out * _ODD + np.where(left > k, padded[at + k], np.uint64(k + 1)))
    return out, index
