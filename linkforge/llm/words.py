"""Words as hashes: the numpy kernels that the near-copy and repeat operators share.

A word is a run of characters other than the six ASCII white-space characters. On UTF-8 that is
what ``bytes.split()`` yields, so texts stay bytes from Arrow to the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Odd multipliers for rolling hashes and for the finalizer.
BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = xxhash.xxh3_64_intdigest

#: Text bytes that a kernel holds at once; longer single texts form a slice of their own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes (one row at least)."""
    rows = batch.num_rows
    if not rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (xor-shift-multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD, tokens), dtype=np.uint64, count=len(tokens))


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ragged rows in their flat array."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def rolling(flat: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive elements, by doubling; shorter than the input by width - 1."""
    size = len(flat) - width + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    done, out = 0, None
    power, block, bits = 1, flat, width
    while bits:  # block: hashes of `power` elements
        if bits & 1:
            if out is None:
                out, done = block, power
            else:
                n = len(flat) - done - power + 1
                out = out[:n] * np.uint64(pow(BASE, power, 1 << 64)) + block[done : done + n]
                done += power
        bits >>= 1
        if bits:
            n = len(block) - power
            block = block[:n] * np.uint64(pow(BASE, power, 1 << 64)) + block[power : power + n]
            power *= 2
    return mix(out[:size])


def inside(counts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` window starts keep the window within its own row."""
    starts, ends = spans(counts)
    edge = np.zeros(size + 1, np.int32)
    real = counts >= width
    np.add.at(edge, starts[real], 1)
    np.add.at(edge, ends[real] - width + 1, -1)
    return np.cumsum(edge[:size]) > 0


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; words fewer than ``width`` make one shingle, none an empty set."""
    rows = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = hashed([w for row in rows for w in row])
    starts, ends = spans(counts)
    grams = rolling(flat, width)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(rolling(flat[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (long), text (string) and ``more``. Columns that have their type already are taken as they are:
    an alias would make equal exchanges look different and keep Spark from reusing them."""
    kinds = dict(docs.dtypes)
    own = [F.col(c) if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    return docs.select(*own, *more)
