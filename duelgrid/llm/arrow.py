"""Arrow batches in bounded pieces, and byte-level word tables over them."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.session import run_dir, written

CHUNK_BYTES = 4 << 20


ROWS_PER_FILE = 250_000


def checkpointed(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, is computed once.

    With a bound of its `rows`, a narrow table goes into as few files as that many rows need.
    """
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    return written(df, run_dir(df.sparkSession, label))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spread(docs: DataFrame, bytes_each: int, column: str = "text") -> int:
    """How many groups of about `bytes_each` bytes of text the rows fill (one at least)."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, math.ceil(total / bytes_each))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]


#: The six bytes that end a word: blank and 0x09 to 0x0D. In UTF-8 no other character holds them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a line feed after each; where each starts."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends in white space."""
    gap = SPACE[data]
    inner = ~gap
    begins = inner.copy()
    begins[1:] &= gap[:-1]
    ends = gap[1:] & inner[:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


@lru_cache(maxsize=8)
def _byte_codes(lane: int) -> np.ndarray:
    return np.random.default_rng(1000 + lane).integers(1, 2**64, 256, dtype=np.uint64)


_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LONG_WORD = 32  # bytes; a polynomial modulo 2^64 is sound for words up to here only
WORDS_AT_ONCE = 1 << 15


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes: a polynomial of short words, XXH64 of long ones."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), WORDS_AT_ONCE):
        out[i : i + WORDS_AT_ONCE] = _some_hashes(data, starts[i : i + WORDS_AT_ONCE], ends[i : i + WORDS_AT_ONCE], lane)
    return out


def _some_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    long = np.flatnonzero(ends - starts > LONG_WORD)
    digests = [xxhash.xxh64_intdigest(data[a:b].tobytes(), lane) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    lengths = np.minimum(ends - starts, LONG_WORD)
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    letters = data[inside + np.repeat(starts, lengths)]
    terms = _byte_codes(lane)[letters] * powers(_BASES[lane], int(lengths.max()))[inside]
    out = mixed(np.add.reduceat(terms, first[:-1]) + lengths.astype(np.uint64))
    out[long] = np.array(digests, np.uint64)
    return out


class Windows:
    """Hashes of `length` consecutive words, from prefix sums over one array of word hashes."""

    def __init__(self, words: np.ndarray, lane: int = 0):
        base = _BASES[1 - lane]
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=self.sums[1:])
        self.back = powers(np.uint64(pow(int(base), -1, 2**64)), len(words) + 1)

    def at(self, positions: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[positions + length] - self.sums[positions]) * self.back[positions])


class Recent:
    """A bounded memory: what was not asked for during the last `size` new entries or so is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; the caller adds them to `young`, which then holds all of `keys`."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        fresh = keys.difference(young)
        for k in fresh & old.keys():
            young[k] = old[k]
        return list(fresh.difference(young))
