"""Packing of tokenised documents into sequences of fixed length.

Every document is encoded once, ended by a mark, and cut into full sequences and a rest. The pieces are dealt into
random groups of similar size; each group is packed on its own by first-fit decreasing: longest piece first, into the
first sequence with room. A tournament tree over the sequences' free places finds that one in logarithmic time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import Recent, give_back, pieces

LENGTH = 1024
GROUP_DOCUMENTS = 4096
CACHE_UNITS = 1_000_000  # twice as many at most, about 200 bytes each
LONGEST_CACHED = 48
#: The characters with the Unicode property White_Space. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The splitting pattern of byte-level vocabularies never joins a character to white space behind it, so a text may be
#: cut in front of any run of white space.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """A tokenizers file with a bounded memory of the units it has seen."""

    def __init__(self, path: str, remembered: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units = Recent(remembered)

    def _coded(self, units: list[str]) -> Iterator[bytes]:
        for i in range(0, len(units), 4096):
            for e in self.tokenizer.encode_batch_fast(units[i : i + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [UNIT.findall(t) for t in texts]
        fresh = self.units.missing(set().union(*cut))
        known = self.units.young
        known.update(zip(fresh, self._coded(fresh)))
        out = [b"".join([known[u] for u in units]) for units in cut]
        for u in fresh:
            if len(u) > LONGEST_CACHED:
                del known[u]
        return out


def encoder(path: str, remembered: int) -> Encoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, nth long"


def cut(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, remembered: int = CACHE_UNITS, forget: bool = False) -> DataFrame:
    """Pieces of every document: full ones of `length` ids, then the rest; each with the checksum of its ids.

    A worker remembers units from task to task, unless it is to `forget` them for the sake of other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, nth = encoder(path, remembered), np.array([end_id], "<u4").tobytes(), 0
        for piece in pieces(batches, limit=2 << 20):
            ids = [x + end for x in coder.encode([t or "" for t in piece.column("text").to_pylist()])]
            row, start, size, crc, whole = [], [], [], [], []
            for i, x in enumerate(ids):
                for s in range(0, len(x), 4 * length):
                    part = x[s : s + 4 * length]
                    row.append(i)
                    start.append(s // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    whole.append(len(x) // 4)
            numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, whole, range(nth, nth + len(row)))]
            nth += len(row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row, pa.int64())), *numbers], names)
        if forget:
            _ENCODERS.pop((path, remembered), None)
            del coder
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def first_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The sequence of each piece, given in falling order of size; a tree of maxima finds the first one with room."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [length] * (2 * leaves)
    out = np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
    return out


def packed(
    docs: DataFrame, path: str | None = None, end_id: int = 0, length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS,
    remembered: int = CACHE_UNITS, forget: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end mark alone. Every id lies in one piece, pieces of a sequence follow each other
    from 0 without gaps, and no sequence is longer than `length`. Repeated rows and null doc_ids are packed like any
    other row; other columns are not looked at; an empty table gives an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    groups = max(1, -(-docs.count() // group_documents))
    group = F.pmod(F.xxhash64("doc_id", "start", "nth"), F.lit(groups))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("nth", "ascending")])
        sizes = table.column("length").to_numpy()
        bins = first_fit(sizes, length)
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(bins[order], bins[order], side="left")
        offset = np.empty_like(run)
        offset[order] = run - run[first]
        sequence = (np.int64(key[0].as_py()) << 32) + bins
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    grouped = cut(docs, path, end_id, length, remembered, forget).withColumn("__group", group).groupBy("__group")
    return grouped.applyInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
