"""Importance resampling towards a target: hashed n-gram features, and a seeded draw without replacement.

A text is normalised once: A-Z lower-cased, its words joined by single blanks. One scan over that byte string keeps the
running CRC register at every place. The CRC of any run of words then comes from two of those registers: the one at its
start, shifted over as many zero bytes as the run is long (a linear map over GF(2), from tables), cancels everything
before the run out of the one at its end. No n-gram is ever built as a string.

Corpus and target are counted into `BUCKETS` buckets, each task adding up its own; a text's weight is the mean of its
buckets' log ratios; adding Gumbel noise that depends on seed and id alone turns the largest scores into a draw without
replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import as_bytes, checkpointed, joined, pieces

BUCKETS, LONGEST = 10_000, 2  # buckets, and words of the longest n-gram
SEED, FEWEST_WORDS, PERCENT = 7, 20, 25
LANES = 4096  # pieces of a chunk whose registers are scanned side by side
NEAR = 64  # lengths with a shift table of their own
FULL = np.uint32(0xFFFFFFFF)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# -- CRC arithmetic -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """The register after one byte, for a register that holds only that byte (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as four tables of 256: one for each byte of the register."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


@lru_cache(maxsize=1)
def near_shifts() -> np.ndarray:
    """[length, byte of the register, value]: the register after `length` zero bytes, for lengths below NEAR."""
    out = np.zeros((NEAR, 4, 256), np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    step = byte_table()
    for n in range(1, NEAR):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


@lru_cache(maxsize=64)
def far_shift(power: int) -> np.ndarray:
    """Tables of the shift by 2**power zero bytes."""
    if 2**power < NEAR:
        return near_shifts()[2**power]
    half = far_shift(power - 1)
    return np.stack([_apply(half, x) for x in half])


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after that many zero bytes."""
    tables, short = near_shifts(), lengths % NEAR
    flat = tables.reshape(NEAR * 4, 256)
    out = flat[short * 4, registers & 255]
    for byte in range(1, 4):
        out ^= flat[short * 4 + byte, (registers >> np.uint32(8 * byte)) & 255]
    rest = lengths // NEAR
    power = NEAR.bit_length() - 1
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(far_shift(power), out[at])
        rest, power = rest >> 1, power + 1
    return out


class Running:
    """The registers at all places of a byte string, scanned once, in lanes that start from zero."""

    def __init__(self, data: np.ndarray):
        self.steps = max(NEAR, -(-(len(data) + 1) // LANES))
        lanes = -(-(len(data) + 1) // self.steps)
        padded = np.zeros(lanes * self.steps, np.uint8)
        padded[: len(data)] = data
        by_step = np.ascontiguousarray(padded.reshape(lanes, self.steps).T).astype(np.uint32)
        table, register = byte_table(), np.zeros(lanes, np.uint32)
        before = np.empty((self.steps, lanes), np.uint32)
        for i in range(self.steps):
            before[i] = register
            register = table[(register ^ by_step[i]) & 255] ^ (register >> 8)
        self.before = np.ascontiguousarray(before.T).reshape(-1)
        whole = near_shifts()[0].reshape(-1)
        over = shifted(whole, np.full(len(whole), self.steps)).reshape(4, 256).tolist()
        carry = [0]  # the true register at the start of each lane
        for end in register[:-1].tolist():
            c = carry[-1]
            carry.append(end ^ over[0][c & 255] ^ over[1][c >> 8 & 255] ^ over[2][c >> 16 & 255] ^ over[3][c >> 24])
        self.carry = np.array(carry, np.uint32)

    def true(self, places: np.ndarray) -> np.ndarray:
        return self.before[places] ^ shifted(self.carry[places // self.steps], places % self.steps)

    def crc32(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of each slice: what lies before it cancels out of the register at its end."""
        first, last = self.before[starts], self.before[ends]
        apart = np.flatnonzero(starts // self.steps != ends // self.steps)
        first[apart], last[apart] = self.true(starts[apart]), self.true(ends[apart])
        return last ^ shifted(first ^ FULL, ends - starts) ^ FULL


# -- features -----------------------------------------------------------------------------------------------------


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased, a blank after each: the bytes, where words start and end, and each's text."""
    data, text_starts = joined(texts)
    data = LOWER[data]
    inside = IN_WORD[data]
    ends = np.append(False, ~inside[1:] & inside[:-1])  # the first byte behind a word
    clean = np.where(inside, data, np.uint8(0x20))[inside | ends]
    blank = clean == 0x20
    stop = np.flatnonzero(blank)
    start = np.append(0, stop[:-1] + 1)[: len(stop)]
    owner = np.searchsorted(text_starts, np.flatnonzero(ends), side="right") - 1
    return clean, start, stop, owner


def features(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every run of 1 to `longest` words, repeats included; and the number of words of each text."""
    clean, start, stop, owner = normalised(texts)
    running = Running(clean)
    found, owners = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(start) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        found.append(running.crc32(start[first], stop[first + n - 1]) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def bucket_counts(table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: features of all texts of a table. Every task adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            total += np.bincount(features(as_bytes(piece.column("text")), buckets, longest)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = table.select("text").where("text IS NOT NULL").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln) of target by corpus share of every bucket, both smoothed by one. `buckets` numbers in all."""
    held = np.zeros((2, buckets), object)
    for i, table in enumerate((docs, target)):
        for r in bucket_counts(table, buckets, longest).collect():  # at most `buckets` rows
            held[i, r["bucket"]] = r["n"]
    (corpus, aim), (all_corpus, all_aim) = held, held.sum(axis=1)
    ratios = [float(t + 1) * float(all_corpus + buckets) / (float(s + 1) * float(all_aim + buckets)) for s, t in zip(corpus, aim)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


# -- weights and the draw -----------------------------------------------------------------------------------------


def weighed(docs: DataFrame, gains: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            bucket, owner, n_words = features(as_bytes(piece.column("text")), buckets, longest)
            order = np.argsort(owner, kind="stable")
            n = np.bincount(owner, minlength=len(n_words))
            ends = np.cumsum(n)
            total = np.append(0, np.cumsum(gains[bucket[order]]))
            sums = total[ends] - total[ends - n]
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            columns = [piece.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """floor(1000 times) a Gumbel number that depends on the seed and the id alone; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, 3... of those that are drawn, else null.

    `percent` of the rows with at least `fewest_words` words are drawn, rounded down, by highest score; ties go to the
    smaller doc_id, a null id behind all, then to fewer features. A null or empty text has no features and weight 0, and
    is never drawn; a null doc_id takes the noise of an empty one. Repeated rows are rows of their own with equal
    scores and following ranks. Very long texts are read whole. An empty table gives none, an empty target only
    smoothed ratios. Other columns are not looked at.

    Ranks come from rows sorted in ranges, numbered inside each range, plus the sizes of the ranges before; the row's
    place in its file is the last sort key, so that even a third of all rows with one id spreads over ranges.
    """
    scored = weighed(docs, log_ratios(docs, target)).withColumn("score", F.col("weight") + noise(seed))
    scored = checkpointed(scored, "resample-scored")
    shown = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("place")]
    placed = scored.where(F.col("n_words") >= fewest_words).select(*shown, F.monotonically_increasing_id().alias("place"))
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the number of the range, and 33 bits of the row's number in it
    ranged = checkpointed(sorted_rows.select(*shown, F.shiftright(at, 33).cast("int").alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "resample-ranged")
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # at most `ranges` rows
    before, total = [], 0
    for i in sorted(sizes):
        before.append((i, total))
        total += sizes[i]
    offsets = scored.sparkSession.createDataFrame(before, "range int, before long")
    nth = F.col("before") + F.col("nth") + 1
    drawn = ranged.join(offsets, "range").select(*shown, F.when(nth <= percent * total // 100, nth).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < fewest_words).select(*shown, F.lit(None).cast("long").alias("rank")))
