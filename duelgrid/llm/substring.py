"""Substring dedup: difference-cover anchors find words inside windows that occur more than once.

A difference cover D modulo p holds, for every distance, two members that far apart. So for any two equal windows of
`length` words there is a shift below p that brings both starts to cover positions, and the `length - p + 1` words
from there are an equal pair of anchors. Hence:

1. every text hashes short windows at its cover positions only (a quarter of all positions for p = 21);
2. an anchor met twice is extended to all full windows around it; no other window can have an equal partner;
3. the full windows are hashed with 128 bits and counted, and words in windows met twice go.

Texts are dealt once into buckets by content and id. A bucket sends each hash once, with a mark if it holds it twice,
so a passage in a third of all texts costs one entry per bucket, and no pair of texts is ever formed. What comes back
is a bit per hash, in the order in which the bucket sent them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from duelgrid.llm.arrow import Windows, as_bytes, free_name, give_back, joined, spread, word_bounds, word_hashes

#: Perfect difference sets: every distance modulo the period occurs as exactly one difference. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
BUCKET_BYTES = 3 << 20
RANGE_HASHES = 1 << 19
SENT = "slice int, bucket int, step int, hashes binary, twice binary"
BACK = "bucket int, step int, slice int, again binary"


class Bucket:
    """Words of a bucket's texts, with their anchors and full windows."""

    def __init__(self, texts: list[bytes], length: int, period: int):
        self.texts, self.length, self.period = texts, length, period
        data, text_starts = joined(texts)
        starts, ends = word_bounds(data)
        self.first = np.searchsorted(starts, text_starts)  # of each text in the words, and the end
        self.lanes = [Windows(word_hashes(data, starts, ends, lane), lane) for lane in (0, 1)]
        counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), counts)
        self.within = np.arange(len(starts)) - np.repeat(self.first[:-1], counts)
        self.left = np.repeat(self.first[1:], counts) - np.arange(len(starts))  # words up to the text's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        short = self.length - self.period + 1
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        # an anchor serves only windows that hold it, so the text has room for one
        roomy = self.left + self.within >= self.length
        at = np.flatnonzero(cover[self.within % self.period] & (self.left >= short) & roomy)
        return at, self.lanes[0].at(at, short)

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold one of the anchors at `at`."""
        reach = np.zeros(len(self.within) + 1, np.int64)
        np.add.at(reach, at + 1, -1)
        np.add.at(reach, at - np.minimum(self.within[at], self.period - 1), 1)
        return np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (self.left >= self.length))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """128-bit hashes as 16-byte strings."""
        both = np.column_stack([lane.at(at, self.length) for lane in self.lanes])
        return np.ascontiguousarray(both).view("V16").ravel()

    def covered(self, at: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.within) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    lead = hashes if hashes.dtype == np.uint64 else hashes.view(np.uint64)[::2]
    return (lead >> np.uint64(33)).astype(np.int64) % slices


def _grouped(hashes: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, distinct hashes in fixed order, how often each) for every slice that has some."""
    order = hashes if hashes.dtype == np.uint64 else hashes.view(np.dtype([("a", "<u8"), ("b", "<u8")]))
    distinct, counts = np.unique(order, return_counts=True)
    distinct = distinct.view(hashes.dtype)
    where = _slice_of(distinct, slices)
    by = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[by])) + 1
    for part in np.split(by, cuts) if len(by) else []:
        yield int(where[part[0]]), distinct[part], counts[part]


def _send(bucket: int, step: int, hashes: np.ndarray, slices: int) -> pa.Table:
    rows = [(k, h.tobytes(), np.packbits(n > 1).tobytes()) for k, h, n in _grouped(hashes, slices)]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table({
        "slice": pa.array(columns[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
        "step": pa.array([step] * len(rows), pa.int32()), "hashes": pa.array(columns[1], pa.binary()),
        "twice": pa.array(columns[2], pa.binary()),
    })


def _met_again(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For one slice of the hashes: a bit for each hash of each bucket that occurs anywhere else."""
    kind = np.dtype("<u8") if table.column("step")[0].as_py() == 0 else np.dtype([("a", "<u8"), ("b", "<u8")])
    blobs = [np.frombuffer(x, kind) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(b)) for t, b in zip(table.column("twice").to_pylist(), blobs)]
    _, inverse = np.unique(np.concatenate(blobs), return_inverse=True)
    weight = np.bincount(inverse, weights=1 + np.concatenate(twice))
    again, ends = weight[inverse] > 1, np.cumsum([len(b) for b in blobs])
    bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
    return pa.table({
        "bucket": table.column("bucket").cast(pa.int32()), "step": table.column("step").cast(pa.int32()),
        "slice": table.column("slice").cast(pa.int32()), "again": pa.array(bits, pa.binary()),
    })


def _marked(hashes: np.ndarray, answers: pa.Table, step: int, slices: int) -> np.ndarray:
    """Which positions hold a hash that its slice has met again."""
    answers = answers.filter(pc.equal(answers.column("step"), step))
    bits = dict(zip(answers.column("slice").to_pylist(), answers.column("again").to_pylist()))
    again = [
        h[np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(h)).astype(bool)]
        for k, h, _ in _grouped(hashes, slices)
    ]
    if not again or not sum(map(len, again)):
        return np.zeros(len(hashes), bool)
    plain = np.dtype("<u8") if step == 0 else np.dtype([("a", "<u8"), ("b", "<u8")])
    wanted, have = np.sort(np.concatenate(again).view(plain)), hashes.view(plain)
    at = np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)
    return wanted[at] == have


def _repeats(docs: DataFrame, length: int, period: int) -> tuple[GroupedData, DataFrame, int]:
    """The texts by bucket, the marks of both steps by bucket, and the number of slices."""
    if period not in COVERS or period > length:
        raise ValueError(f"period {period} is not one of {sorted(COVERS)} up to the window length")
    buckets = spread(docs, BUCKET_BYTES)
    slices = max(1, buckets * BUCKET_BYTES // 6 // RANGE_HASHES)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    own = free_name(docs, "bucket")
    dealt = docs.withColumn(own, key).repartition(buckets, own)

    def send_anchors(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = _send(group[0].as_py(), 0, Bucket(as_bytes(table.column("text")), length, period).anchors()[1], slices)
        give_back()
        return sent

    def send_windows(group: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(as_bytes(texts.column("text")), length, period)
        at, hashes = bucket.anchors()
        around = bucket.candidates(at[_marked(hashes, answers, 0, slices)])
        sent = _send(group[0].as_py(), 1, bucket.windows(around), slices)
        del bucket
        give_back()
        return sent

    # one plan: its three readings of `dealt` are the same exchange, so Spark deals the texts out once
    anchors = dealt.groupBy(own).applyInArrow(send_anchors, SENT)
    shared = anchors.groupBy("slice").applyInArrow(_met_again, BACK)
    windows = dealt.groupBy(own).cogroup(shared.groupBy("bucket")).applyInArrow(send_windows, SENT)
    repeated = windows.groupBy("slice").applyInArrow(_met_again, BACK)
    return dealt.groupBy(own), shared.unionAll(repeated), slices


def _gone(texts: list[bytes], answers: pa.Table, length: int, period: int, slices: int) -> Iterator[np.ndarray]:
    """For each text, which of its words go."""
    bucket = Bucket(texts, length, period)
    at, hashes = bucket.anchors()
    around = bucket.candidates(at[_marked(hashes, answers, 0, slices)])
    covered = bucket.covered(around[_marked(bucket.windows(around), answers, 1, slices)])
    first = bucket.first
    del bucket, at, hashes, around
    give_back()
    for a, b in zip(first[:-1], first[1:]):
        yield covered[a:b]


def removed(docs: DataFrame, length: int = 35, period: int = 21) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words left in order, joined by one blank.

    A word goes if a window of `length` consecutive words of its text holds it and the same words start anywhere
    else, in the same text too. Windows are judged on the input. A null or empty text has no words and keeps an empty
    text; texts shorter than a window lose nothing; repeated rows are texts of their own, so they lose every word of
    their windows. Very long texts are one entry of their bucket and are held whole. Other columns are not looked at. An
    empty table gives an empty one.
    """
    dealt, answers, slices = _repeats(docs.select("doc_id", "text"), length, period)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(group: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        texts = as_bytes(table.column("text"))
        rows = []
        for text, gone in zip(texts, _gone(texts, back, length, period, slices)):
            words = text.split()
            rows.append((len(words), int(gone.sum()), b" ".join(compress(words, ~gone)).decode()))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(columns[0], pa.int64()),
            "n_removed": pa.array(columns[1], pa.int64()), "kept": pa.array(columns[2], pa.string()),
        })

    pairs = dealt.cogroup(answers.groupBy("bucket"))
    return pairs.applyInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, length: int = 35, period: int = 21) -> DataFrame:
    """`removed` with the kept text as its SHA-256."""
    kept = removed(docs, length, period)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, length: int = 35, period: int = 21) -> DataFrame:
    """`docs` without the repeated words; n_chars, if there, is the new length.

    A text that loses nothing stays as it is, white space included; others are their kept words joined by one blank.
    Null stays null, and every row and other column is kept.
    """
    names, schema = docs.columns, docs.schema
    dealt, answers, slices = _repeats(docs, length, period)

    def keep(group: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        texts = as_bytes(table.column("text"))
        null = table.column("text").is_null().to_pylist()
        new = [
            None if none else (b" ".join(compress(text.split(), ~gone)) if gone.any() else text).decode()
            for text, none, gone in zip(texts, null, _gone(texts, back, length, period, slices))
        ]
        values = pa.array(new, pa.string())
        columns = {n: table.column(n) for n in names} | {"text": values}
        if "n_chars" in columns:
            columns["n_chars"] = pc.utf8_length(values).cast(table.schema.field("n_chars").type)
        return pa.table(columns)

    return dealt.cogroup(answers.groupBy("bucket")).applyInArrow(keep, schema)


def plain(rows: list[tuple[int, str | None]], length: int) -> list[tuple[int, int, int, str]]:
    """Brute force over a small table, for tests: every window of every text in one dictionary."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in words:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] = seen.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
