"""SimHash near-duplicates, with Golay codewords as fuzzy keys.

A fingerprint of 64 bits has three segments of 23, 23 and 18 bits. If two fingerprints differ in at most two bits,
one of three ordered pairs of segments (A, B), (C, A), (B, C) has equal first segments and second segments that
differ in at most one bit. For two errors in A or one in each of A and C that is (B, C); two in B or one in each of A
and B: (C, A); two in C or one in each of B and C: (A, B).

The perfect binary Golay code of 23 bits gives every 23-bit word one nearest codeword. A fingerprint's *home* is its
first segment with the codeword of the second; its *probes* are the codewords of the second segment and of all words
one bit away (six at most), so a partner's home is among them. Probes join homes, and the pairs are verified.

Homes with more than `HOME_LIMIT` fingerprints are not joined. All fingerprints that meet there are laid out by the 65
words within one bit of each: two fingerprints differ in two bits or fewer exactly if they share such a word, at most
65 share one, and linking them to the smallest is enough. So no link between components is lost and no group is paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import as_bytes, checkpointed, free_name, give_back, pieces
from duelgrid.llm.components import roots

HOME_LIMIT = 64
MAX_BITS = 2
KEYS = 21  # of a fingerprint, at most: three homes and six probes for each
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # shift and width of A, B and C
ORDERED = ((0, 1), (2, 0), (1, 2))
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 majority bits over the XXH64 of every shingle of `size` words; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - size] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(packed), 1 << 16):
        counts += np.unpackbits(packed[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(packed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns `also` and the fingerprint of every whole text as a (signed) long."""
    kept = ["doc_id", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values = np.array([fingerprint(t) for t in as_bytes(piece.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(piece.column, kept), pa.array(values)], [*kept, "bits"])
        give_back()

    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*fields, "bits long"]))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and the word of least weight for each remainder."""
    unit = []
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        unit.append(x)

    def remainders(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for k, r in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ r
        return out

    error = np.zeros(2048, np.int32)
    for weight in (3, 2, 1):
        for where in combinations(range(23), weight):
            error[np.bitwise_xor.reduce([unit[i] for i in where])] = sum(1 << i for i in where)
    error[0] = 0
    return remainders(unit[:12]), remainders(unit[12:]), error


def codeword(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    low, high, error = _golay()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, keys, is home) for all families; keys of different families differ."""
    words = bits.astype(np.uint64)
    parts = [((words >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows = np.arange(len(bits))
    for family, (exact, fuzzy) in enumerate(ORDERED):
        head = (parts[exact] << 14) | (family << 12)
        near = parts[fuzzy][:, None] ^ np.array([0, *(1 << i for i in range(SEGMENTS[fuzzy][1]))])
        codes = codeword(near.astype(np.int32)).astype(np.int64)
        yield rows, head | codes[:, 0], True
        codes.sort(axis=1)
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        at, which = np.nonzero(fresh)
        yield at, head[at] | codes[at, which], False


def _keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            for at, keys, home in fuzzy_keys(bits.view(np.uint64)):
                columns = [pa.array(bits[at]), pa.array(keys), pa.array(np.full(len(at), home))]
                yield pa.RecordBatch.from_arrays(columns, ["bits", "key", "home"])

    return distinct.mapInArrow(run, "bits long, key long, home boolean")


def _within_one_bit(bits):
    return F.concat(F.array(bits), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(distinct: DataFrame, home_limit: int = HOME_LIMIT, rows: int | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in two bits or fewer; of a crowded home, enough to join them."""
    keys = checkpointed(_keys(distinct), "golay-keys", None if rows is None else KEYS * rows)
    homes, probes = keys.where("home"), keys.where("NOT home")
    crowded = homes.groupBy("key").count().where(F.col("count") > home_limit).select("key")
    quiet = homes.join(crowded, "key", "left_anti").select("key", F.col("bits").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = probes.select("key", F.col("bits").alias("a")).join(quiet, "key").where((F.col("a") < F.col("b")) & near)
    met = keys.join(crowded, "key", "left_semi").select("bits").distinct()
    shared = met.select("bits", F.explode(_within_one_bit(F.col("bits"))).alias("middle"))
    cliques = shared.groupBy("middle").agg(F.sort_array(F.collect_set("bits")).alias("all")).where(F.size("all") > 1)
    chained = cliques.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
    return found.select("a", "b").unionByName(chained).distinct()


def _rooted(prints: DataFrame, home_limit: int) -> DataFrame:
    """(bits, root) for every fingerprint that is linked to another."""
    rows = prints.count()
    found = roots(links(prints.select("bits").distinct(), home_limit, rows), 4 * rows)
    return found.withColumnRenamed("node", "bits")


def components(docs: DataFrame, home_limit: int = HOME_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    A null or empty text, or one of white space, has fingerprint zero and is linked like any other. Equal texts and
    repeated rows share a fingerprint and so a component. A null doc_id never names a component unless it is alone in
    it (component_id is then null). Other columns are not looked at; an empty table gives an empty one.
    """
    prints = checkpointed(fingerprints(docs), "fingerprints")
    firsts = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(_rooted(prints, home_limit), "bits", "left")
    root = F.coalesce("root", "bits")
    least = placed.groupBy(root.alias("root")).agg(F.min("first").alias("component_id"))
    named = placed.select("bits", root.alias("root")).join(least, "root").select("bits", "component_id")
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return prints.join(named, "bits").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, home_limit: int = HOME_LIMIT) -> DataFrame:
    """`docs` with one row of every component: smallest doc_id, nulls last, then smallest hash of the text.

    All columns pass through. Rows that repeat doc_id and text count as one, different texts that share a doc_id (or have
    none) as different documents. Rows are told apart by doc_id and hash together, so null ids are dealt out by text, and
    repeats shrink to one row a task before they are dealt.
    """
    mark, own = free_name(docs, "mark"), free_name(docs, "key")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    key = F.struct(F.isnull("doc_id").alias("gone"), "doc_id", F.col(mark).alias("mark"))  # fields that are null equal each other
    prints = checkpointed(fingerprints(marked, mark), "fingerprints")
    firsts = prints.groupBy("bits").agg(F.min(key).alias("first"))
    placed = firsts.join(_rooted(prints, home_limit), "bits", "left")
    keep = placed.groupBy(F.coalesce("root", "bits").alias("root")).agg(F.min("first").alias(own)).select(own)
    once = marked.withColumn(own, key).dropDuplicates([own])
    return once.join(keep, own, "left_semi").select(*docs.columns)
