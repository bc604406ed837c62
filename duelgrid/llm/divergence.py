"""Divergence of every source from its language and from every other source, over term frequencies.

Indexing is single-pass and in memory: each task adds postings (document and occurrence counts of a term in a group of
language and source) to a block until the block is full, then spills it as a run sorted by term and goes on with an
empty one. Terms are sorted by a hash of language and term, which also deals them into shards. Runs of one shard are
merged with a heap, a bounded number at a time, until one pass brings all of a term's postings together as frequencies.

Divergence of a pair of sources sums, over all terms of a language, a function of two smoothed shares. Nearly all terms
are missing from nearly all sources, so the sum is taken as if every term were missing from both, then corrected: once
per source from the histogram of its shares, and once per term for the pairs of sources that both have it. Those pair
corrections are streamed term by term and added up in the task.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.arrow import as_bytes, checkpointed

FEWEST_DOCUMENTS, MOST_RANKS, UNIT = 3, 200, 1_000_000_000
BLOCK_POSTINGS = 300_000  # postings that a task holds before it spills a run
SHARDS_OF_PARTITION = 4
FAN_IN = 256  # runs that are merged at a time, about
MERGED_NAMES = 1 << 18  # names that a merge works on at a time, about
SPLIT = b"\xff"  # between a language and a term: a byte that UTF-8 never has
STEP_BYTES = 1 << 20  # of a text that are read at a time
PAIRS = 1 << 21  # pair corrections that are computed at a time
SALTS = 16

TERM = re.compile(rb"[a-z\x80-\xff]+")  # the bytes of terms, once A-Z is lower-cased
GAP = re.compile(rb"[^a-z\x80-\xff]")
LOWER = bytes(range(256)).lower()

Postings = tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]  # names; of each posting: name, source, documents, occurrences
LISTS = ["keys", "names", "sizes", "source", "docs", "n"]
RUN_SCHEMA = "run long, shard int, keys array<long>, names array<binary>, sizes array<long>, source array<string>, docs array<long>, n array<long>"


def parts_of(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about STEP_BYTES, cut where no term is."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, min(at + STEP_BYTES, len(text)))
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class Block:
    """Postings of some documents, by group. A group without terms is held by an empty term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, words: list[bytes], fresh: Iterable[bytes]) -> None:
        """`words` occur in a document of the group; of these, `fresh` had not occurred in that document."""
        n, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before = len(docs)
        n.update(words)
        docs.update(fresh)
        self.size += len(docs) - before

    def postings(self) -> Postings:
        """A name is a language, a byte that UTF-8 never has, and a term."""
        names: dict[bytes, int] = {}
        by_lang: dict[str, list[tuple[str, Counter, Counter]]] = {}
        for (lang, source), counts in self.groups.items():
            by_lang.setdefault(lang, []).append((source, *counts))
        name, source, docs, n = [], [], [], []
        for lang, held in by_lang.items():
            numbers: dict[bytes, int] = {}
            first, head = len(names), lang.encode() + SPLIT
            for own, occurrences, documents in held:
                name.append(np.array([first + numbers.setdefault(t, len(numbers)) for t in documents]))
                source += [own] * len(documents)
                docs.append(np.fromiter(documents.values(), np.int64, len(documents)))
                n.append(np.fromiter(map(occurrences.__getitem__, documents), np.int64, len(documents)))
            names.update((head + t, first + i) for t, i in numbers.items())
        return pa.array(names, pa.binary()), np.concatenate(name), pa.array(source, pa.string()), np.concatenate(docs), np.concatenate(n)


def keys_of(names: pa.Array) -> np.ndarray:
    """What runs are sorted by: the hash of each name."""
    return np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)


def as_runs(run: int, shards: np.ndarray, keys: np.ndarray, postings: Postings) -> pa.RecordBatch:
    """One row per shard: sorted keys, their names, how many postings each has, and the postings."""
    names, name, source, docs, n = postings
    order = np.lexsort((keys, shards))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[name], kind="stable")
    sizes = np.bincount(rank[name], minlength=len(order))
    held, first = np.unique(shards[order], return_index=True)
    cut = np.append(first, len(order))
    ends = np.append(0, np.cumsum(sizes))[cut]

    def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    by_name = [lists(pa.array(keys[order].view(np.int64)), cut), lists(names.take(pa.array(order)), cut), lists(pa.array(sizes), cut)]
    by_posting = [lists(source.take(pa.array(by)), ends), lists(pa.array(docs[by]), ends), lists(pa.array(n[by]), ends)]
    return pa.RecordBatch.from_arrays([pa.array([run] * len(held), pa.int64()), pa.array(held, pa.int32()), *by_name, *by_posting], ["run", "shard", *LISTS])


def runs(docs: DataFrame, shards: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Sorted runs, one row for each run and shard, from one pass over the documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, spilled = Block(), 0
        first = TaskContext.get().partitionId() << 24

        def spill() -> pa.RecordBatch:
            postings = block.postings()
            keys = keys_of(postings[0])
            return as_runs(first + spilled, (keys % np.uint64(shards)).astype(np.int32), keys, postings)

        for batch in batches:
            names = [[x or "" for x in batch.column(c).to_pylist()] for c in ("lang", "source")]
            for text, lang, source in zip(as_bytes(batch.column("text")), *names):
                block.add(lang, source, [], [b""])  # the group occurs
                seen: set[bytes] = set()
                for part in parts_of(text.translate(LOWER)):
                    words = TERM.findall(part)
                    fresh = set(words) - seen
                    block.add(lang, source, words, fresh)
                    seen |= fresh
                    if block.size >= block_postings:
                        yield spill()
                        block, spilled = Block(), spilled + 1
        if block.groups:
            yield spill()

    return docs.select("text", "lang", "source").mapInArrow(index, RUN_SCHEMA)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def merged(rows: pa.Table, at_a_time: int = MERGED_NAMES) -> Iterator[tuple[np.ndarray, Postings]]:
    """Some runs of one shard as one, in pieces of whole names in order of their keys: the keys, and the postings with
    those of one name and source added up.

    A heap holds the runs by their next key. The first run offers its next few names, and every run whose next key is
    not beyond the last of these gives all it has up to there.
    """
    lists = {c: rows.column(c).combine_chunks() for c in LISTS}
    bounds = lists["keys"].offsets.to_numpy().astype(np.int64)
    keys = lists["keys"].values.to_numpy(zero_copy_only=False).view(np.uint64)
    names, sizes = lists["names"].values, lists["sizes"].values.to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    sources = lists["source"].values.dictionary_encode()
    code = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    docs, n = (lists[c].values.to_numpy(zero_copy_only=False) for c in ("docs", "n"))
    at, end, step = bounds[:-1].copy(), bounds[1:], max(64, at_a_time // rows.num_rows)
    heap = [(int(keys[at[r]]), r) for r in range(rows.num_rows) if at[r] < end[r]]
    heapq.heapify(heap)
    while heap:
        first = heap[0][1]
        limit = int(keys[min(at[first] + step, end[first]) - 1])
        giving, taken = [], []
        while heap and heap[0][0] <= limit:
            r = heapq.heappop(heap)[1]
            stop = at[r] + int(np.searchsorted(keys[at[r] : end[r]], np.uint64(limit), side="right"))
            giving.append(r)
            taken.append(np.arange(at[r], stop))
            at[r] = stop
        entries = np.concatenate(taken)
        entries = entries[np.argsort(keys[entries], kind="stable")]
        nth = _numbered(keys[entries], names.take(pa.array(entries)))
        by = np.argsort(nth, kind="stable")  # changes nothing unless two names share a key
        entries, nth = entries[by], nth[by]
        places = _ranges(begins[entries], sizes[entries])
        both = np.repeat(nth, sizes[entries]) * len(sources.dictionary) + code[places]
        by = np.argsort(both, kind="stable")
        edges = np.flatnonzero(np.append(True, both[by][1:] != both[by][:-1]))
        both = both[by][edges]
        own = entries[np.flatnonzero(np.append(True, nth[1:] != nth[:-1]))]
        yield keys[own], (
            names.take(pa.array(own)), both // len(sources.dictionary), sources.dictionary.take(pa.array(both % len(sources.dictionary))),
            np.add.reduceat(docs[places[by]], edges), np.add.reduceat(n[places[by]], edges),
        )
        for r in giving:
            if at[r] < end[r]:
                heapq.heappush(heap, (int(keys[at[r]]), r))


def _numbered(keys: np.ndarray, names: pa.Array) -> np.ndarray:
    """The number of each name, from 0, in the order of the sorted keys."""
    same = keys[1:] == keys[:-1]
    if not pc.equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False).astype(bool)[same].all():
        each = list(zip(keys.tolist(), names.to_pylist()))  # different names with one key
        number = {x: i for i, x in enumerate(sorted(set(each)))}
        return np.array([number[x] for x in each])
    return np.append(0, np.cumsum(~same))


def frequencies(docs: DataFrame, fewest: int = FEWEST_DOCUMENTS, block_postings: int = BLOCK_POSTINGS, fan_in: int = FAN_IN) -> DataFrame:
    """lang, term (binary), key, source, n, lang_n, first: occurrences of every kept term in every group that has it.

    A term is kept if at least `fewest` documents of its language hold it. `lang_n` counts the whole language, `first`
    is 1 in one row of each kept term and 0 elsewhere. An empty term with n 0 stands in every occurring group.

    The number of shards follows the number of partitions, so a shard has fewer postings than a partition.
    """
    shards = SHARDS_OF_PARTITION * max(1, docs.rdd.getNumPartitions())
    table = checkpointed(runs(docs, shards, block_postings), "divergence-runs")
    n_runs = table.select("run").distinct().count()

    def one_run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pieces = list(merged(rows))
        before = np.cumsum([0, *(len(k) for k, _ in pieces)])
        names, source = (pa.concat_arrays([p[i] for _, p in pieces]) for i in (0, 2))
        name = np.concatenate([p[1] + b for (_, p), b in zip(pieces, before)])
        docs, n = (np.concatenate([p[i] for _, p in pieces]) for i in (3, 4))
        keys = np.concatenate([k for k, _ in pieces])
        return pa.Table.from_batches([as_runs(key[1].as_py(), np.full(len(keys), key[0].as_py(), np.int32), keys, (names, name, source, docs, n))])

    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        lane = F.pmod(F.xxhash64("run"), F.lit(n_runs)).alias("lane")
        table = checkpointed(table.groupBy("shard", lane).applyInArrow(one_run, RUN_SCHEMA), "divergence-merged")

    def totals(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = []
        for keys, (names, name, source, docs, n) in merged(rows):
            held = [x.split(SPLIT) for x in names.to_pylist()]
            lang, term = pa.array([x.decode() for x, _ in held], pa.string()), pa.array([t for _, t in held], pa.binary())
            marks = np.array([not t for _, t in held])
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            kept = np.flatnonzero((np.add.reduceat(docs, first) >= fewest)[name] | marks[name])
            lang_n, own = np.add.reduceat(n, first), pa.array(name[kept])
            begins = np.zeros(len(name), np.int64)
            begins[first] = ~marks
            columns = [lang.take(own), term.take(own), pa.array(keys.view(np.int64)[name[kept]]), source.take(pa.array(kept)), pa.array(n[kept]), pa.array(lang_n[name[kept]]), pa.array(begins[kept])]
            out.append(pa.RecordBatch.from_arrays(columns, schema=counted))
        return pa.Table.from_batches(out, counted)

    kinds = (pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    counted = pa.schema(list(zip(("lang", "term", "key", "source", "n", "lang_n", "first"), kinds)))
    schema = "lang string, term binary, key long, source string, n long, lang_n long, first long"
    return checkpointed(table.groupBy("shard").applyInArrow(totals, schema), "divergence-frequencies")


# -- divergence ---------------------------------------------------------------------------------------------------


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), exact at any count; null where there are no terms."""
    whole = F.nullif(total + terms, F.lit(0))
    small = F.call_function("div", F.lit(UNIT) * (count + 1), whole)
    large = F.call_function("div", F.lit(UNIT).cast("decimal(38,0)") * (count + 1).cast("decimal(38,0)"), whole.cast("decimal(38,0)"))
    return F.lit(1) + F.when(terms == 0, None).when(count < UNIT, small).otherwise(large)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are below 2^30, so squares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, part): what terms that both groups have add to the sum that takes them as missing from either or both.

    Batches hold key and second (two hashes of a term), gid, p and p0 (the share of a missing term), all rows of a term
    in sequence. Sums are modulo 2^64.
    """

    def of_terms(sizes: np.ndarray, gid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)  # where each row's term starts
        many = np.repeat(sizes, sizes)
        done = np.cumsum(many)
        names, code = np.unique(gid, return_inverse=True)
        at = 0
        while at < len(gid):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
            k = many[at:stop]
            a = np.repeat(np.arange(at, stop), k)
            b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[at:stop], k)
            a, b = a[a != b], b[a != b]
            part = _excess(p[a], p[b]) - _excess(p[a], p0[b]) - _excess(p0[a], p[b]) + _excess(p0[a], p0[b])
            key = code[a] * len(names) + code[b]
            pairs, place = np.unique(key, return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, place, part)
            yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]), pa.array(sums)], ["a", "b", "part"])
            at = stop

    rest = np.zeros((5, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, [batch.column(c).to_numpy() for c in ("key", "second", "gid", "p", "p0")]], axis=1)
        starts = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
        last = int(starts[-1]) if rows.shape[1] else 0
        if last:
            yield from of_terms(np.diff(starts), *rows[2:, :last])
        rest = rows[:, last:]
    if rest.shape[1]:
        yield from of_terms(np.array([rest.shape[1]]), *rest[2:])


def _exact(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def _total(histogram: str, use) -> Column:
    """Sum over a histogram's (p, rows) of rows times a function of p."""
    return F.aggregate(histogram, _exact(F.lit(0)), lambda s, x: _exact(s + _exact(x["rows"]) * _exact(use(x["p"]))))


def audited(docs: DataFrame, fewest: int = FEWEST_DOCUMENTS, ranks: int = MOST_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by falling divergence of the source from it, summed over all kept
    terms (0 where none is kept). Part `term`: the `ranks` kept terms that the source has most in excess of its
    language. Ties go to the smaller item. Null text, language and source count as empty; an empty source or language is
    a group like others. Repeated rows are documents of their own, very long texts are read whole, piece by piece, an
    empty table gives no rows, and other columns are not looked at.
    """
    found = frequencies(docs, fewest)
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    by_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    groups = sums.join(by_lang, "lang").select(
        "lang", "source", "total", "lang_total", "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"), F.monotonically_increasing_id().alias("gid")
    )
    groups = checkpointed(groups, "divergence-groups")
    kept = found.where(F.octet_length("term") > 0).join(groups, ["lang", "source"])
    valued = kept.select(
        "lang", "term", "key", "source", "gid", "p0",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    valued = checkpointed(valued, "divergence-shares")

    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    most = valued.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    most = most.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= ranks)

    histogram = valued.groupBy("gid", "p").agg(F.count("*").alias("rows")).groupBy("gid").agg(F.collect_list(F.struct("p", "rows")).alias("histogram"))
    in_order = valued.select("key", F.xxhash64("lang", "term").alias("second"), "gid", "p", "p0").repartition("key").sortWithinPartitions("key", "second")
    both = in_order.mapInArrow(pair_corrections, "a long, b long, part long").groupBy("a", "b").agg(F.sum(_exact("part")).alias("both"))

    sides = groups.join(histogram, "gid", "left").select("lang", "source", "gid", "terms", "p0", F.coalesce("histogram", F.array()).alias("histogram"))
    left = sides.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS)))
    right = sides.select(
        "lang", F.col("source").alias("item"), F.col("gid").alias("gid_b"), F.col("p0").alias("q0"), F.col("histogram").alias("histogram_b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    missing = excess(F.col("p0"), F.col("q0"))
    pairs = left.join(right, ["lang", "salt"]).where("gid <> gid_b")
    summed = pairs.select(
        "lang", "source", "item", F.col("gid").alias("a"), F.col("gid_b").alias("b"),
        (_exact("terms") * _exact(missing)
         + _total("histogram", lambda p: excess(p, F.col("q0")) - missing)
         + _total("histogram_b", lambda q: excess(F.col("p0"), q) - missing)).alias("either"),
    ).join(both, ["a", "b"], "left")
    half = F.lit(str(2**63)).cast("decimal(38,0)")
    total = _exact(F.coalesce("either", _exact(F.lit(0)))) + F.coalesce("both", _exact(F.lit(0)))
    value = F.pmod(_exact(total) + half, F.lit(str(2**64)).cast("decimal(38,0)")) - half  # parts are modulo 2^64
    diverging = summed.select("lang", "source", "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(falling))
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return diverging.withColumn("part", F.lit("pair")).select(shown).unionByName(most.withColumn("part", F.lit("term")).select(shown))
