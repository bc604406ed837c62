"""Exact top-k search by inner product of whole numbers, block at a time.

Every component becomes floor(256 x). A component of one sign is a term, so a block of consecutive documents is bounded,
for a query, by the sum over its components of the query's weight times the block's largest component where that weight
is positive, and its smallest where it is negative. Per query the blocks are ordered by this bound and scored through
their forward index, a matrix of the block's documents, until the bound of the next block is below the k-th score known.
Scores and bounds are whole numbers, so nothing is lost to rounding, and a block whose bound equals the k-th score is
still read, because a smaller id wins a tie.

Documents are first put in an order that keeps like ones together: a tree of median cuts, learnt from a bounded sample,
deals them into cells, every cell is split into segments of bounded size, and inside a segment further cuts order the
documents before they are numbered into blocks of `BLOCK`. A query is answered in its own segment first. Its k-th score
there then meets the bounds of all other segments, in tiles, and only segments whose bound reaches it see the query.
Equal vectors are indexed once, with the few smallest ids that an answer can use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.arrow import checkpointed

SCALE = 256
BLOCK = 64  # documents of one block
SEGMENT_NUMBERS = 1 << 19  # components in the forward index of one segment, about
SAMPLE_NUMBERS = 1 << 20  # components in the sample that the cells are learnt from, at most
MOST_LEVELS = 10  # of the tree that deals documents into cells
TILE_QUERIES, TILE_SEGMENTS = 1024, 512  # of one tile of segment bounds
ASKED_OF_COPY = 1 << 14  # queries that one copy of a segment answers, about
BATCH = 512  # queries that are answered side by side
CELL = ["dim", "cell", "part"]


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part: v not null, all components finite, as floor(256 x)."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).select("id", F.transform("x", lambda x: F.floor(F.lit(float(SCALE)) * x)).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), dim)


# -- order --------------------------------------------------------------------------------------------------------


def median_cuts(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of every cut of a complete tree, in heap order; each cuts the widest spread at its median."""
    axis, value = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.iinfo(np.int64).max)
    held = {0: np.arange(len(points))}
    for node in range(2**levels - 1):
        at = held.pop(node)
        if len(at) > 1 and points.shape[1]:
            axis[node] = np.argmax(points[at].astype(float).std(axis=0))
            on = points[at, axis[node]]
            value[node] = np.partition(on, (len(at) - 1) // 2)[(len(at) - 1) // 2]
            left = on <= value[node]
            held[2 * node + 1], held[2 * node + 2] = at[left], at[~left]
        else:
            held[2 * node + 1], held[2 * node + 2] = at, at[:0]
    return axis, value


def leaf_of(points: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf, from 0, that each point falls into."""
    axis, value = cuts
    node = np.zeros(len(points), np.int64)
    if points.shape[1]:
        for _ in range((len(axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > value[node])
        node -= len(axis)
    return node


# -- one segment --------------------------------------------------------------------------------------------------


def exact_kind(dim: int, widest: int, widest_asked: int) -> type:
    """The fastest numbers that hold every sum exactly."""
    most = max(dim, 1) * max(widest, 1) * max(widest_asked, 1)
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def in_long(numbers: np.ndarray) -> np.ndarray:
    """Numbers beyond 64 bits as the nearest 64-bit number."""
    return np.minimum(np.maximum(numbers, -(2**63)), 2**63 - 1) if numbers.dtype == object else numbers


def widest_of(numbers: np.ndarray) -> int:
    return max(abs(int(numbers.max())), abs(int(numbers.min()))) if numbers.size else 0


class Segment:
    """The forward index of some documents in blocks, and the extremes of each block's components."""

    def __init__(self, vectors: np.ndarray, first_ids: np.ndarray):
        levels = max(0, math.ceil(math.log2(max(1, len(vectors) / BLOCK))))
        self.order = np.argsort(leaf_of(vectors, median_cuts(vectors, levels)), kind="stable")
        self.vectors, self.first_ids = vectors[self.order], first_ids[self.order]
        self.starts = np.arange(0, len(vectors), BLOCK)
        self.top = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)

    def best(self, asked: np.ndarray, known: list[int | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows of (query, document, score): the k best documents of each query by (score, smallest id), of those that
        reach its `known` k-th score; and how many blocks were scored for how many queries in all."""
        kind = exact_kind(self.vectors.shape[1], widest_of(self.vectors), widest_of(asked))
        forward, q = self.vectors.astype(kind), asked.astype(kind)
        zero = q * 0
        bounds = in_long(np.maximum(q, zero) @ self.top.astype(kind).T + np.minimum(q, zero) @ self.low.astype(kind).T)
        nothing = np.iinfo(np.int64).min if kind is np.int64 else -math.inf
        kth = np.array([nothing if x is None else x for x in known], kind)
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, axis=1)
        who, where, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        running, at, width, scored = np.arange(len(q)), 0, 1, 0
        while at < len(self.starts):
            running = running[(falling[running, at] >= kth[running]).astype(bool)]
            if len(running) == 0:
                break
            live = (falling[running, at : at + width] >= kth[running][:, None]).astype(bool)
            row, step = np.nonzero(live)
            query, block = running[row], order[running[row], at + step]
            scored += len(query)
            by = np.argsort(block, kind="stable")
            query, block = query[by], block[by]
            found = [(who, where, score)]
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(block))):
                start, asking = self.starts[block[a]], query[a:b]
                sums = in_long(q[asking] @ forward[start : start + BLOCK].T)
                r, c = np.nonzero((sums >= kth[asking][:, None]).astype(bool))
                found.append((asking[r], start + c, sums[r, c]))
            who, where, score = (np.concatenate(x) for x in zip(*found))
            ranked = -score if kind is not object else -np.unique(score, return_inverse=True)[1]
            by = np.lexsort((self.first_ids[where], ranked, who))
            who, where, score = who[by], where[by], score[by]
            begin = np.searchsorted(who, who, side="left")
            nth = np.arange(len(who)) - begin
            last = nth == k - 1
            kth[who[last]] = np.maximum(kth[who[last]], score[last])
            who, where, score = who[nth < k], where[nth < k], score[nth < k]
            at, width = at + width, 2 * width
        return who, self.order[where], score, scored


HIT = pa.schema([("asker", pa.int64()), ("cls", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _answers(segment: Segment, classes: np.ndarray, ids: list[list[int]], askers: np.ndarray, asked: np.ndarray, known: list[int | None], most: int) -> pa.RecordBatch:
    """The best `most` (score, id) entries of each query, with the class that each comes from."""
    out: list[tuple[int, int, int, int]] = []
    for begin in range(0, len(askers), BATCH):
        who, where, score, _ = segment.best(asked[begin : begin + BATCH], known[begin : begin + BATCH], most)
        near: dict[int, list[tuple[int, int, int]]] = {}
        for q, d, s in zip(who.tolist(), where.tolist(), score.tolist()):
            near.setdefault(q, []).extend((-int(s), i, int(classes[d])) for i in ids[d])
        for q, entries in near.items():
            out += [(int(askers[begin + q]), c, i, -s) for s, i, c in sorted(entries)[:most]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), (), ()))], schema=HIT)


# -- all segments -------------------------------------------------------------------------------------------------


def _classes(rows: DataFrame, asked: Column, most: int) -> DataFrame:
    """cls, v, ids (the `most` smallest), asks: one row per different vector."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asking = rows.where(asked).select("v").distinct().withColumn("asks", F.lit(True))
    met = grouped.join(asking, "v", "left").select("v", "ids", F.col("asks").isNotNull().alias("asks"), F.size("v").alias("dim"))
    return checkpointed(met.withColumn("cls", F.monotonically_increasing_id()), "topk-classes")


def _segments(classes: DataFrame) -> DataFrame:
    """Every class with the cell and the part of that cell it lies in."""
    size = classes.agg(F.sum("dim"), F.max("dim")).first()
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, (size[0] or 0) / SEGMENT_NUMBERS)))))
    few = classes.select("v", "dim").orderBy(F.xxhash64("v"), "v").limit(max(1, SAMPLE_NUMBERS // max(1, size[1] or 1))) if levels else classes.select("v", "dim").limit(0)
    by_dim: dict[int, list[list[int]]] = {}
    for r in few.collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    trees = {dim: median_cuts(np.array(v, np.int64).reshape(len(v), dim), levels) for dim, v in by_dim.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in set(dims.tolist()) & trees.keys():
                at = np.flatnonzero(dims == dim)
                cell[at] = leaf_of(matrix(batch.column("v").take(pa.array(at)), dim), trees[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = classes.mapInArrow(deal, "v array<long>, ids array<long>, asks boolean, dim int, cls long, cell int")
    dealt = checkpointed(dealt, "topk-cells")
    parts = dealt.groupBy("dim", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") / SEGMENT_NUMBERS)).alias("parts"))
    return dealt.join(parts, ["dim", "cell"]).select(*dealt.columns, F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"))


def _home(segments: DataFrame, most: int) -> DataFrame:
    """Hits of every asking class in its own segment; and one row per segment, without asker, of its extremes."""

    def own(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        vectors, ids = matrix(rows.column("v"), dim), rows.column("ids").to_pylist()
        classes = rows.column("cls").to_numpy()
        segment = Segment(vectors, np.array([x[0] for x in ids], np.int64))
        asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
        hits = _answers(segment, classes, ids, classes[asks], vectors[asks], [None] * len(asks), most)
        n = hits.num_rows
        ends = [None] * n + [segment.top.max(axis=0).tolist()], [None] * n + [segment.low.min(axis=0).tolist()]
        columns = [pa.array([x.as_py()] * (n + 1), pa.int32()) for x in key]
        columns += [pa.array([*x.to_pylist(), None], pa.int64()) for x in hits.columns]
        return pa.table([*columns, *(pa.array(x, pa.list_(pa.int64())) for x in ends)], names=[*CELL, *HIT.names, "top", "low"])

    schema = "dim int, cell int, part int, asker long, cls long, id long, score long, top array<long>, low array<long>"
    return checkpointed(segments.groupBy(*CELL).applyInArrow(own, schema), "topk-home")


def _visits(asks: DataFrame, extremes: DataFrame) -> DataFrame:
    """asker, dim, cell, part: the segments, other than its own, whose bound reaches the k-th score of a query.

    Queries and segments meet in tiles; both sides of a tile are bounded.
    """
    n = max(1, math.ceil(extremes.count() / TILE_SEGMENTS)), max(1, math.ceil(asks.count() / TILE_QUERIES))

    def tiles(own: str, column: Column, mine: int, other: str, others: int) -> list[Column]:
        return [F.pmod(F.xxhash64(column), F.lit(mine)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)]

    left = asks.select("*", *tiles("down", F.col("asker"), n[1], "across", n[0]))
    right = extremes.select("*", *tiles("across", F.struct("cell", "part"), n[0], "down", n[1]))

    def reach(key: tuple[pa.Scalar, ...], asking: pa.Table, met: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        q, top, low = (matrix(x, dim) for x in (asking.column("v"), met.column("top"), met.column("low")))
        kind = exact_kind(dim, max(widest_of(top), widest_of(low)), widest_of(q))
        q, top, low = q.astype(kind), top.astype(kind), low.astype(kind)
        bounds = in_long(np.maximum(q, q * 0) @ top.T + np.minimum(q, q * 0) @ low.T)
        known = asking.column("known").to_pylist()
        live = np.ones(bounds.shape, bool)
        some = np.flatnonzero([x is not None for x in known])
        live[some] = (bounds[some] >= np.array([known[i] for i in some], kind)[:, None]).astype(bool)
        at_home = np.ones(bounds.shape, bool)
        for name in ("cell", "part"):
            at_home &= asking.column(name).to_numpy()[:, None] == met.column(name).to_numpy()[None]
        r, c = np.nonzero(live & ~at_home)
        return pa.table({"asker": asking.column("asker").to_numpy()[r], **{x: met.column(x).to_numpy()[c] for x in CELL}})

    tile = ["dim", "across", "down"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(reach, "asker long, dim int, cell int, part int")


def _elsewhere(segments: DataFrame, asks: DataFrame, visits: DataFrame, most: int) -> DataFrame:
    """Hits of every visit. A segment that many queries visit is copied, so that each copy answers a bounded number."""
    visits = checkpointed(visits, "topk-visits")
    copies = visits.groupBy(*CELL).agg(F.ceil(F.count("*") / ASKED_OF_COPY).cast("int").alias("copies"))
    base = segments.join(copies, CELL).select(
        *CELL, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("side"), "cls", "v", "ids", F.lit(None).cast("long").alias("known")
    )
    asking = visits.join(asks.select("asker", "v", "known"), "asker").join(copies, CELL).select(
        *CELL, F.pmod(F.xxhash64("asker"), "copies").cast("int").alias("copy"), F.lit(1).alias("side"),
        F.col("asker").alias("cls"), "v", F.lit(None).cast("array<long>").alias("ids"), "known",
    )
    group = [*CELL, "copy"]
    dealt = base.unionByName(asking).repartition(*group).sortWithinPartitions(*group, "side")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, segment, classes, ids = None, [], None, None, None
        for batch in batches:
            marks = np.array([batch.column(x).to_numpy() for x in [*group, "side"]]).T
            edges = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))
            for a, b in zip(edges, np.append(edges[1:], len(marks))):
                mine, side, rows = tuple(marks[a, :-1]), marks[a, -1], batch.slice(a, b - a)
                if mine != key:
                    key, parts, segment = mine, [], None
                if side == 0:
                    parts.append(rows)
                    continue
                if segment is None:
                    whole = pa.Table.from_batches(parts)
                    ids, classes = whole.column("ids").to_pylist(), whole.column("cls").to_numpy()
                    segment = Segment(matrix(whole.column("v"), int(mine[0])), np.array([x[0] for x in ids], np.int64))
                    parts = []
                asked = matrix(rows.column("v"), int(mine[0]))
                yield _answers(segment, classes, ids, rows.column("cls").to_numpy(), asked, rows.column("known").to_pylist(), most)

    return dealt.mapInArrow(answer, "asker long, cls long, id long, score long")


def search(vectors: DataFrame, asked: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with `asked` (over the column `id`), its k best others.

    The score is the inner product of floor(256 x) of all components, exact (a component or score outside 64 bits
    counts as the nearest 64-bit number); ties go to the smaller id. Only vectors of the query's own
    number of components are compared. Rows whose id or vector is null, or with null or non-finite components, take no
    part; zero and empty vectors do. Equal rows are one row; an id with several vectors is several rows, each of which
    may find the others. Fewer than k others give fewer rows, an empty table none. Very many ties cost time, not rows:
    all blocks that can hold one are read. Other columns are not looked at.
    """
    most = k + 1
    rows = checkpointed(whole_numbers(vectors, id_column, vector_column).distinct(), "topk-rows")
    segments = checkpointed(_segments(_classes(rows, asked, most)), "topk-segments")
    home = _home(segments, most)
    near = home.where("asker IS NOT NULL").select("asker", "cls", "id", "score")
    known = near.groupBy("asker").agg(F.when(F.count("*") >= most, F.min("score")).alias("known"))
    asks = segments.where("asks").select(F.col("cls").alias("asker"), *CELL, "v").join(known, "asker", "left")
    asks = checkpointed(asks, "topk-asks")
    visits = _visits(asks, home.where("asker IS NULL").select(*CELL, "top", "low"))
    hits = near.unionByName(_elsewhere(segments, asks, visits, most))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id", "cls")
    best = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    listed = best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score", "cls"))).alias("near"))
    each = rows.where(asked).join(segments.where("asks").select("v", F.col("cls").alias("asker")), "v").select(F.col("id").alias("query_id"), "asker")
    others = F.filter("near", lambda x: (x["id"] != F.col("query_id")) | (x["cls"] != F.col("asker")))
    ranked = each.join(listed, "asker").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
