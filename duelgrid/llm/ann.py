"""Nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square test for when to stop.

Every vector gets one more component that makes all lengths equal, so the largest inner product is the smallest
Euclidean distance. A projection on `PROJECTED` random normal directions turns a distance d into d times the root of a
chi-square variable of that many degrees. A kd-tree over the projections hands out its leaves in the order of their
projected distance from the query, and every vector of a leaf is verified with its true inner product. Once the next
leaf is so far that a vector nearer than the present k-th would project beyond it with a probability below
1 - `CONFIDENCE`, the search stops. Few candidates, or ties, only mean that more leaves are read.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all that an answer can use; equal queries are
searched once. Vectors and queries are cut into blocks and every pair of blocks is one group of bounded size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.arrow import checkpointed

PROJECTED, CONFIDENCE = 8, 0.97
BLOCK, QUERY_BLOCK, LEAF, SIDE, SPARE = 8192, 1024, 64, 128, 4


@lru_cache(maxsize=8)
def chi_square_quantile(degrees: int, share: float) -> float:
    """Of an even number of degrees, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < share else (low, x)
    return high


@lru_cache(maxsize=8)
def directions(size: int, projected: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, projected))


class Tree:
    """Leaves of at most `LEAF` points: the places of the points, and the box around their projections."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            axis = int(np.argmax(points[at].max(axis=0) - points[at].min(axis=0)))
            half = len(at) // 2
            order = np.argpartition(points[at, axis], half)
            todo += [at[order[:half]], at[order[half:]]]
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        self.places = np.full((len(leaves), LEAF), -1)
        for i, x in enumerate(leaves):
            self.places[i, : len(x)] = x

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each leaf's box."""
        away = np.maximum(self.low[None] - queries[:, None], queries[:, None] - self.high[None])
        return (np.maximum(away, 0) ** 2).sum(axis=2)


def nearest(
    vectors: np.ndarray, queries: np.ndarray, k: int, reach: float, confidence: float = CONFIDENCE, ids: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k vectors with the largest inner products found; -1 and -inf where there are fewer.

    `reach` is at least the length of every vector. Ties go to the smaller of `ids`, by default to the smaller place.
    While leaves are read, scores that differ by rounding only count as ties.
    """
    ids = np.append(np.arange(len(vectors)) if ids is None else ids, np.iinfo(np.int64).max)  # the last is that of place -1
    grain = reach**2 * 2.0**-44 or 1.0
    lift = np.sqrt(np.maximum(reach**2 - (vectors**2).sum(axis=1), 0))
    axes = directions(vectors.shape[1] + 1, PROJECTED)
    tree = Tree(np.column_stack([vectors, lift]) @ axes)
    limit = chi_square_quantile(PROJECTED, confidence)
    held = k + SPARE
    places = np.full((len(queries), held), -1)
    scores = np.full((len(queries), held), -np.inf)
    cube, empty = vectors[np.maximum(tree.places, 0)], tree.places < 0  # the vectors of each leaf lie together
    for begin in range(0, len(queries), SIDE):
        q = queries[begin : begin + SIDE]
        best, place = scores[begin : begin + SIDE], places[begin : begin + SIDE]
        ways = tree.distances(q @ axes[:-1])
        order = np.argsort(ways, axis=1, kind="stable")
        ways = np.take_along_axis(ways, order, axis=1)
        base = (q**2).sum(axis=1) + reach**2
        running = np.arange(len(q))
        for step in range(order.shape[1]):
            far = base[running] - 2 * best[running, k - 1]  # infinite while fewer than k are known
            running = running[~(ways[running, step] > limit * far)]
            if len(running) == 0:
                break
            leaf = order[running, step]
            found = np.round(np.matmul(cube[leaf], q[running][:, :, None])[:, :, 0] / grain) * grain
            found[empty[leaf]] = -np.inf
            better = np.flatnonzero((found >= best[running, -1:]).any(axis=1))
            who = running[better]
            all_scores = np.concatenate([best[who], found[better]], axis=1)
            all_places = np.concatenate([place[who], tree.places[leaf[better]]], axis=1)
            top = np.lexsort((ids[all_places], -all_scores), axis=1)[:, :held]
            best[who] = np.take_along_axis(all_scores, top, axis=1)
            place[who] = np.take_along_axis(all_places, top, axis=1)
        # one fixed order of addition for the scores that are given out, whatever block a vector lies in
        exact = (vectors[np.maximum(place, 0)] * q[:, None]).sum(axis=2)
        best[:] = np.where(place < 0, -np.inf, exact)
        rank = np.lexsort((ids[place], -best), axis=1)
        best[:], place[:] = np.take_along_axis(best, rank, axis=1), np.take_along_axis(place, rank, axis=1)
    return places[:, :k], scores[:, :k]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, every component a finite number."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where("v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, asked: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with `asked` (over the column `id`), its k nearest others.

    Nearness is the inner product in double precision, ties go to the smaller id. Only vectors of the query's own
    number of components are compared. Null and zero vectors and those with null or non-finite components take no
    part, as queries or as candidates. Rows that repeat an id are one vector if their components are equal; a row
    never finds its own id. Fewer than k others give fewer rows, an empty table none. Other columns are not looked at.
    """
    most = k + 1
    rows = usable(vectors, id_column, vector_column).where("id IS NOT NULL").distinct()
    keyed = rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    keyed = checkpointed(keyed, "vectors")
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    few = keyed.withColumn("nth", nth).where(F.col("nth") <= most)
    classes = few.groupBy("a", "b", "dim").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = checkpointed(classes, "vector-classes")
    questions = keyed.where(asked).groupBy("a", "b", "dim").agg(F.first("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = classes.agg(F.count("*"), F.max(length)).first()
    blocks = max(1, math.ceil(size[0] / BLOCK))
    sides = max(1, math.ceil(keyed.where(asked).count() / QUERY_BLOCK))
    reach = float(size[1] or 0) * (1 + 1e-12)

    def cut(n: int) -> Column:
        return F.pmod(F.xxhash64("a"), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = classes.select("dim", cut(blocks).alias("block"), all_of(sides).alias("side"), "v", "ids")
    ask = questions.select("dim", all_of(blocks).alias("block"), cut(sides).alias("side"), "v", "a", "b")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(flat, float).reshape(len(column), -1)

    def answer(key: tuple[pa.Scalar, ...], base: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if base.num_rows and wanted.num_rows:
            ids = base.column("ids").to_pylist()
            first = np.argsort(np.argsort([x[0] for x in ids], kind="stable"))
            places, scores = nearest(matrix(base.column("v")), matrix(wanted.column("v")), most, reach, confidence, first)
            for a, b, where, score in zip(wanted.column("a").to_pylist(), wanted.column("b").to_pylist(), places.tolist(), scores.tolist()):
                near = [(-s, i) for p, s in zip(where, score) if p >= 0 for i in ids[p]]
                for s, i in sorted(near)[:most]:
                    for column, value in zip(out, (a, b, i, -s)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), base.schema.field("ids").type.value_type, pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("a", "b", "id", "score"), out, kinds)})

    kind = keyed.schema["id"].dataType.simpleString()
    group = ("dim", "block", "side")
    found = index.groupBy(*group).cogroup(ask.groupBy(*group)).applyInArrow(answer, f"a long, b long, id {kind}, score double")
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    listed = best.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))
    each = keyed.where(asked).select("a", "b", F.col("id").alias("query_id")).join(listed, ["a", "b"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = each.select("query_id", F.posexplode(others).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
