"""Approximate nearest neighbours by cosine: a vantage-point tree per shard, below a split by pivots.

Unit vectors' chord distance is a metric that orders as the cosine does. A node holds a vantage
point and halves its vectors by their distance to it; the distance ranges of both halves bound, by
the triangle inequality, how near any of their vectors can be to a query. A leaf is skipped when
``factor`` times its bound exceeds the query's k-th distance so far: factor one is exact search,
larger factors skip more. A block of queries visits each one's leaves by rising bounds.

The shards are cells of vectors that lie nearest to one pivot of a bounded sample. The least and the
greatest distance from a cell's pivot bound its vectors in the same way, so a query goes on from its own
cell to those only that the same relaxed bound doesn't rule out.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm import vector_blocks as V
from veilspan.llm.arrow import arrow_schema
from veilspan.session import materialize, written

LEAF = 128
#: Factors that are tried, the first one exact; queries they are tried on at most; the recall that the chosen one must reach there.
FACTORS, SAMPLE, WANTED = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0), 100, 0.97


@dataclass
class VpTree:
    """Vectors in leaf order. vantage: row of each inner node's point. ranges: of distances to it, for
    the nearer and the farther half. children: inner nodes as numbers, leaves as -1 - number."""

    x: np.ndarray
    owners: np.ndarray
    vantage: np.ndarray
    ranges: np.ndarray
    children: np.ndarray
    leaves: list[tuple[int, int]]

    @cached_property
    def unit(self) -> np.ndarray:
        return unit_vectors(self.x)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def build_tree(ids: np.ndarray, x: np.ndarray, keep: int, seed: int = 3) -> VpTree:
    x, owners = V.distinct(ids, x, keep)
    unit = unit_vectors(x)
    rng = np.random.default_rng(seed)
    place = np.arange(len(x))
    vantage, ranges, children, leaves = [], [], [], []
    # each slice of ``place`` to be split, with the node and side that will point to it
    todo = [(0, len(x), -1, 0)]
    while todo:
        low, high, parent, side = todo.pop()
        if high - low <= LEAF:
            name = -1 - len(leaves)
            leaves.append((low, high))
        else:
            name = len(vantage)
            pick = low + int(rng.integers(high - low))
            place[[low, pick]] = place[[pick, low]]
            rest = place[low + 1 : high]
            far = _chord(unit[rest] @ unit[place[low]])
            order = np.argsort(far, kind="stable")
            place[low + 1 : high], far = rest[order], far[order]
            half = len(far) // 2
            vantage.append(low)
            ranges.append([far[0], far[half - 1], far[half], far[-1]])
            children.append([0, 0])
            todo += [(low + 1, low + 1 + half, name, 0), (low + 1 + half, high, name, 1)]
        if parent >= 0:
            children[parent][side] = name
    return VpTree(
        x[place], owners[place], np.array(vantage, np.int64), np.array(ranges).reshape(-1, 4),
        np.array(children, np.int64).reshape(-1, 2), leaves,
    )


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def search_tree(tree: VpTree, q: np.ndarray, k: int, *factors: float) -> list[V.Best]:
    """The best k distinct vectors of each row of ``q`` for each of some rising factors.

    The order in which a query visits leaves doesn't depend on the factor, only where it stops. So one search by the
    first factor passes the places where the others stop, and their results are set aside there."""
    unit = unit_vectors(q)
    best, everyone = V.Best(len(q), k), np.arange(len(q))
    bound = np.zeros((len(q), len(tree.leaves)))
    if len(tree.vantage):
        cosine = unit @ tree.unit[tree.vantage].T
        best.add(everyone, cosine, tree.vantage, tree.owners[tree.vantage, 0])
        far = _chord(cosine)
        lows = {0: np.zeros(len(q))}
        for node, (r, sons) in enumerate(zip(tree.ranges, tree.children)):  # parents come before their children
            for side, son in enumerate(sons.tolist()):
                low = np.maximum(lows[node], np.maximum(r[2 * side] - far[:, node], far[:, node] - r[2 * side + 1]))
                if son >= 0:
                    lows[son] = low
                else:
                    bound[:, -1 - son] = low
    order = np.argsort(bound, axis=1, kind="stable")
    slack = 1e-7  # of a chord distance: roots of rounded differences
    active, stopped = everyone, [best, *(V.Best(len(q), k) for _ in factors[1:])]
    going = np.ones((len(factors), len(q)), bool)
    for turn in range(len(tree.leaves)):
        leaf = order[active, turn]
        reach = _chord(np.maximum(best.least()[active], -1))
        reach[best.least()[active] == -np.inf] = np.inf
        low = bound[active, leaf] - slack
        for nth, factor in enumerate(factors[1:], 1):
            ends = active[going[nth, active] & (factor * low > reach + slack)]
            stopped[nth].take(ends, best)
            going[nth, ends] = False
        active, leaf = (a[factors[0] * low <= reach + slack] for a in (active, leaf))
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(leaf[by]) > 0])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
            rows, (low, high) = active[by[a:b]], tree.leaves[leaf[by[a]]]
            best.add(rows, unit[rows] @ tree.unit[low:high].T, np.arange(low, high), tree.owners[low:high, 0])
    for nth in range(1, len(factors)):
        stopped[nth].take(np.flatnonzero(going[nth]), best)
    return stopped


#: Columns kept beyond the k wanted ones, and the rounding of a product of unit vectors.
SPARE, ROUNDING = 3, 1e-12


def best_exact(tree: VpTree, ids: np.ndarray, q: np.ndarray, k: int, *factors: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, id, cosine) for each of some rising factors: candidates among which each query's best k lie, by the exact measure.

    The tree compares rounded products. Where more columns than are kept lie within the rounding of the k-th, as
    with many vectors of one direction, that query is measured against every column that near, one query
    at a time, and its best k by cosine and id go on."""
    return [_measured(tree, ids, q, k, best) for best in search_tree(tree, q, k + SPARE, *factors)]


def _measured(tree: VpTree, ids: np.ndarray, q: np.ndarray, k: int, best: V.Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = best.score[:, k] - ROUNDING  # the query's own vector may be one of them
    crowded = np.flatnonzero((best.column[:, -1] >= 0) & (best.least() >= near))
    best.column[crowded] = -1
    row, column, vec = V.pairs_of(best, tree.owners, ids)
    found = [(row, vec, cosines(q[row], tree.x[column]))]
    unit = unit_vectors(q[crowded]) if len(crowded) else q[:0]
    for one, direction in zip(crowded.tolist(), unit):
        columns = np.flatnonzero(tree.unit @ direction >= near[one] - ROUNDING)
        score = cosines(np.broadcast_to(q[one], (len(columns), q.shape[1])), tree.x[columns])
        at, nth = np.nonzero((tree.owners[columns] >= 0) & (tree.owners[columns] != ids[one]))
        vec, score = tree.owners[columns[at], nth], score[at]
        few = np.lexsort((vec, -score))[:k]
        found.append((np.full(len(few), one), vec[few], score[few]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the same for the same pair wherever it stands."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest_neighbours(
    df: DataFrame, step: int = 50, k: int = 5, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every ``step``-th id, itself apart.

    Without a ``factor`` the greatest of FACTORS is taken whose recall, measured against exact search with SAMPLE of
    the queries, is WANTED or more; so how much is passed over follows the vectors, and no recall is promised unmeasured.

    Ties go to the smaller id. Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null id, take no part, neither as queries nor as candidates; vectors
    of another length than the query's aren't its candidates. Copies of a vector are all candidates.
    An id that repeats is one query per row in the search but gives one list. An empty table gives an
    empty table; other columns aren't read."""
    vectors = V.valid_vectors(df, id_col, vector_col, nonzero=True)
    rows = df.count()
    pivots: dict[int, np.ndarray] = {}
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(V.cells_for(rows)).collect()
    for dim in {r.dim for r in drawn}:
        own = np.frombuffer(b"".join(bytes(r.v) for r in drawn if r.dim == dim), np.float64).reshape(-1, dim)
        pivots[dim] = np.unique(unit_vectors(own), axis=0)

    def place(x, dim):
        if dim not in pivots:
            return np.full(len(x), -1), np.zeros(len(x))
        cosine = unit_vectors(x) @ pivots[dim].T
        return cosine.argmax(1), _chord(cosine.max(1))

    def reaches(factor, q, least, dim, cells, low, high):
        if dim not in pivots:
            return np.zeros(len(cells), bool)
        far = _chord(unit_vectors(q[None]) @ pivots[dim][cells].T)[0]
        bound = np.maximum(0, np.maximum(far - high, low - far))
        reach = np.inf if np.isnan(least) else float(_chord(np.maximum(least, -1)))
        return factor * (bound - 1e-7) <= reach + 1e-7

    vectors = written(V.placed(vectors, place), "placed-vectors")
    queries = vectors.where(V.every(vectors, step)).dropDuplicates(["vec_id"])
    index, cells = V.indexed(vectors, lambda ids, x: build_tree(ids, x, k + 1))
    if factor is None:
        shares = recalls(index, cells, queries, k, reaches)
        factor = max(f for f in FACTORS if shares[f] >= WANTED)

    def find(tree, ids, q):
        return best_exact(tree, ids, q, k, factor)[0]

    return V.search(index, cells, queries, -(-rows // step), k, "double", find, True, partial(reaches, factor))


def recalls(index: DataFrame, cells: list, queries: DataFrame, k: int, reaches, factors: tuple[float, ...] = FACTORS) -> dict[float, float]:
    """The recall of each factor over SAMPLE queries, against the first one, which is exact search of all shards.

    The sample, a hundred vectors, goes to every shard; a shard's tree is searched once for all factors. What a query
    finds in its own cell then tells which other cells it would have visited, so the measure is that of the search."""
    spark = index.sparkSession
    drawn = queries.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(SAMPLE).collect()
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in drawn}:
        own = [r for r in drawn if r.dim == dim]
        held[dim] = np.array([r.vec_id for r in own]), np.frombuffer(b"".join(bytes(r.v) for r in own), np.float64).reshape(-1, dim)
    schema = "query_id long, turn int, cell int, vec_id long, score double"
    out = arrow_schema(schema)

    def tried(batches):
        for batch in batches:
            for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = pickle.loads(raw.as_py())
                if tree.x.shape[1] not in held:
                    continue
                ids, q = held[tree.x.shape[1]]
                for turn, (row, vec, score) in enumerate(best_exact(tree, ids, q, k, *factors)):
                    same = lambda v: np.full(len(row), v)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[row], same(turn), same(cell), vec, score), out)], schema=out)

    seen = materialize(index.select("cell", "index").mapInArrow(tried, schema))
    group = Window.partitionBy("query_id", "turn").orderBy(F.col("score").desc(), "vec_id")
    first = lambda df: df.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k)
    homes = spark.createDataFrame([(r.vec_id, r.cell) for r in drawn], "query_id long, cell int")
    least = {(r.query_id, r.turn): r.least for r in first(seen.join(homes, ["query_id", "cell"])).groupBy("query_id", "turn")
             .agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).collect()}
    table, visits = {d: np.array([c[1:4] for c in cells if c[0] == d]) for d in held}, []
    for r in drawn:
        cell, low, high = table[r.dim].T
        for turn, factor in enumerate(factors):
            worst = least.get((r.vec_id, turn))
            yes = reaches(factor, np.frombuffer(bytes(r.v), np.float64), np.nan if worst is None else worst, r.dim, cell.astype(np.int64), low, high)
            visits += [(r.vec_id, turn, c) for c in cell[yes | (cell == r.cell)].astype(int).tolist()]
    allowed = spark.createDataFrame(visits, "query_id long, turn int, cell int")
    exact = first(seen.where("turn = 0")).select("query_id", "vec_id")
    found = first(seen.join(allowed, ["query_id", "turn", "cell"])).join(exact, ["query_id", "vec_id"])
    hits, n = {r.turn: r.n for r in found.groupBy("turn").agg(F.count("*").alias("n")).collect()}, exact.count()
    return {f: 1.0 if turn == 0 or n == 0 else hits.get(turn, 0) / n for turn, f in enumerate(factors)}
