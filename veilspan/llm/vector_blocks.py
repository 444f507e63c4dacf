"""Searching a stated query set against all vectors, in blocks.

Vectors are dealt to cells by where they lie (near a pivot, or by length), large cells on to shards by a
hash of their id, and each shard is indexed once. A block of queries and a shard are one task of
bounded size, which returns the block's best k within the shard. Queries first visit the cells where
their best ones are likely; what they find bounds how good a vector must be, and only cells whose
own bounds reach that are visited after. Neither side is gathered or broadcast whole: what is
broadcast are the cells' bounds, MOST_CELLS at most for each length of vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema
from veilspan.session import materialize

#: Vectors of a shard, on average, and queries of a block.
SHARD, BLOCK = 16_384, 4_096
#: Cells of the vectors of one length at most.
MOST_CELLS = 1024


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, dim, v binary of doubles): vectors that aren't null, empty, zero (if asked) and have only finite components."""
    out = arrow_schema("vec_id long, dim int, v binary")

    def run(batches):
        for batch in batches:
            ids, rows, dims = [], [], []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if len(x) and np.isfinite(x).all() and (x.any() or not nonzero):
                    ids.append(key)
                    dims.append(len(x))
                    rows.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.binary())], schema=out)

    picked = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].alias("v"))
    return picked.mapInArrow(run, "vec_id long, dim int, v binary")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors and the ``keep`` smallest ids of each (-1 fills up): copies cost one vector."""
    x = x + 0.0  # one zero only
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    raw = np.ascontiguousarray(x).view([("", f"V{x.shape[1] * 8}")]).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    heads = np.r_[0, np.flatnonzero(np.diff(which[by])) + 1]
    nth = np.arange(len(by)) - np.repeat(heads, np.diff(np.r_[heads, len(by)]))
    owners = np.full((len(first), keep), -1, np.int64)
    few = nth < keep
    owners[which[by][few], nth[few]] = ids[by][few]
    return x[first], owners


class Best:
    """For each query the best ``k`` columns seen, by score and then by the columns' smallest id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.column = np.full((queries, k), -1, np.int64)
        self.tie = np.full((queries, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, rows: np.ndarray, other: Best) -> None:
        """What another holds of some queries."""
        for mine, own in ((self.score, other.score), (self.column, other.column), (self.tie, other.tie)):
            mine[rows] = own[rows]

    def add(self, rows: np.ndarray, score: np.ndarray, column: np.ndarray, tie: np.ndarray) -> None:
        """Scores of rows x columns; -inf takes no part."""
        better = (score >= self.score[rows, -1][:, None]) & (score > -np.inf)
        hit = np.flatnonzero(better.any(1))
        if not len(hit):
            return
        rows, score = rows[hit], score[hit]
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # only what may still count is sorted
            cut = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
            width = int((score >= cut[:, None]).sum(1).max())
            if width < score.shape[1] // 2:
                pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
                score = np.take_along_axis(score, pick, 1)
                column, tie = column[pick], tie[pick]
        column, tie = np.broadcast_to(column, score.shape), np.broadcast_to(tie, score.shape)
        score = np.concatenate([self.score[rows], score], 1)
        column = np.concatenate([self.column[rows], column], 1)
        tie = np.concatenate([self.tie[rows], tie], 1)
        order = np.lexsort((tie, -score), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.column[rows] = np.take_along_axis(column, order, 1)
        self.tie[rows] = np.take_along_axis(tie, order, 1)


def pairs_of(best: Best, owners: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, column, id) of all ids that the best columns stand for, but the queries' own."""
    q, c = np.nonzero(best.column >= 0)
    column = best.column[q, c]
    ids = owners[column]
    real = (ids >= 0) & (ids != query_ids[q][:, None])
    a, b = np.nonzero(real)
    return q[a], column[a], ids[a, b]


def cells_for(n_rows: int) -> int:
    return max(1, min(MOST_CELLS, -(-n_rows // SHARD)))


def placed(vectors: DataFrame, place: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds (cell int, far double): place(matrix, dim) gives both for vectors of one length."""
    schema = "vec_id long, dim int, v binary, cell int, far double"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cell[at], far[at] = place(matrix(batch.column(2).take(pa.array(at)), dim), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(far)], schema=out)

    return vectors.select("vec_id", "dim", "v").mapInArrow(run, schema)


def cells_of(vectors: DataFrame) -> list:
    """(dim, cell, low, high, first, k): the ends of ``far`` in each cell, and the cell's shards, numbered on end."""
    found = vectors.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("dim", "cell").collect()
    rows, first = [], 0
    for r in found:
        k = max(1, -(-r.n // SHARD))
        rows.append((r.dim, r.cell, r.low, r.high, first, k))
        first += k
    return rows


def build(vectors: DataFrame, cells: DataFrame, make_index: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """(shard, cell, index binary): make_index(ids, matrix) of each shard, pickled; every vector is in one."""
    names = "shard int, cell int, index binary"
    schema = arrow_schema(names)

    def one(table: pa.Table) -> pa.Table:
        index = make_index(table["vec_id"].to_numpy(), matrix(table["v"], table["dim"][0].as_py()))
        return pa.table([[table["shard"][0].as_py()], [table["cell"][0].as_py()], [pickle.dumps(index, protocol=5)]], schema=schema)

    dealt = vectors.join(F.broadcast(cells), ["dim", "cell"])
    dealt = dealt.select("vec_id", "dim", "cell", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("k"))).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(one, names)


def cell_frame(spark: SparkSession, rows: list) -> DataFrame:
    """cells_of() as a table."""
    return spark.createDataFrame(rows, "dim int, cell int, low double, high double, first int, k int")


def indexed(vectors: DataFrame, make_index: Callable[[np.ndarray, np.ndarray], object]) -> tuple[DataFrame, list]:
    """(build()'s index of placed() vectors, cells_of() them); the index is written once."""
    rows = cells_of(vectors)
    return materialize(build(vectors, cell_frame(vectors.sparkSession, rows), make_index)), rows


def visit(index: DataFrame, visits: DataFrame, blocks: int, k: int, score_type: str, find) -> DataFrame:
    """(query_id, vec_id, score): each query's best k of every shard it visits (vec_id, dim, v, shard)."""
    schema = f"query_id long, vec_id long, score {score_type}"
    out = arrow_schema(schema)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        ids = right["vec_id"].to_numpy()
        row, vec, score = find(pickle.loads(left["index"][0].as_py()), ids, matrix(right["v"], right["dim"][0].as_py()))
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        few = nth < k
        return pa.table([ids[row[few]], vec[few], score[few]], schema=out)

    right = visits.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = right.select(F.col("shard").alias("to"), F.col("block").alias("of")).distinct()  # a shard goes to the blocks that visit it
    left = index.join(asked, F.col("shard") == F.col("to")).select(F.col("to").alias("shard"), F.col("of").alias("block"), "index")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(pair, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    index: DataFrame, rows: list, queries: DataFrame, n_queries: int, k: int, score_type: str,
    find: Callable[[object, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], own: bool,
    reaches: Callable[[np.ndarray, float, int, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """(query_id, rank, vec_id, score) of indexed() vectors and placed() queries: find(index, query ids, matrix) gives (query row, id, score).

    A query visits its own cell first, or without ``own`` the first one of its length. Then it visits each
    other cell for which reaches(vector, k-th score so far or nan, dim, cells, lows, highs) says that it
    may hold one as good."""
    cells = cell_frame(index.sparkSession, rows)
    blocks = max(1, -(-n_queries // BLOCK))
    shards = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("shard")
    firsts = cells.groupBy("dim").agg(F.min("cell").alias("start"))
    queries = queries.join(F.broadcast(firsts), "dim").withColumn("start", F.col("cell") if own else F.col("start"))
    near = queries.join(F.broadcast(cells.withColumnRenamed("cell", "start").drop("low", "high")), ["dim", "start"]).select("vec_id", "dim", "v", shards)
    one = materialize(ranked(visit(index, near, blocks, k, score_type, find), k).drop("rank"))
    least = one.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    schema = "vec_id long, dim int, v binary, cell int"
    out, table = arrow_schema(schema), {d: np.array([r[1:4] for r in rows if r[0] == d]) for d in {r[0] for r in rows}}

    def later(batches):
        for batch in batches:
            who, to = [], []
            for n, (dim, v, start, worst) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                cell, low, high = table[dim].T
                yes = reaches(np.frombuffer(v, np.float64), np.nan if worst is None else worst, dim, cell.astype(np.int64), low, high) & (cell != start)
                to += cell[yes].astype(int).tolist()
                who += [n] * int(yes.sum())
            picked = [c.take(pa.array(who, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(to, pa.int32())], schema=out)

    far = queries.join(least, "vec_id", "left").select("vec_id", "dim", "v", "start", "least").mapInArrow(later, schema)
    far = far.join(F.broadcast(cells), ["dim", "cell"]).select("vec_id", "dim", "v", shards)
    return ranked(one.unionByName(visit(index, far, blocks, k, score_type, find)), k)


def every(df: DataFrame, step: int) -> Column:
    """The stated query set: rows whose vec_id is divisible by ``step``."""
    return df["vec_id"] % step == 0
