"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

A shard's integer vectors are sorted by descending length and rotated onto the right singular
vectors, so that the first rotated components carry most of the length. A query takes blocks of
vectors in that order. Once its length times a block's greatest length is below its k-th score it is
done. Within a block, the sum over the leading components plus the product of the residual lengths
bounds each score from above; only vectors whose bound reaches the k-th score get exact scores,
which are integers.

Shards are ranges of length, too: a query visits the longest vectors first, and after that only ranges
whose greatest length times its own reaches the k-th score it has found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from veilspan.llm import vector_blocks as V
from veilspan.session import written

SCALE = 1024.0
CHUNK = 512
#: Share of the squared length that the leading components must carry.
LEADING = 0.6


@dataclass
class NormIndex:
    x: np.ndarray
    owners: np.ndarray
    norms: np.ndarray
    basis: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    largest: float


def build_index(ids: np.ndarray, x: np.ndarray, keep: int) -> NormIndex:
    x, owners = V.distinct(ids, np.floor(SCALE * x), keep)
    norms = np.sqrt((x * x).sum(1))
    order = np.argsort(-norms, kind="stable")
    x, owners, norms = x[order], owners[order], norms[order]
    with np.errstate(over="ignore", invalid="ignore"):
        gram = x.T @ x
    if np.isfinite(gram).all():
        _, vectors = np.linalg.eigh(gram)
        basis = vectors[:, ::-1]  # right singular vectors, the greatest first
    else:
        basis = np.eye(x.shape[1])
    turned = x @ basis
    energy = np.cumsum((turned * turned).sum(0))
    lead = 1 + int(np.searchsorted(energy, LEADING * energy[-1])) if energy[-1] > 0 else 1
    lead = min(lead, x.shape[1])
    rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
    return NormIndex(x, owners, norms, basis, turned[:, :lead], rest, float(np.abs(x).max(initial=0)))


def _exact(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Inner products; in doubles where all partial sums are exact integers, else in Python's integers."""
    if largest * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**53:
        return q @ x.T
    a, b = (np.array([[int(v) for v in row] for row in m], object) for m in (q, x))
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int(v), ends.min), ends.max) for v in row] for row in a @ b.T], object)


def search_index(index: NormIndex, q: np.ndarray, k: int) -> V.Best:
    best = V.Best(len(q), k)
    norms = np.sqrt((q * q).sum(1))
    lead = index.head.shape[1]
    turned = q @ index.basis
    rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
    active = np.arange(len(q))
    kept: dict[int, list[tuple]] = {}
    for low in range(0, len(index.x), CHUNK):
        high = min(low + CHUNK, len(index.x))
        ceiling = norms[active] * index.norms[low]
        slack = 1e-9 * ceiling + 1e-6
        least = best.least()
        active = active[ceiling + slack >= least[active]]
        if not len(active):
            break
        bound = turned[active, :lead] @ index.head[low:high].T + np.outer(rest[active], index.rest[low:high])
        worth = bound + (1e-9 * norms[active] * index.norms[low] + 1e-6)[:, None] >= least[active][:, None]
        rows, columns = np.flatnonzero(worth.any(1)), np.flatnonzero(worth.any(0))
        if not len(rows):
            continue
        columns = columns + low
        score = _exact(q[active[rows]], index.x[columns], index.largest)
        if score.dtype == object:
            _add_integers(best, kept, active[rows], score, columns, index.owners[columns, 0])
        else:
            best.add(active[rows], score, columns, index.owners[columns, 0])
    return best


def _add_integers(best: V.Best, kept: dict[int, list[tuple]], rows: np.ndarray, score: np.ndarray, columns: np.ndarray, tie: np.ndarray) -> None:
    """As Best.add, of integers that doubles don't tell apart: ``kept`` holds each query's best as integers. Scores in
    ``best`` are rounded down, so bounds that are compared with them lose nothing."""
    k = best.score.shape[1]
    for row, own in zip(rows.tolist(), score.tolist()):
        held = sorted([*kept.get(row, []), *((-s, t, c) for s, t, c in zip(own, tie.tolist(), columns.tolist()))])[:k]
        kept[row] = held
        best.column[row, : len(held)] = [c for _, _, c in held]
        best.score[row, : len(held)] = [np.nextafter(float(-s), -np.inf) for s, _, _ in held]


def top_products(df: DataFrame, step: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): the k highest integer inner products of every ``step``-th id.

    Components become floor(1024 * x). Ties go to the smaller id; a query isn't its own candidate.
    Vectors that are null or empty or hold null or non-finite components, and rows with a null id,
    take no part; vectors of another length than the query's aren't its candidates. Zero vectors and
    copies are candidates like any other. An id that repeats gives one list. Scores beyond the range
    of a long are its ends; all others are exact integers, and compared as such. An empty table gives an empty
    table; other columns aren't read."""
    vectors = V.valid_vectors(df, id_col, vector_col, nonzero=False)
    rows = df.count()
    length = lambda x: np.sqrt((np.floor(SCALE * x) ** 2).sum(1))
    n = V.cells_for(rows)
    cuts = np.empty(0)
    if n > 1:  # ends of ranges of about equal numbers; the numbers needn't be exact
        lengths = V.placed(vectors, lambda x, dim: (np.zeros(len(x)), length(x)))
        cuts = np.unique(lengths.approxQuantile("far", [i / n for i in range(1, n)], 0.1 / n))

    def place(x, dim):
        far = length(x)
        return len(cuts) - np.searchsorted(cuts, far, "right"), far

    def reaches(q, least, dim, cells, low, high):
        ceiling = float(length(q[None])[0]) * high
        return np.isnan(least) | (ceiling * (1 + 1e-9) + 1e-6 >= least)

    def find(index, ids, q):
        q = np.floor(SCALE * q)
        best = search_index(index, q, k + 1)
        row, column, vec = V.pairs_of(best, index.owners, ids)
        score = np.zeros(len(row), np.int64)
        for a in range(0, len(row), 4096):
            i, j = q[row[a : a + 4096]], index.x[column[a : a + 4096]]
            if index.largest * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**53:
                score[a : a + 4096] = (i * j).sum(1).astype(np.int64)
            else:
                score[a : a + 4096] = [int(_exact(x[None], y[None], index.largest)[0, 0]) for x, y in zip(i, j)]
        return row, vec, score

    vectors = written(V.placed(vectors, place), "placed-vectors")
    queries = vectors.where(V.every(vectors, step)).dropDuplicates(["vec_id"])
    index, cells = V.indexed(vectors, lambda ids, x: build_index(ids, x, k + 1))
    return V.search(index, cells, queries, -(-rows // step), k, "long", find, False, reaches)


def oracle(step: int = 100, k: int = 10) -> str:
    """DuckDB SQL for top_products() over embeddings: every query against every row."""
    return f"""WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(q.v, lambda x, i: x * c.v[i]))::BIGINT AS score
        FROM ints q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {step} = 0)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
