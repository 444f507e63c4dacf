import numpy as np
import pytest

from veilspan.llm import norm_topk as N
from veilspan.llm import vector_blocks as V
from veilspan.llm import vp_tree as T
from veilspan.sources.tables import read_table


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def odd_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 8)).tolist(), "x") for i in range(700)]
    rows += [(1000 + i, rows[50][1], "copy") for i in range(300)]
    rows += [(2000, None, ""), (2050, [0.0] * 8, ""), (2100, [1.0] * 7 + [None], ""), (2150, [float("nan")] * 8, ""), (None, [1.0] * 8, "")]
    rows += [(2200, [float("inf")] + [1.0] * 7, ""), (2250, [1.0, 2.0], "short"), (2300, [], ""), (2350, [1e-30] * 8, ""), (700, rows[700 - 1][1], "")]
    return rows


def usable(rows, nonzero):
    out = {}
    for key, v, _ in rows:
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not nonzero):
            out[key] = v
    return out


def brute(vectors, step, k, measure):
    out = []
    for q, a in vectors.items():
        if q % step == 0:
            found = sorted((-measure(a, b), i) for i, b in vectors.items() if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def cosine(a, b):
    return float(T.cosines(np.array([a]), np.array([b]))[0])


def product(a, b):
    return sum(int(np.floor(1024 * x)) * int(np.floor(1024 * y)) for x, y in zip(a, b))


def test_exact_where_the_factor_is_one(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 300)
    monkeypatch.setattr(V, "BLOCK", 6)
    rows = odd_rows()
    got = sorted(map(tuple, T.nearest_neighbours(frame(spark, rows), 50, 5, factor=1.0).collect()))
    assert got == brute(usable(rows, True), 50, 5, cosine)
    assert T.nearest_neighbours(frame(spark, []), 50, 5).count() == 0


@pytest.mark.parametrize("shard", [50, 16_384])
def test_many_vectors_of_one_direction_are_ranked_exactly(spark, monkeypatch, shard):
    monkeypatch.setattr(V, "SHARD", shard)
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, 8)
    rows = [(i, (base * rng.uniform(0.1, 9)).tolist(), "") for i in range(60)] + [(60 + i, rng.normal(0, 1, 8).tolist(), "") for i in range(400)]
    got = sorted(map(tuple, T.nearest_neighbours(frame(spark, rows), 50, 5, factor=1.0).collect()))
    assert got == brute(usable(rows, True), 50, 5, cosine)


def test_products_beyond_doubles_are_told_apart(spark):
    big = 2.0**19
    rows = [(i, [big, big, (i * 7 % 40) / 1024, 1.0], "") for i in range(40)] + [(100, [big, big, 1 / 1024, 2.0], ""), (200, [-big, 3.0, 5.0, 1.0], "")]
    got = sorted(map(tuple, N.top_products(frame(spark, rows), 100, 10).collect()))
    assert got == brute(usable(rows, False), 100, 10, product)


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 300)
    monkeypatch.setattr(V, "BLOCK", 3)
    rows = odd_rows()
    got = sorted(map(tuple, N.top_products(frame(spark, rows), 100, 10).collect()))
    assert got == brute(usable(rows, False), 100, 10, product)
    big = [(i, [1e5 * (i % 7 + 1), -200.0 * i, 3.5, 0.0], "") for i in range(0, 900, 3)]
    got = sorted(map(tuple, N.top_products(frame(spark, big), 100, 10).collect()))
    assert got == brute(usable(big, False), 100, 10, product)
    assert N.top_products(frame(spark, []), 100, 10).count() == 0


def test_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in df.collect()}
    assert sorted(map(tuple, N.top_products(df).collect())) == brute(vectors, 100, 10, product)
    want, got = brute(vectors, 50, 5, cosine), sorted(map(tuple, T.nearest_neighbours(df).collect()))
    near = {(w[0], w[2]) for w in want} & {(g[0], g[2]) for g in got}
    assert len(near) >= 0.95 * len(want)


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (1.5, 0.95)])
def test_recall_of_a_large_tree(factor, least):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(40, size=6000)] + rng.normal(0, 0.25, (6000, 16))
    ids = np.arange(len(x))
    best = T.search_tree(T.build_tree(ids, x, 6), x[::50], 8, factor)[0]
    alone, beside = best, T.search_tree(T.build_tree(ids, x, 6), x[::50], 8, 1.0, factor)[1]
    assert (alone.column == beside.column).all() and np.abs(alone.score - beside.score).max() < 1e-12  # rounding follows the size of a block
    tree = T.build_tree(ids, x, 6)
    row, column, vec = V.pairs_of(best, tree.owners, ids[::50])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 120):
        s = unit @ unit[q * 50]
        s[q * 50] = -9
        want = set(np.argsort(-s, kind="stable")[:5].tolist())
        mine = sorted(((-s[v], v) for v in vec[row == q]))[:5]
        hits += len(want & {v for _, v in mine})
    assert hits >= least * 600


def test_later_cells_are_visited_only_where_they_may_help(spark, monkeypatch):
    """Clusters far apart: a query stays within its own; lengths far apart: with the longest."""
    monkeypatch.setattr(V, "SHARD", 100)
    seen = []
    whole = V.visit

    def counted(index, visits, *rest):
        seen.append(visits.select("vec_id", "shard").distinct().count())
        return whole(index, visits, *rest)

    monkeypatch.setattr(V, "visit", counted)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.02, 16)).tolist(), "") for i in range(1600)]
    got = sorted(map(tuple, T.nearest_neighbours(frame(spark, rows), 50, 5, factor=1.0).collect()))
    assert got == brute(usable(rows, True), 50, 5, cosine)
    n_queries, n_shards = 32, sum(1 for _ in range(16))
    assert seen[0] + seen[1] < n_queries * n_shards
    del seen[:]
    rows = [(i, (rng.normal(0, 1, 16) * 2.0 ** (i % 16)).tolist(), "") for i in range(1600)]
    got = sorted(map(tuple, N.top_products(frame(spark, rows), 100, 10).collect()))
    assert got == brute(usable(rows, False), 100, 10, product)
    assert seen[0] + seen[1] < 16 * 16 / 2


def test_the_factor_follows_the_measured_recall(spark, monkeypatch):
    """Recalls are those of whole searches; where no factor but one reaches the wanted recall, search is exact."""
    monkeypatch.setattr(V, "SHARD", 100)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 8).tolist(), "") for i in range(1500)] + [(2000, [1.0, 2.0], "short"), (2050, [2.0, 1.0], "short")]
    want, measured = brute(usable(rows, True), 50, 5, cosine), []
    whole = T.recalls

    def kept(*args):
        measured.append(whole(*args))
        return measured[-1]

    monkeypatch.setattr(T, "recalls", kept)
    chosen = sorted(map(tuple, T.nearest_neighbours(frame(spark, rows), 50, 5).collect()))
    pairs = {(w[0], w[2]) for w in want}
    share = lambda got: len(pairs & {(g[0], g[2]) for g in got}) / len(pairs)
    assert share(chosen) >= T.WANTED and measured[0][1.0] == 1.0
    for factor in (2.0, 6.0):
        assert abs(share(T.nearest_neighbours(frame(spark, rows), 50, 5, factor=factor).collect()) - measured[0][factor]) < 1e-9
    assert measured[0][6.0] < measured[0][2.0]
    monkeypatch.setattr(T, "FACTORS", (1.0, 6.0))
    monkeypatch.setattr(T, "recalls", lambda *args: whole(*args, factors=(1.0, 6.0)))
    assert measured[0][6.0] < T.WANTED
    assert sorted(map(tuple, T.nearest_neighbours(frame(spark, rows), 50, 5).collect())) == want
