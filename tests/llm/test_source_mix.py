import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.llm import source_mix as M
from veilspan.sources.tables import read_table

SMALL = M.Targets(source={"a": 1, "b": 3, "gone": 5}, lang={"en": 2, "fr": 1}, topic={"general": 1.0, "legal": 1.0}, budget=0.6)


def plain(rows, t):
    """Raking of what is kept, for each budget in turn, by plain loops: probabilities, shares, budget, missed."""
    dims = t.marginals()
    cells = {}
    for r in rows:
        key = tuple(([*dims[d]].index(v) + 1) if v in dims[d] else 0 for d, v in zip(dims, r[1]))
        cells[key] = cells.get(key, 0) + r[0]
    total = sum(cells.values())
    goals = []
    for i, m in enumerate(dims.values()):
        natural = {k: sum(n for c, n in cells.items() if c[i] == k) for k in range(len(m) + 1)}
        live = {k: v for k, v in enumerate(m.values(), 1) if natural[k] > 0}
        goals.append({k: 0.0 for k in natural} | {k: v / sum(live.values()) * (1 - natural[0] / total) for k, v in live.items()} | {0: natural[0] / total})
    room = [sum(n for c, n in cells.items() if c[i] == k) / total / share for i, goal in enumerate(goals) for k, share in goal.items() if share > 0]
    for b in t.budgets(min(t.budget, M.ROOM * min(room))):
        w = {c: n * b for c, n in cells.items()}
        for _ in range(t.rounds):
            for i, goal in enumerate(goals):
                for k, share in goal.items():
                    own = [c for c in cells if c[i] == k]
                    full, free = sum(cells[c] for c in own if w[c] >= cells[c]), sum(w[c] for c in own if w[c] < cells[c])
                    want = b * total * share
                    ratio = 0 if full + free <= 0 else (want - full) / free if free > 0 and want > full else want / (full + free)
                    w |= {c: min(cells[c] * 1e9, w[c] * ratio) for c in own}
        kept = {c: min(cells[c], w[c]) for c in cells}
        all_kept = sum(kept.values())
        far = [(d, k, abs(sum(x for c, x in kept.items() if c[i] == k) / all_kept - share)) for i, d in enumerate(dims) for k, share in goals[i].items()]
        if max(f for *_, f in far) <= M.NEAR:
            break
    missed = ",".join(f"{d}={[M.OTHER, *dims[d]][k]}" for d, k, f in far if f > 2 * M.NEAR)
    return {c: kept[c] / n if n else 1.0 for c, n in cells.items()}, {c: kept[c] / all_kept for c in cells}, all_kept / total, missed


def test_equals_plain_loops(spark):
    rows = [(i, "w " * (1 + i * 7 % 50) + ("copyright" if i % 3 else ""), "abcd"[i % 4], ["en", "fr", None][i % 3 if i % 5 else 0], "x") for i in range(200)]
    rows += [(300, None, None, None, "x"), (None, "no id", "a", "en", "x"), (301, "", "a", "en", "x"), (5, rows[5][1], "b", "fr", "x"), (302, "w " * 9000, "b", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    topic = lambda t: "legal" if "copyright" in (t or "") else "general"
    for targets in (SMALL, M.Targets(source={"a": 1, "b": 3, "gone": 5}, lang={"en": 2, "fr": 1}, topic={"general": 1.0, "legal": 9.0}, budget=0.9)):
        out = M.calibrated(df, targets).collect()
        want_p, want_w, budget, missed = plain([(len((t or "").split()), (s, lang, topic(t))) for _, t, s, lang, _ in rows], targets)
        dims = targets.marginals()
        assert len(out) == len(rows)
        for r in out:
            key = tuple(0 if v == M.OTHER else [*dims[d]].index(v) + 1 for d, v in zip(dims, (r.mix_source, r.mix_lang, r.mix_topic)))
            assert abs(r.probability - want_p[key]) < 1e-8 and abs(r.weight - want_w[key]) < 1e-8
            assert abs(r.budget - budget) < 1e-8 and r.missed == missed
        tokens = sum(r.tokens for r in out)
        assert abs(sum(r.tokens * r.probability for r in out) / tokens - budget) < 1e-6
    assert M.calibrated(df.limit(0), SMALL).count() == 0
    assert M.calibrated(spark.createDataFrame([(1, None, "a", "en")], "doc_id long, text string, source string, lang string"), SMALL).first().selected


def test_sampled_shares_meet_the_targets_and_sql_agrees(spark):
    sf, targets = "/root/testdata/sf0.01", M.Targets()
    got = M.calibrated(read_table(spark, sf, "documents")).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(M.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])
    kept = got.tokens * got.probability
    assert abs(kept.sum() / got.tokens.sum() - got.budget[0]) < 1e-6 and got.missed[0] == ""
    for d, m in targets.marginals().items():
        share = kept.groupby(got[f"mix_{d}"]).sum() / kept.sum()
        live = {v: w for v, w in m.items() if v in share.index}
        rest = 1 - share.get(M.OTHER, 0)
        assert all(abs(share[v] - w / sum(live.values()) * rest) <= 0.001 for v, w in live.items())


def test_topics(spark):
    texts = ["Released under the MIT License", "buy now, free trial", "call 555 or 666", "plain words", None, "", "licence " + "word " * 400, "İ licence"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    tokens = F.coalesce(F.regexp_count("t", F.lit(M.WORD)), F.lit(0))
    got = [r[0] for r in df.orderBy("k").select(M.topic_of(F.col("t"), tokens)).collect()]
    assert got == ["legal", "commerce", "reference", "general", "general", "general", "general", "legal"]


def test_targets_are_checked():
    with pytest.raises(ValueError):
        M.Targets(source={str(i): 1.0 for i in range(5000)}).marginals()
    with pytest.raises(ValueError):
        M.Targets(source={"a": 0.0}).marginals()


def test_no_python_in_the_plan(spark):
    df = M.calibrated(read_table(spark, "/root/testdata/sf0.001", "documents"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
