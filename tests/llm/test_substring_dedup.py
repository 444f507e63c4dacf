import hashlib
import random
import re

import numpy as np

from veilspan.llm import substring_dedup as D
from veilspan.sources.tables import read_table


def plain(rows, window=20):
    """Each document's words less those that earlier windows cover, by a table of all windows."""
    words = [(k, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for k, t in rows]
    first = {}
    for k, w in words:
        if k is None:
            continue
        for s in range(len(w) - window + 1):
            seq = tuple(w[s : s + window])
            first[seq] = min(first.get(seq, (k, s)), (k, s))
    out = []
    for k, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if k is not None and first[tuple(w[s : s + window])] < (k, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(k), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df, **more):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in D.remove_repeats(df, **more).collect())


def test_equals_a_table_of_all_windows(spark):
    df = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = run(df.repartition(5))
    assert got == plain(rows) and sum(g[2] for g in got) > 0


def test_random_texts_of_few_words_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i * 3 % 61, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))))
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(500 + i, f"x{i} {passage} y{i}") for i in range(40)]
    rows += [(700, "a " * 3000), (701, None), (702, ""), (None, passage), (None, "a " * 40), (703, passage), (703, passage), (704, passage + " " + passage)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, runs int")
    assert run(df.repartition(7)) == plain(rows)
    assert run(df.limit(0)) == []
    kept = D.remove_repeats(df, keep_text=True).where("doc_id = 510").first()
    assert kept.kept == "x10 y10"


def test_stretches_and_a_saturated_sketch_lose_nothing(spark, monkeypatch):
    rows = [tuple(r) for r in read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, size=D.SketchSize(rows=1, most=1), gram=1) == plain(rows)


def test_minimizers_of_equal_windows_are_equal():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    starts, place, value = D.Minimizers(20, 8)([words, words[:30], [b"z"]])
    seen = {}
    flat = words + words[:30] + [b"z"]
    for s, p in zip(starts.tolist(), place.tolist()):
        assert s <= p <= s + 12
        assert seen.setdefault(tuple(flat[s : s + 20]), value[p]) == value[p]
        assert value[p] == value[s : s + 13].min() and p == s + int(np.argmin(value[s : s + 13]))
