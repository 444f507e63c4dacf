import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from veilspan.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def some_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "bb", "Word", "日本", "é", "$", "#x", " ", "\t", "\n", " ", " ", "Z" * 40, "q" * 3]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_measures_equal_plain_counts(piece, monkeypatch):
    texts = [*some_texts(piece, 80), None, "", " ", "A", " x ", "ab" * 500 + " " + "ab" * 500]
    monkeypatch.setattr(A.pieces, "__defaults__", (max(piece, 3),))
    monkeypatch.setattr(A, "PIECE", max(piece, 3))
    column = pa.array(["skipped", *texts])[1:]
    assert A.measured_texts(column, piece).tolist() == [counts(t) for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "_MIX", np.zeros(256, np.uint64))
    texts = some_texts(9, 40)
    assert A.measured_texts(pa.array(texts)).tolist() == [counts(t) for t in texts]


def test_a_very_long_text_and_a_very_long_word():
    text = "word Word " * 300_000 + "x" * 5_000_000 + " " + "x" * 5_000_000 + " y"
    assert A.measured_texts(pa.array([text, "a b"])).tolist() == [counts(text), counts("a b")]


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for d, text, lang in docs:
        text = text or ""
        n, distinct, capitals, points, symbols = counts(text)
        twin = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs)
        fails = {k for k, f in zip("ABCDE", (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, symbols > 0, twin)) if f}
        rows.append((lang or "", fails, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, share = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        some = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                share[f] += len(removed)
                kept = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(removed)
                some.append((part, "".join(order), step, len(kept), len(removed), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)))
                left = kept
        out += [(*s, share[s[1][s[2] - 1]]) for s in some]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["w " * 120, " ".join(f"w{i}" for i in range(120)), "A B C", "a # b", None, "", " ".join(f"W{i}" for i in range(120)) + " $"]
    docs = [(rng.randrange(40), rng.choice(base), rng.choice(["en", "de", None, ""])) for _ in range(150)] + [(None, base[1], "en"), (None, base[1], "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n int")
    marks = spark.createDataFrame([(a, b if b is None else int(b), c if c is None else int(c), "y") for a, b, c in labels], "doc_id long, quality int, toxic int, part string")
    got = A.filter_interactions(frame, marks).collect()
    assert sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert A.filter_interactions(one, labels).count() == 600
