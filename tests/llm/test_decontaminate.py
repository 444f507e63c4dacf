import hashlib
import random
import re
import time

from veilspan.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {a: a + 32 for a in range(65, 91)}


def brute(texts, items, window):
    """(n_words, n_hit, items) of each text by comparing every window with every place."""
    wins = set()
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        if w:
            wins |= {(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))}
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOW))
        hit, named = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    named.add(item)
        out.append((len(w), len(hit), sorted(str(n) for n in named - {None})))
    return out


def some_texts(rng, n, vocabulary=("a", "b", "C", "é", "日本", "x1")):
    seps = [" ", "  ", "-", "\n", "\x00", "_", " x"]
    return ["".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_equals_brute_force_by_one_automaton_and_by_many(spark):
    rng = random.Random(3)
    texts = [*some_texts(rng, 60), None, "", "...", "A b c"]
    items = [*enumerate(some_texts(rng, 12)), (7, "b c"), (7, "b c"), (None, "x1 x1"), (99, None), (98, "!!")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2), (None, "b c", 3)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([*texts, texts[0], "b c"], items, 3)
    ids = [*range(len(texts)), 0, None]
    want = sorted(((str(i), *w) for i, w in zip(ids, want)), key=str)
    for most in (1 << 20, 200):
        got = D.contamination(docs, bench, window=3, automaton_bytes=most).collect()
        assert sorted(((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want


def test_offsets_are_those_of_the_original(spark):
    text = "Über-Straße: DIE frage, lautet (wie) und 日本 warum? Rest"
    docs = spark.createDataFrame([(1, text), (2, "nichts")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "die Frage lautet wie und 日本 warum")], "item_id long, text string")
    a, b = D.contamination(docs, bench).orderBy("doc_id").collect()
    (hit,) = a.hits
    assert text[hit.start : hit.end] == "DIE frage, lautet (wie) und 日本 warum" and (hit.first_word, hit.end_word) == (2, 9)
    assert b.hits == [] and D.digests(D.contamination(docs, bench)).where("contaminated").count() == 1


def test_pieces_of_a_long_text_agree_with_the_whole(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdef") for _ in range(5000)) + " " + "z" * 3000 + " a b c d"
    found = [(str(i), " ".join(rng.choice("abcdef") for _ in range(rng.choice((1, 3, 5))))) for i in range(20)] + [("9", "a b c d")]
    whole = D.Automaton(found).scan(text.encode())
    for most in (1, 7, 64, 1000):
        monkeypatch.setattr(D.pieces, "__defaults__", (most,))
        assert D.Automaton(found).scan(text.encode()) == whole


def test_time_is_linear_in_the_text():
    automaton = D.Automaton([("1", " ".join("ab" * 5)), ("2", "a " * 10)])
    for text in (b"a " * 1_000_000, b"a" * 4_000_000, b"a b " * 500_000):
        began = time.perf_counter()
        automaton.scan(text)
        assert time.perf_counter() - began < 6


def test_no_items_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.digests(D.contamination(docs, none)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(2, 0, 0, False), (0, 0, 0, False)]
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert D.digests(D.contamination(docs.limit(0), none)).count() == 0
