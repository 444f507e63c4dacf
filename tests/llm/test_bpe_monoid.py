import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm.bpe_monoid import TreeCodec, decode_ids, encode_texts, load_ranks, merged_ids, public_tokenizer, round_trip_digests

CODEC = TreeCodec(*public_tokenizer(), leaf_chars=7)
PATH, PATTERN = public_tokenizer()
WHOLE = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH)[0], special_tokens={}).encode_ordinary
PIECES = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "a", "the", "Été", "ß", "12", "3", "!", "$$$", " ", " ", "中文", "🙂", "é", "\x1c", "\x85", "ǅ", "१२", "²"]


def same(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == WHOLE(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_tree_equals_whole_on_awkward_pieces(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_tree_equals_whole_on_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 3000, "ab1" * 2000, "中" * 999, "'" * 500 + "s"])
def test_long_runs(text):
    same(text)


def test_merging_by_rank_equals_the_plain_rule():
    """The least pair, found anew each time."""
    ranks = {bytes([b]): b for b in range(97, 123)} | {b"ab": 200, b"bc": 150, b"abc": 300, b"aa": 210, b"aaa": 205, b"bcd": 120}
    rng = random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choices(b"abcd", k=rng.randrange(1, 12)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert merged_ids(piece, ranks) == [ranks[p] for p in parts]


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        TreeCodec(PATH, r"\S+|\s+")


def test_operator_on_odd_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(PIECES) for _ in range(20000))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (4, "twice", "x"), (4, "twice", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")  # value clashes with an inner name
    got = round_trip_digests(df, "doc_id", "text", *public_tokenizer()).collect()
    want = []
    for key, text, _ in rows:
        ids = np.array(WHOLE(text or ""), "<u4")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((key, len(ids), sha(ids.tobytes()), sha((text or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = encode_texts(df, "doc_id", "text", *public_tokenizer())
    back = decode_ids(ids, "doc_id", "ids", *public_tokenizer()).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(a), b or "") for a, b, _ in rows)
    assert round_trip_digests(df.limit(0), "doc_id", "text", *public_tokenizer()).count() == 0
