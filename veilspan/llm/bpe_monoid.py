"""Byte-level BPE by monoid tree reduction.

A text is halved recursively down to leaves; each leaf is encoded alone, by splitting it into matches of
the pattern and merging the adjacent pair of bytes or tokens of least rank until none has a rank; and
two neighbours are joined by encoding again a window around their border. The window grows outwards, doubling its
reach, until each of its ends is a *seam*: a place where the pre-tokeniser must begin a match
whatever stands on the other side. Tokens beyond a seam cannot change any more, so they are kept
as they are. Decoding gives each leaf run of ids its bytes and concatenates up the tree.

Seams. A match of the splitting pattern is a run of letters, of numbers, of other signs or of
white space, the first three with one space before at most, or an apostrophe with a few letters.
So a match begins wherever a sign that isn't white space is followed by white space, and wherever
a run of letters, numbers or other signs is followed by a run of another kind, but for other signs
followed by letters (the apostrophe forms). That is proved for the patterns in SEAM_PATTERNS; others
are refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame

from veilspan.llm.arrow import map_columns

LEAF_CHARS = 512
FIRST_REACH = 16
#: Matches whose ids a task remembers, and the longest of them.
REMEMBERED, SHORT = 300_000, 32
# Splitting patterns for which is_seam() holds.
SEAM_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """The rank of each token, which is its id, and the bytes of each id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return ranks, words


def merged_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: of all adjacent pairs that are tokens the one of least rank is merged, the
    leftmost first among equals, until no pair is one. n log n in the bytes."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is part of another
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = ends[i]
        if not mid or mid == n or ends[mid] != end:
            continue  # one of its parts has been merged since
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if i:
            left = before[i]
            if (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class PieceIds(dict):
    """Ids of matches, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        found = merged_ids(piece.encode(), self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


def _kind(sign: str) -> str:
    if sign.isspace():
        return "s"
    kind = unicodedata.category(sign)[0]
    return kind if kind in "LN" else "o"


def is_seam(text: str, at: int) -> bool:
    """Whether a match begins at ``at`` in any text that has these two signs around it."""
    if at <= 0 or at >= len(text):
        return True
    before, after = _kind(text[at - 1]), _kind(text[at])
    if before == "s" or before == after:
        return False
    # marks and unassigned signs may count otherwise in another Unicode version: only ASCII, Latin and plain spaces decide
    if not (_settled(text[at - 1]) and _settled(text[at])):
        return False
    return not (before == "o" and after == "L")


def _settled(sign: str) -> bool:
    return sign < "ɐ" and not "\x1c" <= sign <= "\x1f"


def seam_before(text: str, at: int, low: int) -> int:
    """The last seam in (low, at), found in strides that double; ``low`` if there is none."""
    reach, high = FIRST_REACH, at
    while high > low:
        start = max(low, at - reach)
        for p in range(high, start, -1):
            if p < at and is_seam(text, p):
                return p
        high, reach = start, reach * 2
    return low


def seam_after(text: str, at: int, high: int) -> int:
    """The first seam in (at, high); ``high`` if there is none."""
    reach, start = FIRST_REACH, at + 1
    while start < high:
        end = min(high, at + reach)
        for p in range(start, end):
            if is_seam(text, p):
                return p
        start, reach = max(start, end), reach * 2
    return high


class TreeCodec:
    """encode() and decode() by tree reduction; equal to splitting and merging the whole text."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        if pattern not in SEAM_PATTERNS:
            raise ValueError("the seams are not proved for this splitting pattern")
        ranks, self.words = load_ranks(path)
        self.ids, self.split = PieceIds(ranks), regex.compile(pattern).findall
        self.leaf_chars = max(1, leaf_chars)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encode(text, 0, len(text)), dtype="<u4")

    def _leaf(self, text: str) -> list[int]:
        out, ids = [], self.ids
        for piece in self.split(text):
            out += ids[piece]
        return out

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self._leaf(text[low:high])
        mid = (low + high) // 2
        left, right = self._encode(text, low, mid), self._encode(text, mid, high)
        return self._join(text, low, mid, high, left, right)

    def _join(self, text: str, low: int, mid: int, high: int, left: list[int], right: list[int]) -> list[int]:
        if is_seam(text, mid):
            return left + right
        a, b = seam_before(text, mid, low), seam_after(text, mid, high)
        lose_left, lose_right = len(self._leaf(text[a:mid])), len(self._leaf(text[mid:b]))
        return left[: len(left) - lose_left] + self._leaf(text[a:b]) + right[lose_right:]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join([self.words[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode_texts(
    df: DataFrame, id_col: str | Column, text_col: str | Column, path: str, pattern: str, leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each whole text.

    A null text counts as empty and gives no ids; a null id stays null; repeated rows give repeated
    rows; an empty table gives an empty table; other columns aren't read. The rank file is opened on
    the executors, so ``path`` must be a path that every machine has, as installed packages are."""

    def make():
        codec = TreeCodec(path, pattern, leaf_chars)
        return lambda keys, texts: (keys, [codec.encode(t or "").tolist() for t in texts])

    return map_columns(df, _pair(df, id_col, text_col), "doc_id long, ids array<int>", make)


def decode_ids(df: DataFrame, id_col: str | Column, ids_col: str | Column, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary): the bytes of each list of ids; null ids count as none."""

    def make():
        codec = TreeCodec(path, pattern)
        return lambda keys, ids: (keys, [codec.decode(np.array(x or [], dtype="<u4")) for x in ids])

    return map_columns(df, _pair(df, id_col, ids_col), "doc_id long, decoded binary", make)


def round_trip_digests(
    df: DataFrame, id_col: str | Column, text_col: str | Column, path: str, pattern: str, leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both."""

    def make():
        codec = TreeCodec(path, pattern, leaf_chars)

        def apply(keys, texts):
            counts, ids_sums, text_sums = [], [], []
            for text in texts:
                ids = codec.encode(text or "")
                counts.append(len(ids))
                ids_sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return keys, counts, ids_sums, text_sums

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(df, _pair(df, id_col, text_col), schema, make)


def encoded_documents(
    df: DataFrame, id_col: str | Column, text_col: str | Column, path: str, pattern: str, leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids and their digests at one pass; odd rows as in encode_texts."""

    def make():
        codec = TreeCodec(path, pattern, leaf_chars)

        def apply(keys, texts):
            ids = [codec.encode(t or "") for t in texts]
            sums = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            return keys, list(map(len, ids)), [x.astype(np.int32) for x in ids], sums, back

        return apply

    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_columns(df, _pair(df, id_col, text_col), schema, make)


def _pair(df: DataFrame, key: str | Column, value: str | Column) -> list[Column]:
    return [
        (df[key] if isinstance(key, str) else key).cast("long").alias("doc_id"),
        (df[value] if isinstance(value, str) else value).alias("value"),
    ]


def public_tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


__all__ = ["TreeCodec", "decode_ids", "encoded_documents", "encode_texts", "public_tokenizer", "round_trip_digests"]
