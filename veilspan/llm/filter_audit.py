"""An audit of how filters interact: what each removes in every order, what it alone removes, and its Shapley share.

Texts are measured on their Arrow buffers: byte classes by table, counts by prefix sums. A word's hash is a
sum over its bytes; the hashes of a text are sorted, and neighbours with equal hashes are compared byte by
byte, so counts of different words are exact. From then on a text is a mask of the filters that it fails,
and rows with equal masks are added up before anything is multiplied by the orders.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema, slices

LETTERS = "ABCDE"
#: Bytes of text that are looked at once; a longer text is taken in pieces.
PIECE = 1 << 20
#: Bytes of a word from which it is compared on its own.
LONG_WORD = 4096

_SIGNS = np.arange(256)
_SPACE = (_SIGNS == 0x20) | ((_SIGNS >= 0x09) & (_SIGNS <= 0x0D))
_CAPITAL = (_SIGNS >= 0x41) & (_SIGNS <= 0x5A)
_SYMBOL = np.isin(_SIGNS, np.frombuffer(b"#$%&*|", np.uint8))
_POINT = (_SIGNS & 0xC0) != 0x80
#: Capitals, code points and symbols in one number, 21 bits each, so that one prefix sum counts all three.
_FIELD = 21
_CLASSES = (_CAPITAL.astype(np.int64)) | (_POINT.astype(np.int64) << _FIELD) | (_SYMBOL.astype(np.int64) << 2 * _FIELD)
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, _ODD)]), dtype=np.uint64)
    return _powers[:n]


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, hashes) of the words of texts that lie one after the other; edges: where texts begin."""
    inside = ~_SPACE[data]
    cut = np.ones(len(data) + 1, bool)  # whether a word may not go on from the byte before
    cut[1:-1] = ~inside[:-1]
    cut[edges[edges < len(data)]] = True
    starts = np.flatnonzero(inside & cut[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    last[inner - 1] = True
    lengths = np.flatnonzero(inside & last) + 1 - starts
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(begins[-1] + lengths[-1]) - np.repeat(begins, lengths)
    return starts, lengths, np.add.reduceat(_MIX[data[inside]] * powers(int(lengths.max()))[place], begins)


def same_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the words at a and at b, of these lengths, are equal byte for byte; blocks of bounded bytes."""
    same = np.zeros(len(a), bool)
    long = np.flatnonzero(lengths > LONG_WORD)
    for i in long:
        same[i] = np.array_equal(data[a[i] : a[i] + lengths[i]], data[b[i] : b[i] + lengths[i]])
    rest = np.flatnonzero(lengths <= LONG_WORD)
    blocks = np.cumsum(lengths[rest]) // PIECE
    for block in np.split(rest, np.flatnonzero(np.diff(blocks)) + 1) if len(rest) else ():
        n = lengths[block]
        begins = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begins, n)
        equal = data[np.repeat(a[block], n) + place] == data[np.repeat(b[block], n) + place]
        same[block] = np.logical_and.reduceat(equal, begins)
    return same


def distinct_words(data: np.ndarray, texts: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], n_texts: int) -> np.ndarray:
    """The number of different words of each text; texts: the text of each word."""
    starts, lengths, hashes = found
    order = np.lexsort((lengths, hashes, texts))
    starts, lengths, hashes, texts = starts[order], lengths[order], hashes[order], texts[order]
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])
    pairs = np.flatnonzero(again)
    alike = lengths[pairs] == lengths[pairs - 1]
    alike[alike] = same_words(data, starts[pairs[alike] - 1], starts[pairs[alike]], lengths[pairs[alike]])
    counts = np.bincount(texts[~again], minlength=n_texts)
    for text in np.unique(texts[pairs[~alike]]):  # different words with one hash: that text is counted word by word
        own = texts == text
        counts[text] = len({data[s : s + n].tobytes() for s, n in zip(starts[own], lengths[own], strict=True)})
    return counts


def _fields(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _FIELD) - 1
    return sums & low, (sums >> _FIELD) & low, sums >> 2 * _FIELD


def measured(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(texts x 5): words, different words, capitals, code points and symbols of texts of PIECE bytes or less in all."""
    n_texts = len(edges) - 1
    found = words_of(data, edges[:-1])
    texts = np.searchsorted(edges, found[0], side="right") - 1
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASSES[data], out=sums[1:])
    capitals, points, symbols = _fields(sums[edges[1:]] - sums[edges[:-1]])
    return np.stack([np.bincount(texts, minlength=n_texts), distinct_words(data, texts, found, n_texts), capitals, points, symbols], 1)


def pieces(data: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Stretches of a long text that no word crosses, of ``most`` bytes or less; a longer word is a stretch of its own."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                while end < len(data) and not len(ahead := np.flatnonzero(_SPACE[data[end : end + most]])):
                    end = min(end + most, len(data))
                end = end if end == len(data) else end + int(ahead[0])
        yield at, end
        at = end


def measured_long(data: np.ndarray) -> np.ndarray:
    """As measured(), of one text of any length."""
    totals, found = np.zeros(5, np.int64), []
    for at, end in pieces(data):
        if end - at > PIECE:  # one word
            whole = int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little")
            found.append((np.array([at]), np.array([end - at]), np.array([whole], np.uint64)))
        else:
            starts, lengths, hashes = words_of(data[at:end], np.zeros(1, np.int64))
            found.append((starts + at, lengths, hashes))
        for k in range(at, end, PIECE):
            totals[2:] += np.array(_fields(_CLASSES[data[k : min(end, k + PIECE)]].sum()))
    words = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    totals[0] = len(words[0])
    totals[1] = distinct_words(data, np.zeros(len(words[0]), np.int64), words, 1)[0]
    return totals


def measured_texts(texts: pa.Array, piece: int = PIECE) -> np.ndarray:
    """(texts x 5) of an Arrow array of strings, read where it lies; null counts as empty."""
    texts = texts.fill_null("")
    _, offsets, held = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    out, at = np.zeros((len(texts), 5), np.int64), 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, ends[at] + piece, side="right")) - 1  # texts that fit into a piece
        if stop <= at:
            out[at] = measured_long(data[ends[at] : ends[at + 1]])
            at += 1
        else:
            out[at:stop] = measured(data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
            at = stop
    return out


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measures(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols): one row for each row.

    A null text counts as empty and a null part as an empty string; texts of any length are read whole, in
    pieces; ``digest`` is the text's sha256."""
    schema = "doc_id long, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES)
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for few in slices(batch):
                counts = measured_texts(few.column(3))
                yield pa.RecordBatch.from_arrays([*few.columns[:3], *(pa.array(c) for c in counts.T)], schema=out)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.col(text).alias("text"),
    )
    return rows.mapInArrow(run, schema)


def failing() -> Column:
    """The filters of a text's own that it fails, as bits in the order of their letters."""
    fails = (
        F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.col("n_capitals") > 10 * F.col("n_points"), F.col("n_symbols") > 0,
    )
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + fail.cast("int") * (1 << bit)
    return mask


def masks(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many texts of each part fail exactly the filters of a mask, and how many of
    those have the label quality 1 or toxic 1. found: (doc_id, part, digest, own), ``own`` the bits of failing().

    A text fails the last filter if a smaller id has the same. Equal texts are added up by part, label and
    mask before they meet, so a group of copies of any size is a few rows. Null ids are smaller than none
    and larger than none. A document with several labels has each value that any of them has."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    rows = found.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ("digest", "part", "own", "good", "toxic")
    once = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))  # nulls are passed over by min
    apart = once.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(known).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("first.doc_id").over(Window.partitionBy("digest"))
    spared = F.coalesce(F.when(F.col("first.doc_id") == first, F.col("first.n")), F.lit(0)) + F.col("no_id")
    parted = apart.withColumn("spared", spared)
    both = F.array(
        F.struct(F.col("own").alias("mask"), F.col("spared").alias("n")),
        F.struct((F.col("own") + (1 << 4)).alias("mask"), (F.col("n") - F.col("spared")).alias("n")),
    )
    each = parted.select("part", "good", "toxic", F.explode(both).alias("m")).where("m.n > 0")
    total = lambda c: F.sum(F.col("m.n") * c).alias
    return each.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum("m.n").alias("n"), total(F.col("good"))("good"), total(F.col("toxic"))("toxic"))


def steps() -> list[dict]:
    """Every step of every order: its filter's bit, and the bits of those before it."""
    out = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, bit in enumerate(order, 1):
            out.append({"filter_order": "".join(LETTERS[b] for b in order), "step": step, "bit": 1 << bit, "before": before})
            before |= 1 << bit
    return out


def audit(of: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of masks().

    A row for each part, order and step, those with zeros included. A text that fails k filters is removed
    by each of them in 120 / k orders, which is what shapley adds up."""
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = of.select("*", F.explode(table).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    left = F.col("mask").bitwiseAND(F.col("bit") + F.col("before")) == 0
    counted = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = F.expr("n * (120 div greatest(bit_count(mask), 1))")
    return rows.groupBy("part", "filter_order", "step").agg(
        counted(left, "n").alias("kept"), counted(fails & ~gone, "n").alias("removed"), counted(fails & gone, "n").alias("redundant"),
        counted(F.col("mask") == F.col("bit"), "n").alias("unique_fails"), counted(fails & ~gone, "good").alias("good_lost"),
        counted(fails & ~gone, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents by language. Null texts are empty texts, a null language is the part with the empty
    name, null ids are never copies; rows that repeat an id count each; an empty table has no part and so no
    row. Columns other than those named aren't read."""
    found = measures(docs).select("doc_id", "part", "digest", failing().alias("own"))
    return audit(masks(found, labels.select("doc_id", "quality", "toxic")))


def oracle() -> str:
    """The audit in SQL."""
    orders = ", ".join(f"'{''.join(LETTERS[b] for b in p)}'" for p in permutations(range(len(LETTERS))))
    counted = lambda when, what="1": f"coalesce(sum({what}) FILTER ({when}), 0)::BIGINT"
    fails, gone = "mask & bit <> 0", "mask & before <> 0"
    return f"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
      firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
      masked AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
      steps AS (SELECT o AS filter_order, s::INT AS step, (1 << (ascii(o[s]) - 65))::INT AS bit,
        list_sum([0] || list_transform(string_split(o[1:s - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END))::INT AS before
        FROM (SELECT unnest([{orders}]) AS o), range(1, 6) AS r(s))
      SELECT part, filter_order, step, {counted('mask & (bit | before) = 0')} AS kept, {counted(f'{fails} AND NOT {gone}')} AS removed, {counted(f'{fails} AND {gone}')} AS redundant,
        {counted('mask = bit')} AS unique_fails, {counted(f'{fails} AND NOT {gone}', 'good')} AS good_lost, {counted(f'{fails} AND NOT {gone}', 'toxic')} AS toxic_lost,
        {counted(fails, '120 // greatest(bit_count(mask), 1)')} AS shapley
      FROM masked, steps GROUP BY part, filter_order, step"""


__all__ = ["audit", "failing", "filter_interactions", "masks", "measures", "oracle"]
