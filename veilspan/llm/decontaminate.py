"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised byte by byte: A-Z in lower case, every other ASCII sign that isn't a letter or a
digit a space; signs beyond ASCII are letters. So a word keeps its place in the text, and what is found
by words is mapped back to offsets of the original. A window is ``window`` consecutive words of an item
(a shorter item is one window); the automaton's letters are numbered words, so it has a node for a
word, not for a sign. Each text is read once, whatever the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema, slices

WINDOW = 10
#: Bytes of windows that one automaton holds; what is beyond is dealt to further automata.
AUTOMATON_BYTES = 16 << 20
#: Bytes of text whose words are held at once.
PIECE = 1 << 20

# The signs of words, after A-Z have been put in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LETTERS = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))
_WORDS = re.compile(rb"[^ ]+")


def words(text: Column) -> Column:
    """array<string>: the normalised words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window): each item's different windows, words joined by a space. Items without words have none."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = F.transform(starts, lambda at: F.array_join(F.slice("w", at, F.lit(window)), " "))
    return rows.select("item", F.explode(F.array_distinct(each)).alias("window")).distinct()


class Automaton:
    """The automaton of some windows: vocabulary, and for each window its length and its items."""

    def __init__(self, found: list[tuple[str | None, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.keys = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item, window in found:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split())
            known = self.keys.get(key, None)
            if known is None:
                known = (len(key), len(self.items))
                self.items.append(set())
                self.keys.add_word(key, known)
            if item is not None:
                self.items[known[1]].add(item)
        self.overlap = max((length for length, _ in self.keys.values()), default=1) - 1
        if found:
            self.keys.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[list[int]], list[str]]:
        """(number of words, hit stretches as [first, last + 1, start byte, end byte], items) of a text in UTF-8."""
        normal, seen, stretches, n = text.translate(NORMAL), set(), [], 0
        tail: tuple[int, ...] = ()  # the numbers of the words before the piece that a window may begin with
        for at, end in pieces(normal):
            numbers = [self.numbers.get(w, 0) for w in normal[at:end].split()]
            if self.items and numbers:
                held = (*tail, *numbers)
                base = n - len(tail)
                for last, (length, which) in self.keys.iter(held):
                    if last < len(tail):
                        continue  # found in the piece before
                    first, stop = base + last + 1 - length, base + last + 1
                    seen.add(which)
                    # ends ascend, so only what was found last can touch what is found now
                    while stretches and first < stretches[-1][1]:
                        first = min(first, stretches.pop()[0])
                    stretches.append([first, stop])
                tail = held[max(0, len(held) - self.overlap) :]
            n += len(numbers)
        return n, placed(normal, stretches), sorted(set().union(*(self.items[w] for w in seen)))


def pieces(normal: bytes, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Stretches of a normalised text of about ``most`` bytes, cut at spaces only; a longer word stays whole."""
    at = 0
    while at < len(normal):
        end = normal.find(b" ", at + most) if at + most < len(normal) else -1
        end = len(normal) if end < 0 else end
        yield at, end
        at = end


def placed(normal: bytes, stretches: list[list[int]]) -> list[list[int]]:
    """The stretches of words with the bytes where they start and end."""
    out, wanted = [], iter(stretches)
    first, stop = next(wanted, (None, None))
    if first is None:
        return out
    start = 0
    for n, m in enumerate(_WORDS.finditer(normal)):
        if n == first:
            start = m.start()
        if n == stop - 1:
            out.append([first, stop, start, m.end()])
            first, stop = next(wanted, (None, None))
            if first is None:
                break
    return out


def code_points(text: bytes, stretches: list[list[int]]) -> list[dict]:
    """Bytes as code points: those before a place are the bytes that continue no sign."""
    out, at, signs = [], 0, 0
    for first, stop, start, end in stretches:
        signs += len(text[at:start].decode())
        width = len(text[start:end].decode())
        out.append({"first_word": first, "end_word": stop, "start": signs, "end": signs + width})
        at, signs = end, signs + width
    return out


HITS = "array<struct<first_word:long,end_word:long,start:long,end:long>>"
FOUND = f"doc_id long, mark string, n_words long, hits {HITS}, items array<string>"


def _scanned(docs: DataFrame, found: list[tuple[str | None, str]]) -> DataFrame:
    """One row for each row of (doc_id, mark, text as bytes), by one automaton."""
    held = docs.sparkSession.sparkContext.broadcast(found)
    out = arrow_schema(FOUND)

    def run(batches):
        automaton = Automaton(held.value)
        for batch in batches:
            for part in slices(batch):
                ids, marks, texts = part.columns
                counts, hits, items = [], [], []
                for text in texts:
                    text = text.as_py() or b""
                    n, stretches, named = automaton.scan(text)
                    counts.append(n)
                    hits.append(code_points(text, stretches))
                    items.append(named)
                yield pa.RecordBatch.from_arrays([ids, marks, *(pa.array(v, f.type) for v, f in zip((counts, hits, items), list(out)[2:], strict=True))], schema=out)

    return docs.mapInArrow(run, FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items): for each row of ``docs`` its words, those inside an occurrence of
    a window, the stretches they form (by words, and by code points of the original text, ends exclusive), and
    the items whose windows occur, as sorted strings.

    The windows are gathered in parts of some ``automaton_bytes`` bytes, one part at a time, each broadcast
    once; almost always that is one part and one pass without a shuffle. Where there are more, each is a pass
    over the texts, and what the passes found for a text is joined by its id and digest. Null texts have no
    words; null ids stay null; repeated rows give repeated rows; an item with a null id marks words but isn't
    named; repeated items count once; without items nothing is hit. No other column is read."""
    held = windows(benchmark, item_id, item_text, window).persist()
    try:
        size = held.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
        parts = max(1, -(-size // automaton_bytes))
        part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
        mark = F.lit("") if parts == 1 else F.sha2(F.coalesce(text, F.lit("")), 256)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text).cast("binary").alias("text"))
        scanned = None
        for k in range(parts):
            one = _scanned(rows, [(r["item"], r["window"]) for r in held.where(part == k).collect()])
            scanned = one if scanned is None else scanned.unionByName(one)
    finally:
        held.unpersist()
    if parts > 1:
        scanned = _together(scanned, parts)
    width = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end_word"] - h["first_word"])
    return scanned.select("doc_id", "n_words", width.alias("n_hit"), "hits", "items")


def _together(scanned: DataFrame, parts: int) -> DataFrame:
    """The passes' rows of a text as one, repeated as often as the text is."""
    apart = scanned.groupBy("doc_id", "mark").agg(
        F.min("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / parts).cast("int").alias("times"),
    )
    out = arrow_schema(FOUND)

    def run(batches):
        for batch in batches:
            ids, marks, counts, hits, items, times = batch.columns
            repeats = np.repeat(np.arange(batch.num_rows), times.to_numpy())
            whole = pa.array([joined_hits(h) for h in hits.to_pylist()], out.field("hits").type)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(repeats)) for c in (ids, marks, counts, whole, items)], schema=out)

    return apart.mapInArrow(run, FOUND)


def joined_hits(hits: list[dict]) -> list[dict]:
    """Ordered stretches, those that overlap as one."""
    out: list[dict] = []
    for h in hits:
        if out and h["first_word"] < out[-1]["end_word"]:
            last = out[-1]
            out[-1] = last | {k: max(last[k], h[k]) for k in ("end_word", "end")}
        else:
            out.append(h)
    return out


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()'s rows."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle(window: int = WINDOW) -> str:
    """The digests in SQL: windows of every width that items have are joined to the texts' own."""
    listed = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    cut = "array_to_string(w[i:(i + width - 1)], ' ')"
    return f"""WITH items AS (SELECT item_id, {listed} AS w FROM benchmark),
      wins AS (SELECT DISTINCT item_id, width, {cut} AS win FROM (SELECT item_id, w, least(len(w), {window})::INT AS width FROM items WHERE len(w) > 0),
        unnest(range(1, len(w) - width + 2)) AS u(i)),
      widths AS (SELECT DISTINCT width FROM wins),
      docs AS (SELECT row_number() OVER () AS rid, doc_id, {listed} AS w FROM documents),
      own AS (SELECT rid, i, width, {cut} AS win FROM docs, widths, unnest(range(1, len(w) - width + 2)) AS u(i)),
      found AS (SELECT rid, i, own.width, item_id FROM own JOIN wins ON wins.width = own.width AND wins.win = own.win),
      hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, width FROM found), unnest(range(i, i + width)) AS u(p) GROUP BY rid),
      named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


__all__ = ["Automaton", "contamination", "digests", "oracle", "windows"]
