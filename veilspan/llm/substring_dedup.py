"""Exact substring de-duplication of word windows behind a count-min prefilter.

Pass one sketches every partition: each window of ``window`` words is represented by its minimizer,
the least hash among the ``gram``-word runs inside it, and every minimizer place adds one to its
cell in each row of a count-min sketch. Equal windows have equal minimizers at different places, so
the merged sketches never count a window too low. Pass two looks every window up and exactly groups
only those estimated to repeat, by the 128-bit hash of their words. No repeated window is lost.

Before the shuffle, equal windows of one stretch of a partition are reduced to the earliest; the
later ones are known to repeat. A passage that stands in a third of all documents so sends one row
for each stretch. The sketch that is broadcast has a fixed upper size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema, slices

#: Cells of one segment of the sketch, as a power of two.
SEGMENT = 19
#: Bytes of text that are hashed together, and windows that are grouped together before the shuffle.
STRETCH_BYTES, STRETCH_WINDOWS = 2 << 20, 1 << 17
#: Bytes of text for each part of the windows: some million windows, if all of them were sent.
PART_BYTES = 6 << 20
#: Words whose hashes are remembered in a task.
REMEMBERED = 150_000


@dataclass(frozen=True)
class SketchSize:
    """rows: of the sketch. most: the largest log2 of cells in a row. However large the input, the
    broadcast is rows * 2 ** most / 8 bytes at most, 32 MiB; a fuller sketch is still never too low, it
    only lets more windows into pass two."""

    rows: int = 2
    most: int = 27

    def width(self, n_words: int) -> int:
        """log2 of cells in a row, about one for each word: seven for each minimizer expected."""
        return max(SEGMENT, min(self.most, int(n_words).bit_length()))


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Minimizers:
    """Hashes words and finds, for each window start of a stretch of texts, its minimizer."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, min(gram, window)
        self.known = WordHashes()
        self.factors = np.random.default_rng(20).integers(1, 2**63, self.gram, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each window, place of its minimizer, hash at each place) over the texts' words end to end."""
        sizes = np.array([len(w) for w in texts], np.int64)
        total = int(sizes.sum())
        look = self.known.__getitem__
        hashes = np.fromiter((look(w) for words in texts for w in words), np.uint64, total)
        span = self.window - self.gram + 1
        if total < self.window:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        value = np.zeros(total - self.gram + 1, np.uint64)
        for j, factor in enumerate(self.factors):
            value += hashes[j : j + len(value)] * factor
        value = _mix(value)
        best, place, reach = value, np.arange(len(value)), 1
        while reach < span:  # minima of doubling reach; the last step overlaps
            step = min(reach, span - reach)
            right = best[step:] < best[: len(best) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            best = np.where(right, best[step:], best[: len(best) - step])
            reach += step
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(total)  # words from here to the text's end
        starts = np.flatnonzero(room >= self.window)
        return starts, place[starts], value


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    odd = np.uint64((0xD6E8FEB86659FD93 + 2 * row * 0x632BE59BD9B4E019) & (2**64 - 1) | 1)
    return _mix(hashes * odd) >> np.uint64(64 - width)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, STRETCH_BYTES)


def _split(texts) -> list[list[bytes]]:
    return [(t or b"").split() for t in texts.to_pylist()]


def merged_sketch(texts: DataFrame, width: int, rows: int, window: int, gram: int) -> list[np.ndarray]:
    """For each row of the sketch, the packed bits of cells counted twice or more over all partitions."""
    sketch = "segment int, cells binary"
    out = arrow_schema(sketch)
    per_row = 1 << (width - SEGMENT)

    def partition_sketch(batches):
        find = Minimizers(window, gram)
        kept: list[np.ndarray] = []

        def flush():
            hashes = np.concatenate(kept)
            kept.clear()
            for row in range(rows):
                cells, counts = np.unique(_cells(hashes, row, width), return_counts=True)
                cells = np.repeat(cells, np.minimum(counts, 2))  # two says as much as more
                cuts = np.searchsorted(cells, np.arange(per_row + 1, dtype=np.uint64) << np.uint64(SEGMENT))
                offsets = (cells & np.uint64((1 << SEGMENT) - 1)).astype("<u4")
                names = np.arange(per_row)[np.diff(cuts) > 0]
                blobs = [offsets[cuts[s] : cuts[s + 1]].tobytes() for s in names.tolist()]
                for at in range(0, len(names), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((names[at : at + 256] + row * per_row).astype(np.int32)), pa.array(blobs[at : at + 256], pa.binary())],
                        schema=out,
                    )

        for batch in _stretches(batches):
            starts, place, value = find(_split(batch.column(0)))
            if len(starts):
                kept.append(value[np.unique(place)])
            if sum(map(len, kept)) >= 1 << 21:
                yield from flush()
        if kept:
            yield from flush()

    bits = arrow_schema("segment int, twice binary")

    def merge(batches):
        """Rows arrive by segment; one segment's counts are held at a time."""
        now, counts = None, np.zeros(1 << SEGMENT, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()])], schema=bits)

        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now:
                    if now is not None:
                        yield done()
                    now = segment
                    counts[:] = 0
                cells = np.frombuffer(blob.as_buffer(), "<u4")
                once = cells[np.r_[True, cells[1:] != cells[:-1]]]
                counts[once] = np.minimum(counts[once] + 1, 2)
                again = cells[1:][cells[1:] == cells[:-1]]
                counts[again] = 2
        if now is not None:
            yield done()

    parts = texts.select("text").mapInArrow(partition_sketch, sketch)
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    found = [np.zeros(1 << max(0, width - 3), np.uint8) for _ in range(rows)]
    octets = 1 << (SEGMENT - 3)
    for segment, twice in merged.toLocalIterator():
        row, at = divmod(segment, per_row)
        found[row][at * octets : (at + 1) * octets] = np.frombuffer(twice, np.uint8)
    return found


def repeated_starts(texts: DataFrame, sketch: list[np.ndarray], width: int, window: int, gram: int, parts: int) -> DataFrame:
    """(doc_id, text_key, runs array<long>): runs of window starts whose words also start earlier.

    A run is start << 32 | how many starts follow one another. Windows are dealt by hash to ``parts``
    parts as blocks of columns, which are a third of the size of rows; a part is grouped at once."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    dealt = "part int, known boolean, n int, hashes binary, docs binary, keys binary, runs binary"
    dealt_out = arrow_schema(dealt)

    def candidates(batches):
        find = Minimizers(window, gram)
        rows = shared.value

        def repeats(hashes):
            yes = np.ones(len(hashes), bool)
            for r, bits in enumerate(rows):
                cells = _cells(hashes, r, width)
                yes &= (bits[(cells >> np.uint64(3)).astype(np.int64)] >> (7 - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1
            return yes

        held: list[tuple] = []

        def block(part, known, hashes, doc, key, run):
            columns = [[part], [known], [len(doc)], [hashes.tobytes()], [doc.tobytes()], [key.tobytes()], [run.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, dealt_out)], schema=dealt_out)

        def flush():
            """The earliest of each window of this stretch goes on; later ones are known to repeat."""
            hashes, doc, key, start = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((start, doc, hashes[:, 1], hashes[:, 0]))
            hashes, doc, key, start = (c[order] for c in (hashes, doc, key, start))
            new, later = _heads(hashes, doc, start)
            part = (hashes[new, 0].astype(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((start[new], doc[new], part))
            first = np.flatnonzero(new)[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = first[cuts[k] : cuts[k + 1]]
                yield block(k, False, hashes[own], doc[own], key[own], start[own] << 32 | 1)
            if later.any():
                doc, key, start = doc[later], key[later], start[later]
                order = np.lexsort((start, key, doc))
                doc, key, start = doc[order], key[order], start[order]
                fresh = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)]
                at = np.flatnonzero(fresh)
                last = np.r_[at[1:], len(start)] - 1
                yield block(int(doc[0] % parts), True, hashes[:0], doc[at], key[at], start[at] << 32 | (start[last] - start[at] + 1))

        waiting = 0
        for batch in _stretches(batches):
            docs, keys, texts = batch.columns
            words = _split(texts)
            starts, place, value = find(words)
            if not len(starts):
                continue
            starts = starts[repeats(value[place])]
            begins = np.r_[0, np.cumsum([len(w) for w in words])]
            who = np.searchsorted(begins, starts, "right") - 1
            cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, int)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(who)]):
                k = int(who[a])
                if docs[k].as_py() is None:
                    continue
                local = starts[a:b] - begins[k]
                line = b" ".join(words[k])
                ends = [0, *accumulate([len(w) + 1 for w in words[k]])]
                digest = xxhash.xxh3_128_digest
                found = np.frombuffer(b"".join([digest(line[ends[s] : ends[s + window] - 1]) for s in local.tolist()]), "<i8").reshape(-1, 2)
                n = len(local)
                held.append((found, np.full(n, docs[k].as_py()), np.full(n, keys[k].as_py()), local))
                waiting += n
                if waiting >= STRETCH_WINDOWS:
                    waiting = 0
                    yield from flush()
        if held:
            yield from flush()

    late = "doc_id long, text_key long, run long"
    late_out = arrow_schema(late)

    def group(batches):
        """Blocks arrive by part; one part's windows are held at a time, known runs pass through."""
        now, held = None, []

        def out(doc, key, run):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(run)], schema=late_out)

        def done():
            hashes, doc, key, run = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((run, doc, hashes[:, 1], hashes[:, 0]))
            hashes, doc, key, run = (c[order] for c in (hashes, doc, key, run))
            _, later = _heads(hashes, doc, run)
            return out(doc[later], key[later], run[later])

        for batch in batches:
            for part, known, *columns in zip(*(batch.column(k) for k in (0, 1, 3, 4, 5, 6))):
                hashes, doc, key, run = (np.frombuffer(c.as_buffer(), "<i8") for c in columns)
                if known.as_py():
                    yield out(doc, key, run)
                    continue
                if part.as_py() != now and held:
                    yield done()
                now = part.as_py()
                held.append((hashes.reshape(-1, 2), doc, key, run))
        if held:
            yield done()

    blocks = texts.select("doc_id", "text_key", "text").mapInArrow(candidates, dealt)
    found = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(group, late)
    return found.groupBy("doc_id", "text_key").agg(F.collect_list("run").alias("runs"))


def _heads(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by hash, document and place: which come first of their hash, and which come later
    than that. A repeated row is no earlier than itself, so it is neither."""
    new = np.r_[True, (hashes[1:] != hashes[:-1]).any(1)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return new, (doc != doc[head]) | (place != place[head])


def remove_repeats(
    df: DataFrame, window: int = 20, gram: int = 8, size: SketchSize = SketchSize(), keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): each document without the words of repeated windows.

    A word goes if a window of ``window`` consecutive words that covers it also starts earlier, in a
    smaller doc_id or earlier in the same document; windows are judged on the input. Words are
    separated by the six ASCII white-space signs and otherwise unchanged.

    A null or empty text has no words. Rows with a null doc_id stand outside the order: they lose
    nothing and nothing is lost to them. Repeated rows are equally early, so they don't count
    against one another. An empty table gives an empty table; only doc_id and text are read."""
    texts = df.select(
        df["doc_id"].cast("long").alias("doc_id"), F.xxhash64(df["text"]).alias("text_key"), df["text"].cast("binary").alias("text")
    )
    # one cheap pass sizes the sketch; the figure needs no precision
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = size.width(int(n_bytes) // 7)
    sketch = merged_sketch(texts, width, size.rows, window, gram)
    parts = 1 + int(n_bytes) // PART_BYTES
    runs = repeated_starts(texts, sketch, width, window, gram, parts)
    joined = texts.join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    out = arrow_schema(schema)

    def cut(batches):
        for batch in _stretches(batches):
            docs, _, runs = batch.columns
            counts, gone, sums, kept = [], [], [], []
            for words, run in zip(_split(batch.column(1)), runs):
                rest = words
                removed = 0
                if run.is_valid:
                    packed = run.values.to_numpy()
                    start, many = packed >> 32, packed & 0xFFFFFFFF
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + many + window - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    rest = list(compress(words, stays.tolist()))
                    removed = len(words) - len(rest)
                line = b" ".join(rest)
                counts.append(len(words))
                gone.append(removed)
                sums.append(hashlib.sha256(line).hexdigest())
                if keep_text:
                    kept.append(line.decode("utf-8", "replace"))
            columns = [docs, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, schema=out)

    return joined.mapInArrow(cut, schema)


def oracle(window: int = 20) -> str:
    """DuckDB SQL for remove_repeats() over documents: a table of all windows."""
    return f"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
      windows AS (SELECT doc_id, s, array_to_string(words[s + 1:s + {window}], ' ') AS k FROM texts, unnest(range(0, len(words) - {window - 1})) AS u(s)),
      firsts AS (SELECT k, min(struct_pack(d := doc_id, s := s)) AS f FROM windows GROUP BY k),
      gone AS (SELECT DISTINCT w.doc_id, w.s + j + 1 AS p FROM windows w JOIN firsts USING (k), range({window}) AS r(j) WHERE w.doc_id > f.d OR (w.doc_id = f.d AND w.s > f.s)),
      lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
      cut AS (SELECT doc_id, words, list_select(words, list_filter(range(1, len(words) + 1), lambda i: ps IS NULL OR NOT list_contains(ps, i))) AS kept FROM texts LEFT JOIN lists USING (doc_id))
      SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut"""
