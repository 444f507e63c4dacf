"""Toxicity by a convolutional text classifier, trained in numpy.

A word has two hashed embeddings, one of the whole word and one of its first letters, which are
added. Filters of several widths slide over the words; each filter's greatest response over the text
is kept (max pooling), and a linear layer makes a logit of the pooled responses. The first embedding
dimension starts from the smoothed log-odds of a bucket among the training texts, the rest at random.
Thresholds are calibrated by language: the language is guessed from the text's own frequent words,
and the logit is shifted so that a score of 0.5 is that language's best cut on rows that were set aside
and not fitted.

In scoring, the products of embeddings and filters are tabulated, so a filter's response is a sum of
table rows.
"""

from __future__ import annotations

import copy
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import samples
from veilspan.llm.arrow import arrow_schema, map_columns, slices

WORD = re.compile(r"[^\W\d_]+")
#: Texts that are convolved together, in bytes, and words that a task remembers.
STRETCH_BYTES, REMEMBERED = 2 << 20, 300_000
#: Bytes of text that one shard learns from, pieces in which parameters are averaged, and steps of a logit that are told apart.
SHARD_BYTES, PIECES, GRID = 16 << 20, 64, 64
# Frequent words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was are on it be".split(),
    "fr": "le la les des une du et que dans pour est pas qui au".split(),
    "de": "der die und das den mit von zu ist nicht ein eine für auf".split(),
    "es": "el los las una que por con para del se no y su al".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


@dataclass(frozen=True)
class CnnSettings:
    """positives, negatives: bounds of the samples a start is fitted on in rows, bytes: of each in bytes of text (both in
    expectation; texts of any length are drawn alike). aside: share of the sample that isn't fitted
    but stops the training and gives the cuts. words, prefixes: log2 of buckets, 16 at most. prefix: letters of a word's start. size: of an embedding. widths, filters: of the convolutions."""

    positives: int = 3_000
    negatives: int = 5_000
    bytes: int = 24 << 20
    aside: float = 0.25
    words: int = 15
    prefixes: int = 14
    prefix: int = 4
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    seed: int = 11


class Vocabulary(dict):
    """Packed bucket pair of a word: word bucket << 16 | prefix bucket; bucket 0 is padding."""

    def __init__(self, s: CnnSettings):
        super().__init__()
        self.s = s

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        whole = 1 + zlib.crc32(word.encode()) % ((1 << self.s.words) - 1)
        start = 1 + zlib.crc32(word[: self.s.prefix].encode(), 77) % ((1 << self.s.prefixes) - 1)
        value = self[word] = whole << 16 | start
        return value


def language_of(words: list[str]) -> int:
    """Index into LANGUAGES of the language whose frequent words are most frequent; ``other`` without any."""
    known = [sum(map(words.count, own)) if len(words) < 40 else 0 for own in FUNCTION_WORDS.values()]
    if len(words) >= 40:
        counts = {}
        for w in words:
            if len(w) <= 5:
                counts[w] = counts.get(w, 0) + 1
        known = [sum(counts.get(w, 0) for w in own) for own in FUNCTION_WORDS.values()]
    return int(np.argmax(known)) if max(known) else len(FUNCTION_WORDS)


def _flat(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids end to end with ``pad`` zeros after each text; where texts begin; which places may begin a window."""
    sizes = np.array([len(x) for x in ids])
    begins = np.r_[0, np.cumsum(sizes + pad)]
    flat = np.zeros(begins[-1], np.uint32)
    starts = np.zeros(begins[-1], bool)
    for x, b in zip(ids, begins.tolist()):
        flat[b : b + len(x)] = x
        starts[b : b + max(1, len(x))] = True
    return flat, begins[:-1], starts


class Cnn:
    def __init__(self, s: CnnSettings):
        rng = np.random.default_rng(s.seed)
        self.s, self.pad = s, max(s.widths)
        f4 = np.float32
        self.word = rng.normal(0, 0.05, (1 << s.words, s.size)).astype(f4)
        self.start = rng.normal(0, 0.05, (1 << s.prefixes, s.size)).astype(f4)
        self.word[0] = self.start[0] = 0
        self.filters = [rng.normal(0, 0.2, (w, s.size, s.filters)).astype(f4) for w in s.widths]
        for w in self.filters:
            w[:, 0, : s.filters // 2] = np.abs(w[:, 0, : s.filters // 2]) + 0.3
        self.bias = [np.zeros(s.filters, f4) for _ in s.widths]
        self.out = np.full(len(s.widths) * s.filters, 0.1, f4)
        self.base = f4(0)
        self.shift = np.zeros(len(LANGUAGES))

    def embed(self, packed: np.ndarray) -> np.ndarray:
        return self.word[packed >> 16] + self.start[packed & 0xFFFF]

    def pooled(self, ids: list[np.ndarray], places: bool = False):
        """Greatest response of each filter over each text, and the places where it is reached."""
        flat, begins, starts = _flat(ids, self.pad)
        known, at = np.unique(flat, return_inverse=True)
        x = self.embed(known)
        best, where = [], []
        for w, f, b in zip(self.s.widths, self.filters, self.bias):
            n = len(flat) - w + 1
            r = (x @ f[0])[at[:n]]
            for j in range(1, w):
                r += (x @ f[j])[at[j : j + n]]
            r[~starts[:n]] = -np.inf
            top = np.maximum.reduceat(r, begins, axis=0)
            best.append(top + b)
            if places:
                ends = np.r_[begins[1:], n]
                where.append(np.stack([a + r[a:e].argmax(0) for a, e in zip(begins.tolist(), ends.tolist())]))
        return (np.concatenate(best, 1), flat, where) if places else np.concatenate(best, 1)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(ids), 0).astype(np.float64) @ self.out + float(self.base)

    def step(self, ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of plain gradients; only places of greatest response take part."""
        s = self.s
        top, flat, where = self.pooled(ids, places=True)
        h = np.maximum(top, 0)
        z = h @ self.out + self.base
        slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(np.float32)
        back = slope[:, None] * self.out * (top > 0)
        self.out -= rate * (h.T @ slope + 1e-4 * self.out)
        self.base -= rate * slope.sum()
        for k, (w, f) in enumerate(zip(s.widths, self.filters)):
            g = back[:, k * s.filters : (k + 1) * s.filters]  # texts x filters
            df = np.zeros_like(f)
            for j in range(w):
                packed = flat[where[k] + j]
                x = self.embed(packed)  # texts x filters x size
                df[j] = np.einsum("tf,tfs->sf", g, x)
                dx = g[:, :, None] * f[j].T[None]
                np.add.at(self.word, packed >> 16, -0.5 * rate * dx)
                np.add.at(self.start, packed & 0xFFFF, -0.5 * rate * dx)
            f -= rate * df
            self.bias[k] -= rate * g.sum(0)
        self.word[0] = self.start[0] = 0


def _log_odds(ids: list[np.ndarray], y: np.ndarray, side, size: int) -> np.ndarray:
    """Smoothed log-odds of a bucket's presence in positive texts, shrunk where it is rare."""
    seen = np.zeros((2, size))
    for x, label in zip(ids, y.astype(int).tolist()):
        seen[label, np.unique(side(x))] += 1
    n = np.maximum(1, np.bincount(y.astype(int), minlength=2))
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    total = seen.sum(0)
    return np.clip(odds, -2, 5) * total / (total + 4)


def train(ids: list[np.ndarray], y: np.ndarray, tongues: np.ndarray, s: CnnSettings) -> Cnn:
    """The fitted and calibrated network; without texts of both labels it gives even scores of one label's share."""
    model, rng = Cnn(s), np.random.default_rng(s.seed)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.base = np.float32(-3 if not len(y) or y[0] == 0 else 3)
        return model
    order = rng.permutation(len(y))
    aside = order[: max(1, int(len(y) * s.aside))]
    learn = order[len(aside) :]
    if y[learn].min() == y[learn].max():
        learn = order
    fitted = [ids[i] for i in learn]
    model.word[:, 0] = 0.3 * _log_odds(fitted, y[learn], lambda x: x >> 16, 1 << s.words)
    model.start[:, 0] = 0.3 * _log_odds(fitted, y[learn], lambda x: x & 0xFFFF, 1 << s.prefixes)
    model.word[0] = model.start[0] = 0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    best = (np.inf, None)
    for epoch in range(s.epochs):
        mixed = rng.permutation(learn)
        for k in range(0, len(mixed), s.batch):
            b = mixed[k : k + s.batch]
            model.step([ids[i] for i in b], y[b], weight[b] / len(b), s.rate * 10 / (1 + epoch))
        z = _in_parts(model, [ids[i] for i in aside])
        loss = float((np.logaddexp(0, np.where(y[aside] == 1, -z, z)) * weight[aside]).mean())
        if loss < best[0]:
            best = (loss, [model.word.copy(), model.start.copy(), [f.copy() for f in model.filters], [b.copy() for b in model.bias], model.out.copy(), model.base])
    model.word, model.start, model.filters, model.bias, model.out, model.base = best[1]
    z, y, tongues = _in_parts(model, [ids[i] for i in aside]), y[aside], tongues[aside]
    everywhere = _best_cut(z, y)
    for t in range(len(LANGUAGES)):
        own = tongues == t
        n = int(y[own].sum())
        # a language with few positives leans on the cut of all
        model.shift[t] = (n * _best_cut(z[own], y[own]) + 10 * everywhere) / (n + 10) if n else everywhere
    return model


def _in_parts(model: Cnn, ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([model.logits(ids[k : k + 256]) for k in range(0, len(ids), 256)])


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between logits where a cut gives the best F1; zero without positives."""
    if not y.sum():
        return 0.0
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(y) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def _packed(texts: list, vocabulary: Vocabulary) -> tuple[list[np.ndarray], np.ndarray]:
    look, ids, tongues = vocabulary.__getitem__, [], []
    for text in texts:
        words = WORD.findall((text or "").lower())
        ids.append(np.fromiter(map(look, words), np.uint32, len(words)))
        tongues.append(language_of(words))
    return ids, np.array(tongues, np.int64)


def fit(documents: DataFrame, labels: DataFrame, s: CnnSettings = CnnSettings()) -> Cnn:
    """Fits on the learning folds' labelled rows; held-out rows take no part.

    A start is fitted on a bounded sample. Where that isn't every labelled row, refined() goes on from it over all of
    them, and the cuts are those of all rows that were set aside."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))
    docs = docs.where(samples.remainder(F.col("doc_id")) != 0)
    wanted = samples.labelled(labels, "toxic", 1).withColumn("label", F.lit(1)).unionByName(samples.labelled(labels, "toxic", 0).withColumn("label", F.lit(0)))
    sizes = samples.among(docs, wanted).select("doc_id", F.octet_length("text").alias("n")).join(wanted, "doc_id")
    found = {r.label: (r.rows, r.bytes) for r in sizes.groupBy("label").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).collect()}
    drawn, n_rows, n_bytes = {}, {}, 0
    for value, bound in ((1, s.positives), (0, s.negatives)):
        n_rows[value], size = found.get(value, (0, 0))
        drawn[value] = min(1.0, bound / max(1, n_rows[value]), s.bytes / max(1, size))
        n_bytes += size
    more = min(drawn.values()) < 1 and min(n_rows.values()) > 0
    own = samples.uniform(F.col("doc_id"), s.seed) < F.when(F.col("label") == 1, drawn[1]).otherwise(drawn[0])
    own = wanted.where(own & ~_aside(s) if more else own)
    got = _packed_rows(docs, own, s).join(own, "doc_id").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    ids = [np.frombuffer(x, np.uint32) for x in got["ids"].to_pylist()]
    model = train(ids, got["label"].to_numpy().astype(np.float64), got["tongue"].to_numpy(), s)
    return refined(docs, wanted, model, n_rows, -(-n_bytes // SHARD_BYTES)) if more else model


def _aside(s: CnnSettings) -> Column:
    """Whether a row is set aside from all fitting, for the cuts."""
    return samples.uniform(F.col("doc_id"), s.seed + 1) < s.aside


def _packed_rows(docs: DataFrame, wanted: DataFrame, s: CnnSettings) -> DataFrame:
    """(doc_id, tongue, ids) of the rows that may be wanted; texts of others are neither packed nor shuffled."""

    def make():
        vocabulary = Vocabulary(s)

        def apply(keys, texts):
            ids, tongues = _packed(texts, vocabulary)
            return keys, tongues.tolist(), [x.tobytes() for x in ids]

        return apply

    own = samples.among(docs, wanted)
    return map_columns(own, [own["doc_id"], own["text"]], "doc_id long, tongue int, ids binary", make)


def _parameters(model: Cnn) -> list[np.ndarray]:
    return [model.word, model.start, *model.filters, *model.bias, model.out]


def _flat_parameters(model: Cnn) -> np.ndarray:
    return np.concatenate([*(x.ravel() for x in _parameters(model)), [model.base]]).astype(np.float32)


def refined(docs: DataFrame, wanted: DataFrame, model: Cnn, n_rows: dict[int, int], shards: int) -> Cnn:
    """The model after one pass over all labelled rows, but those set aside: each shard goes on from the model by itself,
    and the parameters are averaged, by the shards' rows. The cuts are then taken from all rows set aside.

    A shard hands on its changes, most of them zero, so that what is shuffled follows its texts, not the number of shards."""
    s, total = model.s, sum(n_rows.values())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        own, rng, n = copy.deepcopy(shared.value), np.random.default_rng(s.seed), 0
        for batch in batches:
            ids = [np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()]
            y = batch.column(1).to_numpy().astype(np.float64)
            weight, order = np.where(y == 1, 0.5 / n_rows[1], 0.5 / n_rows[0]) * total, rng.permutation(len(y))
            for k in range(0, len(order), s.batch):
                b = order[k : k + s.batch]
                own.step([ids[i] for i in b], y[b], weight[b] / s.batch, s.rate * 10 / (1 + s.epochs))
            n += len(y)
        if n:
            for part, piece in enumerate(np.array_split(_flat_parameters(own) - _flat_parameters(shared.value), PIECES)):
                yield pa.RecordBatch.from_pydict({"part": [part], "shard": [TaskContext.get().partitionId()], "n": [n], "w": [piece.tobytes()]}, schema=out)

    def mean(table):
        table = table.sort_by("shard")
        n = table["n"].to_pylist()
        flat = sum(np.frombuffer(w, np.float32).astype(np.float64) * (k / sum(n)) for k, w in zip(n, table["w"].to_pylist()))
        return pa.Table.from_pydict({"part": table["part"][:1], "w": [flat.astype(np.float32).tobytes()]}, schema=averaged)

    form = "part int, shard int, n long, w binary"
    out, averaged = arrow_schema(form), arrow_schema("part int, w binary")
    own = wanted.where(~_aside(s))
    rows = _packed_rows(docs.where(~_aside(s)), own, s).repartition(shards, "doc_id").join(own.repartition(shards, "doc_id"), "doc_id")
    rows = rows.sortWithinPartitions("doc_id", "label").select("ids", "label")
    pieces = rows.mapInArrow(learn, form).groupBy("part").applyInArrow(mean, "part int, w binary").collect()
    made = copy.deepcopy(model)
    if pieces:
        flat, at = _flat_parameters(model) + np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(pieces, key=lambda r: r.part)]), 0
        for x in _parameters(made):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        made.base = flat[-1]
    aside = wanted.where(_aside(s))
    _cut(made, _logits_of(samples.among(docs.where(_aside(s)), aside), made).join(aside, "doc_id"))
    return made


def _logits_of(docs: DataFrame, model: Cnn) -> DataFrame:
    """(doc_id, tongue, z): a row's language and logit in steps of 1 / GRID, before any cut; so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, tongue int, z int"
    out = arrow_schema(schema)

    def run(batches):
        vocabulary = Vocabulary(shared.value.s)
        for batch in batches:
            for part in slices(batch, STRETCH_BYTES):
                ids, tongues = _packed(part.column(1).to_pylist(), vocabulary)
                z = np.rint(np.clip(shared.value.logits(ids), -60, 60) * GRID)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tongues.astype(np.int32)), pa.array(z.astype(np.int32))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _cut(model: Cnn, rows: DataFrame) -> None:
    """Sets the cuts of languages from rows (tongue, z, label) that weren't fitted."""
    got = rows.groupBy("tongue", "z").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).toArrow()  # bounded by the grid
    tongues, z, hits, n = (got[c].to_numpy() for c in ("tongue", "z", "hits", "n"))
    if not hits.sum():
        return

    def best(own):
        steps, at = np.unique(-z[own], return_inverse=True)
        h, all_ = np.bincount(at, hits[own]), np.bincount(at, n[own])
        k = int(np.argmax(2 * np.cumsum(h) / (np.cumsum(all_) + h.sum())))
        return -(steps[k] + (steps[k + 1] if k + 1 < len(steps) else steps[k] + 2 * GRID)) / 2 / GRID

    everywhere = best(tongues >= 0)
    for t in range(len(LANGUAGES)):
        own = tongues == t
        k = int(hits[own].sum())
        # a language with few positives leans on the cut of all
        model.shift[t] = (k * best(own) + 10 * everywhere) / (k + 10) if k else everywhere


def score(documents: DataFrame, model: Cnn, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; only doc_id and text are read.

    A null text counts as empty; an empty text is scored by the filters' response to padding. Null
    ids stay null and aren't held out; repeated rows give repeated rows; texts are read whole."""
    schema = "doc_id long, held_out boolean, score double, predicted int"
    out = arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by CnnSettings

    def run(batches):
        network = shared.value
        vocabulary = Vocabulary(network.s)
        for batch in batches:
            for part in slices(batch, STRETCH_BYTES):
                ids, tongues = _packed(part.column(2).to_pylist(), vocabulary)
                z = network.logits(ids) - network.shift[tongues]
                probability = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(probability), pa.array((probability >= threshold).astype(np.int32))], schema=out
                )

    key = documents["doc_id"].cast("long")
    rows = documents.select(key.alias("doc_id"), samples.held_out(key).alias("held_out"), documents["text"].alias("text"))
    return rows.mapInArrow(run, schema)
