"""Positive-unlabelled quality classifier: non-negative unbiased risk over form features of a text.

Positives are the trusted rows (quality 1 in the learning folds), the rest is unlabelled web text.
The class prior of the unlabelled text is estimated from the data: the share of unlabelled text in
any region, over the share of positives there, is never below the prior, so the least such ratio
over regions cut out by a plain positive-against-unlabelled score is taken. The classifier, a small
network on byte frequencies and word-form rates, minimises the non-negative risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

by stochastic gradients; where the second term is negative its gradient is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import samples
from veilspan.llm.arrow import map_columns

GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [*range(9, 14), 32], "high": range(128, 256)}
SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(GROUPS) + len(SYMBOLS) + 7


def features(text: bytes) -> np.ndarray:
    """Rates of the whole text, whatever its length; an empty text has zeros but for the last, a constant."""
    out = np.zeros(N_FEATURES, np.float32)
    out[-1] = 1.0
    if not text:
        return out
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    for i, group in enumerate(GROUPS.values()):
        out[i] = seen[list(group)].sum() / n
    at = len(GROUPS)
    out[at : at + len(SYMBOLS)] = np.sqrt(seen[SYMBOLS] / n)
    at += len(SYMBOLS)
    words = text.split()
    if words:
        letters = max(1, seen[65:91].sum() + seen[97:123].sum())
        out[at] = seen[65:91].sum() / letters
        out[at + 1] = sum(map(eq, words, words[1:])) / len(words)
        out[at + 2] = len(set(words)) / len(words)
        out[at + 3] = min(n / len(words), 40) / 10
        out[at + 4] = np.log1p(len(words)) / 10
        lines = text.split(b"\n")
        out[at + 5] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass(frozen=True)
class PuSettings:
    """positives, unlabelled: bounds of the samples that the model is fitted on; texts of the sample
    are read whole. hidden, epochs, batch, rate: of the network and its training. reach: the least
    share of positives in a region that may set the prior. seed: of sampling and of the start."""

    positives: int = 8_000
    unlabelled: int = 16_000
    hidden: int = 16
    epochs: int = 40
    batch: int = 512
    rate: float = 0.01
    decay: float = 1e-4
    reach: float = 0.3
    seed: int = 7


class Network:
    """One hidden layer of tanh units, trained by Adam."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def standardise(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)

    def inner(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[0] + self.w[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.inner(x) @ self.w[2] + self.w[3]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """One step down; slope: the risk's derivative by each row's logit."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        back = np.outer(slope, self.w[2]) * (1 - h * h)
        grads = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for k, g in enumerate(grads):
            g = g + decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] = self.w[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_prior(p: np.ndarray, u: np.ndarray, reach: float) -> float:
    """The least ratio of shares above a cut, unlabelled over positive, over cuts that keep ``reach`` of the positives."""
    p, u = np.sort(p), np.sort(u)
    cuts = np.quantile(p, np.linspace(0, 1 - reach, 200))
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    slack = np.sqrt(np.log(20) / (2 * len(u)))  # so that chance doesn't set the least ratio
    return float(np.clip(np.min((above_u + slack) / above_p), 0.05, 0.98))


def _batches(n_p: int, n_u: int, s: PuSettings, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rounds = max(1, -(-max(n_p, n_u) // s.batch))
    for _ in range(s.epochs):
        p, u = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(rounds):
            yield p[np.arange(k * s.batch, (k + 1) * s.batch) % n_p][: max(1, n_p)], u[np.arange(k * s.batch, (k + 1) * s.batch) % n_u]


def train(p: np.ndarray, u: np.ndarray, s: PuSettings) -> tuple[Network, float]:
    """The fitted network and the prior. Without positives or unlabelled rows the network is even: score 0.5."""
    rng = np.random.default_rng(s.seed)
    network = Network(N_FEATURES, s.hidden, rng)
    if not len(p) or not len(u):
        network.w[2][:] = 0
        return network, 0.5
    everything = np.concatenate([p, u])
    probe = Network(N_FEATURES, s.hidden, np.random.default_rng(s.seed + 1))
    probe.standardise(everything)
    # half of the rows fit the plain score, the other half give the shares, which must not be fitted
    fit_p, fit_u = p[: max(1, len(p) // 2)], u[: max(1, len(u) // 2)]
    ask_p, ask_u = p[len(p) // 2 :], u[len(u) // 2 :]
    for i, j in _batches(len(fit_p), len(fit_u), PuSettings(epochs=max(1, s.epochs // 4), batch=s.batch), rng):
        x = np.concatenate([fit_p[i], fit_u[j]])
        y = np.r_[np.ones(len(i)), np.zeros(len(j))]
        weight = np.r_[np.full(len(i), 0.5 / len(i)), np.full(len(j), 0.5 / len(j))]
        probe.step(x, (_sigmoid(probe.logit(x)) - y) * weight, s.rate, s.decay)
    prior = class_prior(probe.logit(ask_p), probe.logit(ask_u), s.reach)
    network.standardise(everything)
    for i, j in _batches(len(p), len(u), s, rng):
        fp, fu = network.logit(p[i]), network.logit(u[j])
        # logistic loss: log(1 + exp(-f)) for the positive label, log(1 + exp(f)) for the negative one
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        to_u, from_p = _sigmoid(fu) / len(j), -prior * _sigmoid(fp) / len(i)
        if negative >= 0:
            slope = np.r_[-prior * _sigmoid(-fp) / len(i) + from_p, to_u]
        else:
            slope = np.r_[-from_p, -to_u]
        network.step(np.concatenate([p[i], u[j]]), slope, s.rate, s.decay)
    return network, prior


def _collected(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample of documents."""
    rows = map_columns(
        docs, [docs["doc_id"], docs["text"].cast("binary")], "doc_id long, x binary",
        lambda: lambda keys, texts: (keys, [features(t or b"").tobytes() for t in texts]),
    ).toArrow()
    rows = rows.sort_by("doc_id")
    return np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def fit(documents: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()) -> tuple[Network, float]:
    """Fits on bounded samples of the learning folds; held-out rows give neither labels nor texts."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))
    docs = docs.where(samples.remainder(F.col("doc_id")) != 0)
    trusted = samples.labelled(labels, "quality", 1)
    wanted = samples.draw(trusted, settings.positives, settings.seed)
    p = _collected(docs.join(wanted, "doc_id", "left_semi"))
    u = _collected(samples.draw(docs, settings.unlabelled, settings.seed + 1))
    return train(p, u, settings)


def score(documents: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; only doc_id and text are read.

    A null text counts as empty and is scored like one; null ids stay null and aren't held out."""

    def make():
        def apply(keys, out, texts):
            x = np.stack([features(t or b"") for t in texts]) if texts else np.empty((0, N_FEATURES))
            s = _sigmoid(network.logit(x.astype(np.float64)))
            return keys, out, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())

        return apply

    key = documents["doc_id"].cast("long")
    columns = [key.alias("doc_id"), samples.held_out(key).alias("held_out"), documents["text"].cast("binary").alias("text")]
    return map_columns(documents, columns, "doc_id long, held_out boolean, score double, predicted int", make)


def keep_quality(documents: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """The rows of a table of documents that the classifier accepts, with the columns of documents."""

    def make():
        def apply(keys, texts, langs, sources, sizes):
            x = np.stack([features((t or "").encode()) for t in texts]) if texts else np.empty((0, N_FEATURES))
            stays = np.flatnonzero(_sigmoid(network.logit(x.astype(np.float64))) >= threshold).tolist()
            return [[c[i] for i in stays] for c in (keys, texts, langs, sources, sizes)]

        return apply

    rows = documents.select("doc_id", "text", "lang", "source", "n_chars")
    return map_columns(rows, [rows[c] for c in rows.columns], rows.schema, make)


__all__ = ["Network", "PuSettings", "class_prior", "features", "fit", "keep_quality", "score", "train"]
