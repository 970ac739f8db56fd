"""Toxicity scores from a small convolutional network over hashed words, trained in numpy.

Words become rows of a hashed embedding table. Filters of several widths slide over the text, each keeps its
largest answer (max pooling), and a linear layer turns the answers into a logit. As every filter is linear before
pooling, its part for each table row is computed once after training, and scoring a text is a sum of looked-up rows
and a running maximum. Thresholds are calibrated for each language: the language is read off the text itself by the
n-gram filters, and the score is shifted so that 0.5 is where that language's training texts are judged best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import RollingHash, binary_values, find_words, steps, tidy, utf8
from frameclinic.llm.language_id import Filters
from frameclinic.llm.language_id import learn as learn_languages

TABLE_BITS, WIDTHS, FILTERS, SIZE = 18, (1, 2, 3), 8, 12

#: Least number of training steps, whatever the rounds.
STEPS = 1_000
#: Training texts a table row must stand in to be learned.
SEEN = 5

LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words (0 is the padding between texts) and each text's edges among them."""
    low, start, stop, edge = find_words(data, offsets, LETTERS)
    if not len(start):
        return np.empty(0, np.int64), edge
    rows = (RollingHash(low).of(start, stop) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return np.maximum(rows, 1), edge


@dataclass
class Network:
    embedding: np.ndarray  # (rows, SIZE)
    kernels: list[np.ndarray]  # per width (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray  # (widths * FILTERS)
    offset: float

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        embedding = rng.normal(0, 0.05, (1 << TABLE_BITS, SIZE)).astype(np.float32)
        embedding[0] = 0
        kernels = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        return Network(embedding, kernels, bias, rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, rounds: int) -> None:
        """Adam on the class-weighted log loss; a text's gradient reaches only the words its maxima come from."""
        state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        share = labels.mean()
        # rows that few training texts have say nothing: they stay zero, here and in scoring
        seen = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=len(self.embedding)) >= SEEN
        self.embedding[~seen] = 0
        texts = [np.where(seen[t], t, 0) for t in texts]
        balance = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        step = 0

        def adam(name: str, value: np.ndarray, gradient: np.ndarray, rate: float, rows=None):
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            at = slice(None) if rows is None else rows
            m[at] = 0.9 * m[at] + 0.1 * gradient
            v[at] = 0.99 * v[at] + 0.01 * gradient**2
            value[at] -= rate * (m[at] / (1 - 0.9 ** min(step, 500))) / (np.sqrt(v[at] / (1 - 0.99 ** min(step, 2000))) + 1e-6)

        batch = 32
        rounds = max(rounds, -(-STEPS // max(1, len(texts) // batch)))
        for turn in range(rounds):
            order = rng.permutation(len(texts))
            rate = 0.01 * (1 - turn / rounds) + 0.001
            for a in range(0, len(order), batch):
                step += 1
                some = order[a : a + batch]
                rows = np.concatenate([np.concatenate([texts[i], np.zeros(max(WIDTHS), np.int64)]) for i in some])
                edge = np.concatenate([[0], np.cumsum([len(texts[i]) + max(WIDTHS) for i in some])])
                vectors = self.embedding[rows]
                pooled, winners = [], []
                for w, kernel, bias in zip(WIDTHS, self.kernels, self.bias):
                    n = len(rows) - w + 1
                    answer = sum(vectors[k : k + n] @ kernel[k] for k in range(w)) + bias
                    answer = np.concatenate([answer, np.full((w - 1, FILTERS), -np.inf, np.float32)])
                    for k in range(1, w):  # no window into the next text
                        answer[edge[1:] - k] = -np.inf
                    best = np.maximum.reduceat(answer, edge[:-1])
                    text = np.repeat(np.arange(len(some)), np.diff(edge))
                    top = np.full((len(some), FILTERS), len(rows), np.int64)
                    for f in range(FILTERS):
                        at = np.flatnonzero(answer[:, f] == best[text, f])
                        np.minimum.at(top[:, f], text[at], at)
                    pooled.append(np.maximum(best, 0))
                    winners.append(top)
                hidden = np.concatenate(pooled, axis=1)
                keep = (rng.random(hidden.shape) > 0.2) / 0.8
                logit = (hidden * keep) @ self.weight + self.offset
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) * balance[some] / len(some)
                back = error[:, None] * self.weight * keep * (hidden > 0)
                adam("weight", self.weight, (hidden * keep).T @ error + 1e-4 * self.weight, rate)
                self.offset -= rate * error.sum()
                touched, moved = [], []
                for j, (w, kernel) in enumerate(zip(WIDTHS, self.kernels)):
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    change = np.zeros_like(kernel)
                    for k in range(w):
                        at = winners[j] + k
                        x = vectors[at]  # (texts, FILTERS, SIZE)
                        change[k] = np.einsum("tf,tfs->sf", part, x)
                        touched.append(rows[at].ravel())
                        moved.append((part[:, :, None] * kernel[k].T[None]).reshape(-1, SIZE))
                    adam(f"kernel{j}", kernel, change + 1e-5 * kernel, rate)
                    adam(f"bias{j}", self.bias[j], part.sum(axis=0), rate)
                touched, moved = np.concatenate(touched), np.concatenate(moved)
                own, at = np.unique(touched, return_inverse=True)
                gradient = np.zeros((len(own), SIZE), np.float32)
                np.add.at(gradient, at, moved)
                gradient[own == 0] = 0
                adam("embedding", self.embedding, gradient, 2 * rate, own)

    def tables(self) -> list[list[np.ndarray]]:
        """Every filter's part for each table row, by width and place in the window."""
        return [[self.embedding @ kernel[k] for k in range(len(kernel))] for kernel in self.kernels]


class Scorer:
    def __init__(self, network: Network, tables: list[list[np.ndarray]]):
        self.network, self.tables = network, tables

    def logits(self, rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """One logit for each text; windows may reach past a text's end, into padding."""
        count = np.diff(edge)
        pad = max(WIDTHS)
        # words with padding after each text
        place = np.arange(len(rows)) + np.repeat(np.arange(len(count)) * pad, count)
        padded = np.zeros(len(rows) + pad * len(count), np.int64)
        padded[place] = rows
        begin = edge[:-1] + np.arange(len(count)) * pad
        parts = []
        for tables, bias in zip(self.tables, self.network.bias):
            n = len(padded) - len(tables) + 1
            answer = tables[0][padded[:n]]
            for k in range(1, len(tables)):
                answer += tables[k][padded[k : k + n]]
                over = begin[1:] - k  # no window into the next text
                answer[over[over < n]] = -np.inf
            parts.append(np.maximum(np.maximum.reduceat(answer, begin) + bias, 0))
        return np.concatenate(parts, axis=1) @ self.network.weight + self.network.offset


@dataclass
class Model:
    network: Network
    filters: Filters
    shift: np.ndarray  # by language, the last for texts without one

    def score(self, data: np.ndarray, offsets: np.ndarray, scorer: Scorer) -> np.ndarray:
        rows, edge = word_rows(data, offsets)
        language, _ = self.filters.decide(data, offsets)
        logit = scorer.logits(rows, edge) - self.shift[language]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _best_shift(logit: np.ndarray, label: np.ndarray) -> float:
    """The threshold of the best F1 score, halfway between the logits around it; 0 with one class only."""
    if not 0 < label.sum() < len(label):
        return 0.0
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    hit = y.sum() - missed
    above = len(y) - np.arange(len(y) + 1)
    gain = 2 * hit / (above + y.sum())
    gain[1:-1][x[1:] == x[:-1]] = -1
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    if k in (0, len(x)):
        return float(x[0] - 1 if k == 0 else x[-1] + 1)
    return float((x[k - 1] + x[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000, rounds: int = 8, seed: int = 10) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, toxic: 0 or 1).

    Learns from at most about ``most`` texts, chosen by the digest of their number: the bound of the sample, which
    is what the driver holds. Rows without a label are left out; a document with several labels counts once for each.
    A quarter of the sample calibrates the thresholds. Without any label every score is 0.5 before rounding effects.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    joined = docs.select("doc_id", utf8("text").alias("text")).join(known, "doc_id")
    total = known.count()
    share = min(1.0, most / max(total, 1))
    drawn = joined.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = [(r["doc_id"], bytes(r["text"]), r["toxic"]) for r in drawn.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[2]))
    filters = learn_languages(docs)
    rng = np.random.default_rng(seed)
    network = Network.start(rng)
    shift = np.zeros(len(filters.languages) + 1)
    if not rows:
        network.weight[:] = 0
        return Model(network, filters, shift)
    label = np.array([r[2] for r in rows], np.float64)
    texts = [word_rows(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for _, t, _ in rows]
    tuning = np.arange(len(rows)) % 4 == 3
    network.train([t for t, c in zip(texts, tuning) if not c], label[~tuning], rng, rounds)
    scorer = Scorer(network, network.tables())
    logit = np.concatenate([scorer.logits(t, np.array([0, len(t)])) for t in texts])
    language = np.array([filters.decide(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][0] for _, t, _ in rows])
    overall = _best_shift(logit[tuning], label[tuning])
    shift[:] = overall
    for k in range(-1, len(filters.languages)):
        own = tuning & (language == k)
        if label[own].sum() >= 20 and (1 - label[own]).sum() >= 20:
            shift[k] = _best_shift(logit[own], label[own])
    return Model(network, filters, shift)


def _scored(keep: tuple[str, ...], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer = Scorer(model.network, model.network.tables())
        for batch in batches:
            data, offsets = binary_values(batch.column("__utf8"))
            scores = [model.score(data, offsets[a : b + 1], scorer) for a, b in steps(offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*keep, "score"],
            )

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 from 0.5 on) for every row of ``docs``; only the whole text decides.

    Null and empty texts are scored like a text of padding. Repeated rows get the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, utf8("text").alias("__utf8"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_scored(keep, shared)), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
