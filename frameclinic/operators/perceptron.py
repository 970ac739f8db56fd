"""Perceptrons with one hidden layer of rectifiers, trained by Adam, many models in the same jobs.

A step is one pass over a seeded share of the training rows. Each task turns its rows into gradient sums, one vector per
model; where there are many tasks their sums are added up by groups of tasks before the driver sees them. Only
weights and gradients, whose size the layers fix, pass through the driver. A sum does not depend on how rows are split.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published optimiser, and of the study's penalty and stopping rule.
RATE, DECAY1, DECAY2, TINY = 0.001, 0.9, 0.999, 1e-8
PENALTY, TOLERANCE, PATIENCE = 1e-4, 1e-4, 10
#: Rows of a batch, and batches that an epoch has at most: each is a pass over its rows.
BATCH_ROWS, MOST_BATCHES = 200, 4
#: Tasks whose sums the driver adds up itself.
FAN_IN = 64


@dataclass
class Perceptron:
    """Weights of one model, with the state of its optimiser."""

    width: int
    hidden: int
    seed: int
    weights: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        first, last = (np.sqrt(6.0 / (a + b)) for a, b in ((self.width, self.hidden), (self.hidden, 1)))
        self.weights = np.concatenate(
            [rng.uniform(-first, first, self.width * self.hidden + self.hidden), rng.uniform(-last, last, self.hidden + 1)]
        )
        self.steps, self.mean, self.square = 0, np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.best, self.waited = np.inf, 0

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.mean = DECAY1 * self.mean + (1 - DECAY1) * gradient
        self.square = DECAY2 * self.square + (1 - DECAY2) * gradient**2
        rate = RATE * np.sqrt(1 - DECAY2**self.steps) / (1 - DECAY1**self.steps)
        self.weights = self.weights - rate * self.mean / (np.sqrt(self.square) + TINY)

    def settled(self, loss: float) -> bool:
        """After an epoch: has the loss not improved for ``PATIENCE`` epochs?"""
        self.waited = self.waited + 1 if loss > self.best - TOLERANCE else 0
        self.best = min(self.best, loss)
        return self.waited > PATIENCE


def layers(weights: np.ndarray, width: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Hidden weights and offsets, output weights and offset."""
    a, b = width * hidden, width * hidden + hidden
    return weights[:a].reshape(width, hidden), weights[a:b], weights[b:-1], weights[-1]


def decision(x: np.ndarray, weights: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Activations of the hidden layer and the log odds of class 1."""
    w, offset, out, last = layers(weights, x.shape[1], hidden)
    active = np.maximum(x @ w + offset, 0.0)
    return active, active @ out + last


def probability(odds: np.ndarray) -> np.ndarray:
    return np.where(odds >= 0, 1.0, np.exp(np.minimum(odds, 0))) / (1.0 + np.exp(-np.abs(odds)))


def gradient_sum(x: np.ndarray, y: np.ndarray, weights: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Sums over the rows of the log loss and of its gradient; penalties come later."""
    active, odds = decision(x, weights, hidden)
    loss = float(np.sum(np.maximum(odds, 0) - odds * y + np.log1p(np.exp(-np.abs(odds)))))
    error = probability(odds) - y
    back = (error[:, None] * layers(weights, x.shape[1], hidden)[2]) * (active > 0)
    return loss, np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), active.T @ error, [error.sum()]])


def penalised(loss: float, gradient: np.ndarray, n: int, weights: np.ndarray, width: int, hidden: int) -> tuple[float, np.ndarray]:
    """Mean loss and gradient of ``n`` rows with the penalty on all weights but the offsets."""
    held = weights.copy()
    held[width * hidden : width * hidden + hidden] = 0.0
    held[-1] = 0.0
    return (loss + PENALTY / 2 * float(held @ held)) / n, (gradient + PENALTY * held) / n


Batches = Iterator[pa.RecordBatch]


def by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(model, row numbers, features) of each model in a batch; all rows of a model have as many features."""
    model = batch.column("model").to_numpy()
    values, offsets = batch.column("features"), None
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    flat = values.values.to_numpy(zero_copy_only=False)
    order = np.argsort(model, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(model[order])) + 1):
        if len(rows):
            width = offsets[rows[0] + 1] - offsets[rows[0]]
            yield int(model[rows[0]]), rows, flat[offsets[rows][:, None] + np.arange(width)]


_SUMS = "task int, model int, n long, loss double, gradient array<double>"


def _sums(models: Mapping[int, tuple[np.ndarray, int]]):
    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        total: dict[int, list] = {}
        for batch in batches:
            y = batch.column("label").to_numpy().astype(np.float64)
            for model, rows, x in by_model(batch):
                loss, gradient = gradient_sum(x, y[rows], *models[model])
                have = total.setdefault(model, [0, 0.0, np.zeros(len(gradient))])
                total[model] = [have[0] + len(rows), have[1] + loss, have[2] + gradient]
        for model, (n, loss, gradient) in total.items():
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist(
                [{"task": task, "model": model, "n": n, "loss": loss, "gradient": gradient}],
                pa.schema([("task", pa.int32()), ("model", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("gradient", pa.list_(pa.float64()))]),
            )

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums of one model from several tasks as one row."""
    width = len(table["gradient"][0])
    gradient = table["gradient"].combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
    row = {"task": 0, "model": table["model"][0].as_py(), "n": int(table["n"].to_numpy().sum()), "loss": float(table["loss"].to_numpy().sum()), "gradient": gradient}
    return pa.Table.from_pylist([row], table.schema)


def gradients(rows: DataFrame, models: Mapping[int, tuple[np.ndarray, int]], tasks: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """{model: (rows, loss, gradient)} over ``rows`` (model, features, label) of the given models."""
    sums = rows.where(F.col("model").isin(list(models))).select("model", "features", "label").mapInArrow(_sums(models), _SUMS)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("task", (F.col("task") % tasks).cast("int"))
        sums = sums.groupBy("model", "task").applyInArrow(_keep_task, _SUMS)
    out: dict[int, tuple[int, float, np.ndarray]] = {}
    for r in sorted(sums.toArrow().to_pylist(), key=lambda r: (r["model"], r["task"])):
        n, loss, gradient = out.get(r["model"], (0, 0.0, 0.0))
        out[r["model"]] = (n + r["n"], loss + r["loss"], gradient + np.array(r["gradient"]))
    return out


def _keep_task(table: pa.Table) -> pa.Table:
    added = _added(table)
    return added.set_column(0, "task", pa.array([table["task"][0].as_py()], pa.int32()))


def fit_perceptrons(rows: DataFrame, seeds: Mapping[int, int], hidden: int = 100, iterations: int = 2000) -> dict[int, Perceptron]:
    """One trained model for each number in ``seeds`` that has training rows.

    ``rows`` has model, features (array<double>, as long for all rows of a model), label (0 or 1) and digest (long), which
    deals rows to batches. A model has as many batches an epoch as ``BATCH_ROWS`` rows each ask for, ``MOST_BATCHES`` at
    most, and stops when its loss has not fallen by ``TOLERANCE`` for ``PATIENCE`` epochs or after ``iterations`` epochs.
    """
    rows = rows.where("label in (0, 1)").persist()
    try:
        tasks = rows.rdd.getNumPartitions()
        sizes = rows.groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).collect()
        models = {r["model"]: Perceptron(r["width"], hidden, seeds[r["model"]]) for r in sizes if r["model"] in seeds}
        batches = {r["model"]: max(1, min(MOST_BATCHES, r["n"] // BATCH_ROWS)) for r in sizes}
        on = set(models)
        for epoch in range(iterations):
            if not on:
                break
            losses: dict[int, list[tuple[int, float]]] = {m: [] for m in on}
            for batch in range(max(batches[m] for m in on)):
                mine = {m for m in on if batch < batches[m]}
                share = F.lit(False)
                for k in sorted({batches[m] for m in mine}):
                    # another deal each epoch
                    own = F.pmod(F.xxhash64("digest", F.lit(epoch)), F.lit(k)) == batch if k > 1 else F.lit(True)
                    share = share | (F.col("model").isin([m for m in mine if batches[m] == k]) & own)
                found = gradients(rows.where(share), {m: (models[m].weights, hidden) for m in mine}, tasks)
                for m, (n, loss, gradient) in found.items():
                    loss, gradient = penalised(loss, gradient, n, models[m].weights, models[m].width, hidden)
                    losses[m].append((n, loss))
                    models[m].step(gradient)
            on = {m for m in on if losses[m] and not models[m].settled(sum(n * x for n, x in losses[m]) / sum(n for n, _ in losses[m]))}
        return models
    finally:
        rows.unpersist()


def score_perceptrons(rows: DataFrame, models: Mapping[int, Perceptron]) -> DataFrame:
    """``rows`` (model, label, features) as model, label and score, the probability of class 1; NULL without a model."""
    known = {m: (p.weights, p.hidden) for m, p in models.items()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            score, none = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for model, of, x in by_model(batch):
                if model in known:
                    score[of], none[of] = probability(decision(x, *known[model])[1]), False
            yield pa.RecordBatch.from_arrays(
                [batch.column("model"), batch.column("label"), pa.array(score, mask=none)], ["model", "label", "score"]
            )

    return rows.select("model", "label", "features").mapInArrow(run, "model int, label int, score double")
