"""Rows as bins of their features, and rows that are alike as one.

Trees see only a feature's bin. Rows of a model with the same label and bins are one row with the digests of all, so that
draws by digest stay those of the single rows. Equal rows lie side by side after a range partitioning, which cuts even a
group of millions into ranges; they are put together batch by batch, so nothing grows with the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise
from .perceptron import by_model

#: Bins of a feature; features with more values are cut at quantiles of the training rows.
BINS = 256
#: Rows of a task: as many at least, if there are cores to spare, and at most.
LEAST_TASK, MOST_TASK = 2_000, 250_000

Batches = Iterator[pa.RecordBatch]
Edges = Mapping[int, Sequence[np.ndarray]]


def _few_values(most: int):
    """The different values of each feature in a task's rows; NULL for a feature that has more than ``most``."""

    def run(batches: Batches) -> Batches:
        found: dict[tuple[int, int], np.ndarray | None] = {}
        for batch in batches:
            for model, _, x in by_model(batch):
                for feature in range(x.shape[1]):
                    have = found.get((model, feature), np.zeros(0))
                    if have is not None:
                        values = np.unique(np.append(have, x[:, feature]))
                        found[model, feature] = values if len(values) <= most else None
        columns = [pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.list_(pa.float64()))], ["model", "feature", "values"])

    return run


def bin_edges(rows: DataFrame, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """{model: [bin edges of each feature]}: all values of a feature that has few, else quantiles.

    Tasks tell which features have few values, without a row for each cell; only the others are cut at quantiles.
    """
    most = bins // 2
    listed = rows.select("model", "features").mapInArrow(_few_values(most), "model int, feature int, values array<double>")
    together = F.array_distinct(F.flatten(F.collect_list("values")))  # without the missing lists
    merged = listed.groupBy("model", "feature").agg(F.bool_or(F.col("values").isNull()).alias("many"), together.alias("all"))
    few = merged.select("model", "feature", F.when(~F.col("many") & (F.size("all") <= most), F.col("all")).alias("all")).collect()
    wide = sorted({r["feature"] for r in few if r["all"] is None})
    cuts = {}
    if wide:
        some = rows.where(F.col("model").isin(sorted({r["model"] for r in few if r["all"] is None})))
        cells = [F.get("features", F.lit(f)) for f in wide]
        shares = [i / bins for i in range(1, bins)]
        steps = some.groupBy("model").agg(*[F.array_append(F.percentile_approx(c, shares, 10 * bins), F.max(c)).alias(f"f{f}") for f, c in zip(wide, cells)])
        cuts = {(r["model"], f): r[f"f{f}"] for r in steps.collect() for f in wide}
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(few, key=lambda r: (r["model"], r["feature"])):
        values = np.unique(cuts[r["model"], r["feature"]] if r["all"] is None else r["all"])
        out.setdefault(r["model"], []).append(values[:-1])  # values up to edge i are in bin i
    return out


def bins_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]) if edges else np.zeros((len(x), 1), np.int64)


def uniform(digest: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each digest, another one for each salt."""
    with np.errstate(over="ignore"):
        z = digest.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


def packed(bins: np.ndarray) -> pa.Array:
    """Rows of bins as a binary column, a byte a feature."""
    data = np.ascontiguousarray(bins, np.uint8)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> np.ndarray:
    """The bins of a binary column whose values are equally long."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return flat[offsets[0] : offsets[-1]].reshape(len(column), -1)


def model_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(model, its rows) of each model in a batch."""
    model = batch.column("model").to_numpy()
    order = np.argsort(model, kind="stable")
    cuts = np.flatnonzero(np.diff(model[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(model[rows[0]]), batch if not len(cuts) else batch.take(pa.array(rows))


def digests_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All digests of the rows, and where each row's begin; no row has none."""
    lists = part.column("digests")
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]])


def with_bins(rows: DataFrame, edges: Edges) -> DataFrame:
    """model, label, digest and bins of the rows (model, features, label, digest) whose model has ``edges``."""
    if any(len(e) > BINS - 1 for some in edges.values() for e in some):
        raise ValueError(f"a feature has more than {BINS} bins")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for model, of, x in by_model(batch):
                if model in edges:
                    label, digest = (batch.column(c).take(pa.array(of)) for c in ("label", "digest"))
                    columns = [pa.array(np.full(len(of), model, np.int32)), label, digest, packed(bins_of(x, edges[model]))]
                    yield pa.RecordBatch.from_arrays(columns, ["model", "label", "digest", "bins"])

    rows = rows.select("model", "features", F.col("label").cast("int").alias("label"), "digest")
    return rows.mapInArrow(run, "model int, label int, digest long, bins binary")


def _alike(batches: Batches) -> Batches:
    for batch in batches:
        for model, part in model_parts(batch):
            label, digest, bins = part.column("label").to_numpy(), part.column("digest"), unpacked(part.column("bins"))
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (bins[1:] != bins[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, len(label)).astype(np.int32))
            columns = [pa.array(np.full(len(first), model, np.int32)), pa.array(label[first]), packed(bins[first]), pa.ListArray.from_arrays(offsets, digest)]
            yield pa.RecordBatch.from_arrays(columns, ["model", "label", "bins", "digests"])


def alike_rows(rows: DataFrame, edges: Edges) -> DataFrame:
    """model, label, bins and the digests of alike rows: the rows whose label is 0 or 1, written once."""
    single = materialise(with_bins(rows.where("label in (0, 1)"), edges), "bins")
    n, cores = single.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, n // LEAST_TASK), -(-n // MOST_TASK))
    order = ["model", "label", "bins", "digest"]
    beside = single.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return materialise(beside.mapInArrow(_alike, "model int, label int, bins binary, digests array<long>"), "alike")
