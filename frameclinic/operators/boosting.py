"""Second-order gradient boosting by histograms, many models in the same jobs.

Every row gets its class-1 gradient and curvature from the trees so far. A level of a tree needs, for each open node,
feature and bin, their sums: one grouped aggregation over all models at once, begun in the tasks and, where these are
few, ended by the driver. Only one child of each split node is
summed; its sibling is the parent less that child. What reaches the driver has a size that models, nodes, features and
bins fix. Rows that are alike in bins and label are one, which counts as many as a round draws of them; they keep their
margins, which are written anew every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise
from .binned import BINS, alike_rows, bin_edges, bins_of, digests_of, model_parts, unpacked
from .binned import uniform as _uniform
from .perceptron import FAN_IN, by_model, probability

#: Penalty on leaf weights, least curvature of a child.
LEAF_PENALTY, LEAST_CURVATURE = 1.0, 1.0
#: Rounds after which margins are written.
KEEP_EVERY = 20

Batches = Iterator[pa.RecordBatch]


@dataclass
class Tree:
    """Splits by node in heap order (children of i are 2i+1, 2i+2): feature, last bin that goes left; leaves have a value."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        node, each = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            split = self.feature[node] >= 0
            right = bins[each, self.feature[node]] > self.cut[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return node


@dataclass
class Booster:
    """The trees of one model and the upper edges of its features' bins."""

    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return bins_of(x, self.edges)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees:
            out += tree.value[tree.leaves(bins)]
        return out


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, last bin left) of a node's histograms (features x bins); gain 0 if nothing is won."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + LEAF_PENALTY) + right_g**2 / (right_h + LEAF_PENALTY) - all_g**2 / (all_h + LEAF_PENALTY)
    bad = (left_h < LEAST_CURVATURE) | (right_h < LEAST_CURVATURE)
    gain[bad] = 0.0
    gain[~np.isin(np.arange(len(g)), columns)] = 0.0
    if gain.size == 0 or gain.max() <= 1e-9:
        return 0.0, -1, 0
    # the first of equal gains, whatever the order in which tasks were added up
    feature, cut = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut)


_CELLS = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])


def _histograms(boosters: Mapping[int, Booster], trees: Mapping[int, Tree], open_nodes: Mapping[int, list[int]], chosen: Mapping[int, int], share: float):
    """Sums of gradient and curvature by (model, open node, feature, bin), added up within the task."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, part in model_parts(batch):
                nodes = open_nodes.get(model)
                if not nodes:
                    continue
                booster, bins = boosters[model], unpacked(part.column("bins"))
                p = probability(part.column("margin").to_numpy() + booster.margin(bins))
                # the same rows of a round whatever the split into tasks
                digests, begin = digests_of(part)
                drawn = np.add.reduceat((_uniform(digests, chosen[model]) < share).astype(np.float64), begin)
                node = trees[model].leaves(bins)
                slot = np.searchsorted(nodes, node)
                on = (drawn > 0) & (slot < len(nodes)) & (np.take(nodes, np.minimum(slot, len(nodes) - 1)) == node)
                slot, bins, g, h = slot[on], bins[on], (drawn * (p - part.column("label").to_numpy()))[on], (drawn * p * (1 - p))[on]
                width = len(booster.edges)
                have = total.setdefault(model, np.zeros((2, len(nodes), width, BINS + 1)))
                flat = (slot[:, None] * width + np.arange(width)) * (BINS + 1) + bins
                for i, w in enumerate((g, h)):
                    have[i] += np.bincount(flat.ravel(), np.repeat(w, width), have[i].size).reshape(have[i].shape)
        for model, (g, h) in total.items():
            slot, feature, at = np.nonzero(h)
            nodes = np.array(open_nodes[model])
            arrays = [np.full(len(slot), model), nodes[slot], feature, at, g[slot, feature, at], h[slot, feature, at]]
            yield pa.RecordBatch.from_arrays([pa.array(a, t.type) for a, t in zip(arrays, _CELLS)], schema=_CELLS)

    return run


def _with_margins(rows: DataFrame, boosters: Mapping[int, Booster]) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for model, part in model_parts(batch):
                margin = part.column("margin").to_numpy() + boosters[model].margin(unpacked(part.column("bins")))
                yield part.set_column(part.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(run, rows.schema)


def fit_boosters(
    rows: DataFrame, seeds: Mapping[int, int], rounds: int = 250, depth: int = 4, step: float = 0.05,
    row_share: float = 0.9, column_share: float = 0.9, bins: int = BINS,
) -> dict[int, Booster]:
    """One boosted model for each number in ``seeds`` that has training rows.

    ``rows`` has model, features (array<double>), label (0 or 1) and digest (long), by which each round draws its share of
    the rows; columns are drawn once a tree. A leaf weighs -G / (H + ``LEAF_PENALTY``) times ``step``.
    """
    boosters = {m: Booster(e) for m, e in bin_edges(rows.where("label in (0, 1)"), bins).items() if m in seeds and e}
    kept = alike_rows(rows, {m: b.edges for m, b in boosters.items()}).withColumn("margin", F.lit(0.0)).persist()
    tasks, done = kept.rdd.getNumPartitions(), 0
    for round_ in range(rounds if boosters else 0):
        trees = {m: Tree(depth) for m in boosters}
        rng = {m: np.random.default_rng([seeds[m], round_]) for m in boosters}
        columns = {m: np.sort(rng[m].permutation(len(b.edges))[: max(1, round(column_share * len(b.edges)))]) for m, b in boosters.items()}
        salt = {m: int(rng[m].integers(2**62)) for m in boosters}
        known: dict[tuple[int, int], np.ndarray] = {}
        wanted = {m: [0] for m in boosters}
        siblings: dict[tuple[int, int], tuple[int, int]] = {}
        since = {m: Booster(b.edges, b.trees[done:]) for m, b in boosters.items()}
        for level in range(depth):
            found = kept.mapInArrow(
                _histograms(since, trees, wanted, salt, row_share), "model int, node int, feature int, bin int, g double, h double"
            )
            if tasks > FAN_IN:
                found = found.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            cells = found.toArrow()
            sums: dict[tuple[int, int], np.ndarray] = {(m, n): np.zeros((2, len(boosters[m].edges), BINS + 1)) for m, some in wanted.items() for n in some}
            model, node, feature, at, g, h = (cells[c].to_numpy() for c in ("model", "node", "feature", "bin", "g", "h"))
            for m, n in sums:
                mine = (model == m) & (node == n)
                np.add.at(sums[m, n], (0, feature[mine], at[mine]), g[mine])
                np.add.at(sums[m, n], (1, feature[mine], at[mine]), h[mine])
            for (m, sibling), (parent, child) in siblings.items():
                sums[m, sibling] = known[m, parent] - sums[m, child]
            known = sums
            wanted, siblings = {}, {}
            for (m, n), (g_, h_) in known.items():
                tree = trees[m]
                tree.value[n] = -step * g_[0].sum() / (h_[0].sum() + LEAF_PENALTY)
                gain, feature_, cut = best_split(g_, h_, columns[m])
                if gain > 0:
                    tree.feature[n], tree.cut[n] = feature_, cut
                    wanted.setdefault(m, []).append(2 * n + 1)
                    siblings[m, 2 * n + 2] = (n, 2 * n + 1)
            if level == depth - 1:  # the last level's leaves need no histograms of their own
                for m, some in wanted.items():
                    for left in some:
                        n = (left - 1) // 2
                        g_, h_ = known[m, n]
                        f, cut = trees[m].feature[n], trees[m].cut[n]
                        lg, lh = g_[f, : cut + 1].sum(), h_[f, : cut + 1].sum()
                        trees[m].value[left] = -step * lg / (lh + LEAF_PENALTY)
                        trees[m].value[left + 1] = -step * (g_[f].sum() - lg) / (h_[f].sum() - lh + LEAF_PENALTY)
                break
            if not wanted:
                break
            wanted = {m: sorted(some) for m, some in wanted.items()}
        for m, tree in trees.items():
            boosters[m].trees.append(tree)
        if (round_ + 1) % KEEP_EVERY == 0 and round_ + 1 < rounds:
            since = {m: Booster(b.edges, b.trees[done:]) for m, b in boosters.items()}
            now = materialise(_with_margins(kept, since), "boosting").persist()
            kept.unpersist()
            kept, done = now, round_ + 1
    kept.unpersist()
    return boosters


def score_boosters(rows: DataFrame, models: Mapping[int, Booster]) -> DataFrame:
    """``rows`` (model, label, features) as model, label and score, the probability of class 1; NULL without a model."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            score, none = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for model, of, x in by_model(batch):
                if model in models:
                    score[of], none[of] = probability(models[model].margin(models[model].binned(x))), False
            yield pa.RecordBatch.from_arrays(
                [batch.column("model"), batch.column("label"), pa.array(score, mask=none)], ["model", "label", "score"]
            )

    return rows.select("model", "label", "features").mapInArrow(run, "model int, label int, score double")
