"""Random forests of many models in the same jobs, grown on binned rows that are alike as one.

As Spark ML's forests: gini, rows drawn with replacement, the root of the number of columns (rounded up) drawn at each
node, sibling leaves of the same class merged, scores averaged over the trees. Draws follow from digests, trees and node
numbers, so they do not depend on how rows are split. Nodes of over ``MOST_ROWS`` rows are split by one grouped
aggregation a level; what is smaller is finished in a task, which gets that node's rows. Grown trees lie in the shared
folder, and pieces of the scored rows meet blocks of trees; only the few upper splits of large models reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import materialise, small_table
from .binned import BINS, Edges, alike_rows, bin_edges, digests_of, model_parts, uniform, unpacked, with_bins

#: Rows of a node, and different rows to score, that a task may hold; larger nodes are split by all tasks.
MOST_ROWS = 1_000_000
#: Trees of a model that a task grows.
TREES_TOGETHER = 10
#: Chance of at most k draws of a row, where each is drawn once on average.
AT_MOST = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))

Batches = Iterator[pa.RecordBatch]
Salts = Mapping[tuple[int, int], tuple[int, int]]


@dataclass
class Histograms:
    """Where the rows per bin and class of some nodes lie: node after node, of each the bins of its drawn columns."""

    nodes: np.ndarray
    sizes: np.ndarray
    salt: int

    def __post_init__(self) -> None:
        width = len(self.sizes)
        k = int(np.ceil(np.sqrt(width)))
        draws = uniform(self.nodes[:, None] * width + np.arange(width), self.salt)
        self.columns = np.sort(np.argsort(draws, axis=1, kind="stable")[:, :k], axis=1)
        lengths = self.sizes[self.columns]
        ends = np.cumsum(lengths.ravel())
        self.begin, self.total = (ends - lengths.ravel()).reshape(lengths.shape), int(ends[-1])

    def add(self, bins: np.ndarray, slot: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rows (class x place) of the given bins, node slots, labels and counts."""
        at = self.begin[slot] + np.take_along_axis(bins, self.columns[slot], axis=1)
        at += (y * self.total)[:, None]
        return np.bincount(at.ravel(), np.repeat(w, at.shape[1]), 2 * self.total).reshape(2, self.total)

    def best(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node, the column (-1 if nothing is won) and the last bin left of the split that wins most."""
        begin, k = self.begin.ravel(), self.begin.shape[1]
        lengths = np.diff(np.append(begin, self.total))
        left = np.cumsum(sums, axis=1)
        left -= np.repeat(left[:, begin] - sums[:, begin], lengths, axis=1)
        last = begin + lengths - 1
        right = np.repeat(left[:, last], lengths, axis=1) - left
        n_left, n_right = left.sum(axis=0), right.sum(axis=0)
        all_ = left[:, last[::k]]
        with np.errstate(divide="ignore", invalid="ignore"):
            impure = left[0] * left[1] / n_left + right[0] * right[1] / n_right
        won = np.repeat(all_[0] * all_[1] / all_.sum(axis=0), lengths.reshape(-1, k).sum(axis=1)) - impure
        won[(n_left == 0) | (n_right == 0)] = 0.0
        most = np.maximum.reduceat(won, begin[::k])
        # the first of equal gains, whatever the order of additions
        found = np.flatnonzero((won > 1e-9) & (won >= np.repeat(most * (1 - 1e-9), lengths.reshape(-1, k).sum(axis=1))))
        of = np.searchsorted(begin[::k], found, "right") - 1
        node, first = np.unique(of, return_index=True)
        place = found[first]
        segment = np.searchsorted(begin, place, "right") - 1
        column, cut = np.full(len(self.nodes), -1), np.zeros(len(self.nodes), np.int64)
        column[node], cut[node] = self.columns.ravel()[segment], place - begin[segment]
        return column, cut


def drawn(digests: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson number for every digest, added up."""
    return np.add.reduceat(np.searchsorted(AT_MOST, uniform(digests, salt), "right"), begin).astype(np.float64)


def depth_of(node: int) -> int:
    return (node + 1).bit_length() - 1


@dataclass
class Subtree:
    """Column (-1: leaf), last bin left, left child (the right one follows) and share of class 1 of each node."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def score(self, bins: np.ndarray) -> np.ndarray:
        node, on = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(on):
            on = on[self.column[node[on]] >= 0]
            at = node[on]
            node[on] = self.left[at] + (bins[on, self.column[at]] > self.cut[at])
        return self.share[node]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: np.ndarray, salt: int, root: int, depth: int) -> Subtree:
    """The subtree of node ``root`` (in heap order) over its rows, level by level; ``w`` is how often a row is drawn."""
    bins, y, w = bins[w > 0], y[w > 0], w[w > 0]
    heap, slot, begin, level = np.array([root], np.int64), np.zeros(len(y), np.int64), [0], depth_of(root)
    parts: list[tuple[np.ndarray, ...]] = []
    while len(heap):
        n = len(heap)
        count = np.bincount(slot + n * y, w, 2 * n).reshape(2, n)
        column, cut, left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        mixed = np.flatnonzero(count.min(axis=0) > 0) if level < depth else np.zeros(0, np.int64)
        if len(mixed):
            place = np.full(n, -1)
            place[mixed] = np.arange(len(mixed))
            on = place[slot] >= 0
            bins, y, w, slot = bins[on], y[on], w[on], slot[on]
            histograms = Histograms(heap[mixed], sizes, salt)
            column[mixed], cut[mixed] = histograms.best(histograms.add(bins, place[slot], y, w))
        split = np.flatnonzero(column >= 0)
        left[split] = begin[-1] + n + 2 * np.arange(len(split))
        on = column[slot] >= 0
        bins, y, w, slot = bins[on], y[on], w[on], slot[on]
        right = bins[np.arange(len(slot)), column[slot]] > cut[slot]
        slot = left[slot] - begin[-1] - n + right
        parts.append((column, cut, left, count[1] / np.maximum(count.sum(axis=0), 1)))
        begin.append(begin[-1] + n)
        heap, level = (2 * heap[split][:, None] + [1, 2]).ravel(), level + 1
    tree = Subtree(*(np.concatenate(c) for c in zip(*parts)))
    for a, b in zip(begin[-2::-1], begin[:0:-1]):  # leaves of the same class are merged upwards
        at = a + np.flatnonzero(tree.column[a:b] >= 0)
        one, other = tree.left[at], tree.left[at] + 1
        same = (tree.column[one] < 0) & (tree.column[other] < 0) & ((tree.share[one] > 0.5) == (tree.share[other] > 0.5))
        tree.column[at[same]] = -1
    return tree


@dataclass
class Top:
    """Upper splits of a tree, by node in heap order, and the share of class 1 of its large nodes."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    shares: dict[int, float] = field(default_factory=dict)

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The first node without an upper split that each row comes to."""
        node = np.zeros(len(bins), np.int64)
        for n in sorted(self.splits):
            column, cut = self.splits[n]
            at = np.flatnonzero(node == n)
            node[at] = 2 * n + 1 + (bins[at, column] > cut)
        return node


def _upper_sums(tops: Mapping[tuple[int, int], Top], wanted: Mapping[tuple[int, int], list[int]], sizes: Mapping[int, np.ndarray], salts: Salts):
    """Rows by (model, tree, place in the histograms of its open nodes) and class, added up within the task."""

    def run(batches: Batches) -> Batches:
        total: dict[tuple[int, int], np.ndarray] = {}
        layouts = {k: Histograms(np.array(nodes), sizes[k[0]], salts[k][1]) for k, nodes in wanted.items()}
        for batch in batches:
            for model, part in model_parts(batch):
                bins, y, (digests, begin) = unpacked(part.column("bins")), part.column("label").to_numpy(), digests_of(part)
                for key in (k for k in layouts if k[0] == model):
                    node, nodes = tops[key].reached(bins), layouts[key].nodes
                    w = drawn(digests, begin, salts[key][0])
                    slot = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                    on = (nodes[slot] == node) & (w > 0)
                    sums = layouts[key].add(bins[on], slot[on], y[on].astype(np.int64), w[on])
                    total[key] = total[key] + sums if key in total else sums
        for (model, tree), sums in total.items():
            place = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
            same = [pa.array(np.full(len(place), v, np.int32)) for v in (model, tree)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(place), *(pa.array(s[place]) for s in sums)], ["model", "tree", "place", "n0", "n1"])

    return run


def _upper_splits(kinds: DataFrame, large: Mapping[int, int], trees: int, sizes: Mapping[int, np.ndarray], salts: Salts, depth: int) -> dict[tuple[int, int], Top]:
    """The splits of all nodes with over ``MOST_ROWS`` drawn rows in trees of the ``large`` models."""
    tops = {(m, t): Top() for m in large for t in range(trees)}
    wanted, level = {k: [0] for k in tops}, 0
    rows = kinds.where(F.col("model").isin(list(large)))
    while wanted and level < depth:
        found = rows.mapInArrow(_upper_sums(tops, wanted, sizes, salts), "model int, tree int, place int, n0 double, n1 double")
        cells = found.groupBy("model", "tree", "place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        model, tree, place, n0, n1 = (cells[c].to_numpy() for c in ("model", "tree", "place", "n0", "n1"))
        next_: dict[tuple[int, int], list[int]] = {}
        for key, nodes in wanted.items():
            layout = Histograms(np.array(nodes), sizes[key[0]], salts[key][1])
            mine = (model == key[0]) & (tree == key[1])
            sums = np.zeros((2, layout.total))
            sums[0, place[mine]], sums[1, place[mine]] = n0[mine], n1[mine]
            for i, (n, column, cut) in enumerate(zip(nodes, *layout.best(sums))):
                a, b = layout.begin[i, 0], layout.begin[i, 0] + sizes[key[0]][layout.columns[i, 0]]
                own = sums[:, a:b].sum(axis=1)
                tops[key].shares[n] = own[1] / max(own.sum(), 1.0)
                if column >= 0:
                    tops[key].splits[n] = (int(column), int(cut))
                    at = layout.begin[i, list(layout.columns[i]).index(column)]
                    left = sums[:, at : at + cut + 1].sum(axis=1)
                    for child, rows_ in ((2 * n + 1, left), (2 * n + 2, own - left)):
                        if rows_.sum() > MOST_ROWS:
                            tops[key].shares[child] = rows_[1] / rows_.sum()
                            if rows_.min() > 0:
                                next_.setdefault(key, []).append(child)
        wanted, level = next_, level + 1
    return tops


def _dealt(tops: Mapping[tuple[int, int], Top], models: Sequence[int], trees: int, left_out: bool):
    """A function that sends rows to the trees that need them: once for each block of trees, or for each tree that is cut above.

    With ``left_out``, rows in large leaves go nowhere: these have their share already.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for model, part in model_parts(batch):
                if model not in models:
                    continue
                bins = unpacked(part.column("bins"))
                single = (model, 0) in tops
                for first in range(0, trees, 1 if single else TREES_TOGETHER):
                    root = tops[model, first].reached(bins) if single else np.zeros(len(bins), np.int64)
                    done = [n for n in tops[model, first].shares if n not in tops[model, first].splits] if single and left_out else []
                    on = np.flatnonzero(~np.isin(root, done))
                    some = part.take(pa.array(on)).append_column("first", pa.array(np.full(len(on), first, np.int32)))
                    yield some.append_column("root", pa.array(root[on]))

    return run


_TREES = "model int, tree int, first int, root long, column array<int>, cut array<int>, left array<int>, share array<double>"


def _grower(sizes: Mapping[int, np.ndarray], salts: Salts, cut_above: Sequence[int], trees: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.combine_chunks().to_batches()[0]
        model, first, root = (part.column(c)[0].as_py() for c in ("model", "first", "root"))
        bins, y, (digests, begin) = unpacked(part.column("bins")), part.column("label").to_numpy().astype(np.int64), digests_of(part)
        out = []
        for tree in range(first, min(trees, first + (1 if model in cut_above else TREES_TOGETHER))):
            own = grow(bins, y, drawn(digests, begin, salts[model, tree][0]), sizes[model], salts[model, tree][1], root, depth)
            out.append((model, tree, first, root, own.column, own.cut, own.left, own.share))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["model", "tree", "first", "root", "column", "cut", "left", "share"])

    return run


_SCORED = "model int, label int, bins binary, alike long, score double"


def _score(rows: pa.Table, trees: pa.Table) -> pa.Table:
    """The rows with the sum of their scores by the given trees."""
    part = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
    score, bins = np.zeros(rows.num_rows), unpacked(part.column("bins")) if part else None
    for i in range(trees.num_rows if part else 0):
        score += Subtree(*(trees[c][i].values.to_numpy() for c in ("column", "cut", "left", "share"))).score(bins)
    return rows.select(["model", "label", "bins", "alike"]).append_column("score", pa.array(score))


def _merged_above(grown: DataFrame, tops: Mapping[tuple[int, int], Top]) -> list[list]:
    """Trees of one leaf for large nodes that end there; upper splits between leaves of the same class are taken out of ``tops``."""
    if not tops:
        return []
    ends = grown.where(F.col("model").isin([m for m, t in tops if t == 0])).where(F.col("column")[0] < 0).select("model", "tree", "root", F.col("share")[0].alias("share"))
    leaf: dict[tuple[int, int], dict[int, float]] = {k: {n: s for n, s in top.shares.items() if n not in top.splits} for k, top in tops.items()}
    large = [[m, t, t, n, [-1], [0], [0], [s]] for (m, t), some in leaf.items() for n, s in some.items()]
    for r in ends.collect():
        leaf[r["model"], r["tree"]][r["root"]] = r["share"]
    for (m, t), top in tops.items():
        own = leaf[m, t]
        for n in sorted(top.splits, reverse=True):
            one, other = own.get(2 * n + 1), own.get(2 * n + 2)
            if one is not None and other is not None and (one > 0.5) == (other > 0.5):
                del top.splits[n]
                own[n] = top.shares[n]
                large.append([m, t, t, n, [-1], [0], [0], [top.shares[n]]])
    return large


def forest_scores(
    training: DataFrame, rows: DataFrame, seeds: Mapping[int, int], trees: int = 100, depth: int = 30, bins: int = BINS
) -> DataFrame:
    """``rows`` as model, label, score and alike, the number of rows that are scored alike; score is NULL without a forest.

    Both tables have model, features (array<double>), label and digest; forests learn from labels 0 and 1.
    """
    spark = rows.sparkSession
    edges: Edges = {m: e for m, e in bin_edges(training.where("label in (0, 1)"), bins).items() if m in seeds and e}
    sizes = {m: np.array([len(e) + 1 for e in some]) for m, some in edges.items()}
    salts = {(m, t): tuple(int(s) for s in np.random.default_rng([seeds[m], t]).integers(2**62, size=2)) for m in edges for t in range(trees)}
    kinds = alike_rows(training, edges)
    many = kinds.groupBy("model").agg(F.sum(F.size("digests").cast("long")).alias("n")).collect()
    large = {r["model"]: r["n"] for r in many if r["n"] > MOST_ROWS}
    tops = _upper_splits(kinds, large, trees, sizes, salts, depth) if large else {}
    groups = sum(trees * 2 * max(1, r["n"] // MOST_ROWS) if r["model"] in large else -(-trees // TREES_TOGETHER) for r in many)
    tasks = max(1, min(2 * groups, 4096))

    keys, group = "first int, root long", ["model", "first", "root"]
    dealt = kinds.mapInArrow(_dealt(tops, list(edges), trees, True), f"model int, label int, bins binary, digests array<long>, {keys}")
    grown = materialise(dealt.repartition(tasks, *group).groupBy(*group).applyInArrow(_grower(sizes, salts, list(large), trees, depth), _TREES), "forest")
    ends = _merged_above(grown, tops)
    if ends:
        grown = grown.unionByName(small_table(spark, ends, grown.schema))

    alike = materialise(with_bins(rows, edges).groupBy("model", "label", "bins").agg(F.count("*").alias("alike")), "scored")
    sent = alike.mapInArrow(_dealt(tops, list(edges), trees, False), f"model int, label int, bins binary, alike long, {keys}")
    of_model = alike.groupBy("model").agg(F.count("*").alias("n")).collect()
    schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("pieces", T.IntegerType())])
    pieces = F.broadcast(small_table(spark, [[r["model"], 1 + r["n"] // MOST_ROWS] for r in of_model], schema))
    pieced = sent.join(pieces, "model").withColumn("piece", F.pmod(F.xxhash64("bins"), "pieces")).drop("pieces")
    copied = grown.join(pieces, "model").withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1L)"))).drop("pieces")
    left, right = (df.repartition(tasks, *group, "piece").groupBy(*group, "piece") for df in (pieced, copied))
    parts = left.cogroup(right).applyInArrow(_score, _SCORED)
    # twelve digits, as sums of the same shares in another order are ties
    mean = F.round(F.sum("score") / trees, 12).alias("score")
    scored = parts.groupBy("model", "label", "bins", "alike").agg(mean).select("model", "label", "score", "alike")
    without = rows.where(~F.col("model").isin(list(edges))) if edges else rows
    return scored.unionByName(
        without.select("model", F.col("label").cast("int").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(1).cast("long").alias("alike"))
    )
