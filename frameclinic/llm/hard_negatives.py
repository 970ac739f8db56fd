"""Hard negatives of anchor vectors by lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster the candidates are put in order once, by the largest inner product
that any member of length one could have with them: length times cos(angle to the centre - widest angle of a member).
Every member walks its cluster's list and stops for certain when what the rest could score is below what it still needs:
its current last positive, or for negatives the lower end of the bands that its positives leave open.

Candidates are dealt into blocks of bounded size and anchors into others; each pair of blocks is one task's work, so
every anchor meets every row, no vector passes through the driver, and tasks don't grow with the table. The best of each
block are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameclinic.sources.workspace import materialise

#: Bytes of vectors (8 a component) in a block of candidates and in a block of anchors.
CANDIDATE_BYTES, ANCHOR_BYTES = 32 << 20, 4 << 20
#: Rows from which on candidates are dealt to more tasks, up to twice the cores.
FEW = 1024
#: Clusters of anchors, and the anchors (a bounded sample) whose directions the centres are fitted to.
CLUSTERS, SAMPLE, ROUNDS = 16, 4096, 10
#: Candidates that are scored at a time while a list is walked.
STRIDE = 512
#: Scores are exact up to this size and count as this beyond it.
LIMIT = 1 << 56


def fit_centres(vectors: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """Unit directions by k-means on the sphere, started far from each other; zero vectors play no part."""
    size = np.linalg.norm(vectors, axis=1)
    unit = vectors[size > 0] / size[size > 0, None]
    if len(unit) == 0:
        return np.empty((0, vectors.shape[1]))
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(clusters, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(ROUNDS):
        of = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def whole(vectors: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * x) of every vector, in doubles."""
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        flat = np.floor(np.clip(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale, -top, top))
    return np.split(flat, np.cumsum(pc.list_value_length(vectors).to_numpy())[:-1]) if len(vectors) else []


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows: in doubles where these hold them, else in Python's integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in b.tolist()]
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(a.tolist()):
        own = [int(x) for x in row]
        for j, other in enumerate(exact):
            out[i, j] = max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(own, other))))
    return out


def shared_list(members: np.ndarray, centre: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a cluster's list, and the bound of each entry for a member of length one."""
    length = np.linalg.norm(rows, axis=1)
    bound = length.copy()
    if centre is not None:
        def angle(x: np.ndarray) -> np.ndarray:
            size = np.linalg.norm(x, axis=1)
            return np.arccos(np.clip(x @ centre / np.where(size > 0, size, 1), -1, 1))

        moving = np.linalg.norm(members, axis=1) > 0
        widest = angle(members[moving]).max() if moving.any() else 0.0
        bound = length * np.cos(np.maximum(0.0, angle(rows) - widest))
    bound = bound + 1e-6 * length  # what the angles may be off
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The first ``most`` (score descending, number ascending) of every slot, and what a new one must reach."""

    def __init__(self, slots: int, most: int, least: np.ndarray):
        self.most, self.need = most, least.copy()
        self.slot = self.score = self.number = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        if len(slot) == 0:
            return
        slot, score, number = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.number, number)))
        order = np.lexsort((number, -score, slot))
        slot, score, number = slot[order], score[order], number[order]
        heads = np.flatnonzero(np.r_[True, np.diff(slot) != 0])
        place = np.arange(len(slot)) - np.repeat(heads, np.diff(np.r_[heads, len(slot)]))
        keep = place < self.most
        full = place == self.most - 1
        self.need[slot[full]] = np.maximum(self.need[slot[full]], score[full])
        self.slot, self.score, self.number = slot[keep], score[keep], number[keep]


def _walk(members, numbers, labels, centre, rows, row_numbers, row_labels, best: Best, offer: Callable) -> None:
    """All members walk one list; ``best.need`` has a row of slots for each member."""
    order, bound = shared_list(members, centre, rows)
    length = np.linalg.norm(members, axis=1)
    slots = best.need.reshape(len(members), -1)
    for begin in range(0, len(order), STRIDE):
        # a member goes on while the rest of the list may reach what one of its slots needs
        on = np.flatnonzero(length * bound[begin] + 1 >= slots.min(axis=1))
        if len(on) == 0:
            return
        at = order[begin : begin + STRIDE]
        score = products(members[on], rows[at])
        same = labels[on][:, None] == row_labels[at][None, :]
        other = numbers[on][:, None] != row_numbers[at][None, :]
        offer(best, on, score, same, other, row_numbers[at])


def _pairs_of_blocks(centres: np.ndarray | None, scale: float, search: Callable, schema: pa.Schema) -> Callable:
    """The work on one block of anchors and one of candidates; ``search`` finds and reports a cluster's best."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        vectors = whole(candidates["vector"].combine_chunks(), scale) if len(candidates) else []
        own = whole(anchors["vector"].combine_chunks(), scale) if len(anchors) else []
        size, own_size = np.array([len(v) for v in vectors]), np.array([len(v) for v in own])
        for d in np.intersect1d(size, own_size):  # vectors of other lengths have no inner product
            rows, mine = np.flatnonzero(size == d), np.flatnonzero(own_size == d)
            block, units = np.array([vectors[i] for i in rows]).reshape(len(rows), d), np.array([own[i] for i in mine]).reshape(len(mine), d)
            fits = centres is not None and centres.shape[1] == d and len(centres)
            of = np.argmax(units @ centres.T, axis=1) if fits else np.zeros(len(mine), np.int64)
            number, label = (candidates[c].to_numpy()[rows] for c in ("number", "label"))
            for c in np.unique(of):
                some = np.flatnonzero(of == c)
                part = anchors.take(pa.array(mine[some]))
                found.append(search(part, units[some], centres[c] if fits else None, block, number, label))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


_NONE = -(2**62)
_POSITIVE = pa.schema([("number", pa.int64()), ("twin", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("number", pa.int64()), ("twin", pa.int64()), ("nth", pa.int64()), ("negative", pa.int64()), ("score", pa.int64())])


def _positives(most: int):
    def offer(best, on, score, same, other, numbers):
        i, j = np.nonzero(same & other & (score >= best.need[on][:, None]))
        best.add(on[i], score[i, j], numbers[j])

    def search(part, units, centre, rows, number, label):
        best = Best(len(part), most, np.full(len(part), _NONE))
        _walk(units, part["number"].to_numpy(), part["label"].to_numpy(), centre, rows, number, label, best, offer)
        slot = pa.array(best.slot)
        return pa.Table.from_arrays([part["number"].take(slot), part["twin"].take(slot), pa.array(best.number), pa.array(best.score)], schema=_POSITIVE)

    return search


def _negatives(most: int, low: int, high: int, positives: int):
    def search(part, units, centre, rows, number, label):
        scores = part["scores"].combine_chunks()
        size = pc.list_value_length(scores).to_numpy()
        p = np.full((len(part), positives), -1, np.int64)  # a negative positive has no band
        p[np.repeat(np.arange(len(part)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = scores.flatten().to_numpy()
        least = np.where(p >= 0, -(-low * p // 100), 2**62)

        def offer(best, on, score, same, other, numbers):
            need = best.need.reshape(p.shape)
            for k in range(positives):
                i, j = np.nonzero(~same & other & (score >= need[on, k][:, None]) & (100 * score <= high * p[on, k][:, None]))
                best.add(on[i] * positives + k, score[i, j], numbers[j])

        best = Best(p.size, most, least.ravel())
        _walk(units, part["number"].to_numpy(), part["label"].to_numpy(), centre, rows, number, label, best, offer)
        slot = pa.array(best.slot // positives)
        arrays = [part["number"].take(slot), part["twin"].take(slot), pa.array(best.slot % positives + 1), pa.array(best.number), pa.array(best.score)]
        return pa.Table.from_arrays(arrays, schema=_NEGATIVE)

    return search


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """For each anchor (rows where ``anchor`` holds) and each of its positives the hardest negatives.

    Rows have vec_id, embedding and a label. Components count as floor(scale * x); a row's score is its exact inner
    product with the anchor; higher scores come first, equal ones by smaller vec_id. Positives are an anchor's first
    ``positives`` other rows of its label, hard negatives of a positive the first ``negatives`` rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows without a number, label or vector and those with a null or non-finite component take no part. A vector of
    another length has no score with an anchor. Repeated rows count each; a repeated anchor row is one anchor, and rows of
    an anchor's own number are never its positives or negatives. Scores beyond 2**56 count as 2**56. Other columns play no
    part, whatever their names; an empty table gives an empty table.
    """
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = label if isinstance(label, Column) else F.col(label)
    usable = rows.select(F.col("vec_id").cast("long").alias("number"), named.cast("long").alias("label"), F.col("embedding").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    usable = usable.where("number is not null and label is not null and vector is not null").where(sound)
    anchors = usable.where("is_anchor").select("number", "label", "vector").distinct()
    anchors = materialise(anchors.withColumn("twin", F.xxhash64("label", "vector")), "negatives-anchors")
    size = F.sum(8 * F.size("vector") + 16)
    n, n_bytes = usable.agg(F.count("*"), size).first()
    anchor_bytes = anchors.agg(size).first()[0]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    p = max(1, ceil((n_bytes or 0) / CANDIDATE_BYTES), min(2 * cores, ceil(n / FEW)))
    q = max(1, ceil((anchor_bytes or 0) / ANCHOR_BYTES))
    sample = anchors.orderBy(F.xxhash64("number"), "number", "twin").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    sample = whole(sample, scale)
    usual = max({len(v) for v in sample}, key=lambda d: (sum(len(v) == d for v in sample), d), default=0)
    centres = fit_centres(np.array([v for v in sample if len(v) == usual]).reshape(-1, usual)) if usual else None

    dealt = usable.select("number", "label", "vector", F.pmod(F.monotonically_increasing_id(), F.lit(p)).alias("p"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    candidates = dealt.groupBy("p", "q")

    def blocks(some: DataFrame):
        some = some.withColumn("q", F.pmod(F.xxhash64("number", "twin"), F.lit(q)).cast("int"))
        return some.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long")))).groupBy("p", "q")

    each = Window.partitionBy("number", "twin")
    work = _pairs_of_blocks(centres, scale, _positives(positives), _POSITIVE)
    found = blocks(anchors).cogroup(candidates).applyInArrow(work, "number long, twin long, positive long, score long")
    found = found.withColumn("nth", F.row_number().over(each.orderBy(F.desc("score"), "positive"))).where(F.col("nth") <= positives)
    found = materialise(found, "negatives-positives")
    scores = found.groupBy("number", "twin").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("list"))
    with_scores = anchors.join(scores, ["number", "twin"]).select("number", "twin", "label", "vector", F.col("list.score").alias("scores"))
    work = _pairs_of_blocks(centres, scale, _negatives(negatives, low, high, positives), _NEGATIVE)
    hard = blocks(with_scores).cogroup(candidates).applyInArrow(work, "number long, twin long, nth long, negative long, score long")
    order = Window.partitionBy("number", "twin", "nth").orderBy(F.desc("score"), "negative")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    hard = hard.withColumnRenamed("score", "negative_score").withColumn("nth", F.col("nth").cast("int"))
    return hard.join(found.withColumnRenamed("score", "positive_score"), ["number", "twin", "nth"]).select(
        F.col("number").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score"
    )
