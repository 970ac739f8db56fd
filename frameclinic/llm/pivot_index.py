"""Near-duplicates of embeddings by a pivot-permutation index.

Reference vectors (pivots) describe a vector by the ordered list of its nearest ones. Vectors at a small angle have
nearly the same list, so candidates are those that share at least ``SHARED`` of their ``NEAREST`` pivots. The inverted
lists hold a vector under every combination of ``SHARED`` of its pivots: what meets there shares that many, and the
counting is done by the join. Every pair that meets is verified by its cosine in double precision; a pair that meets
under several combinations counts under the first one only. Large lists are dealt into blocks, and each pair of
blocks is a task of matrix products that sends back counts and one root for each vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import binary_values, broadcast_checked, tidy
from frameclinic.llm.graph import components
from frameclinic.sources.workspace import materialise

#: Pivots, nearest pivots that describe a vector, pivots that candidates share.
PIVOTS, NEAREST, SHARED = 64, 7, 3
#: Pivots of the sample lie at less than this cosine: the order of pivots inside one cluster would be chance.
APART = 0.7
#: Vectors of one block, and of it in one matrix product; bytes of a block's vectors.
BLOCK, PRODUCT, BLOCK_BYTES = 8192, 1024, 16 << 20
#: Bytes of the sample that pivots are chosen from, as doubles.
SAMPLE_BYTES = 32 << 20


def _orders(pivots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each vector's nearest pivots, nearest first; ties by pivot number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :NEAREST]


def _usable(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Unit vectors of the usable rows by dimension: (row numbers, rows)."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in enumerate(batch.column(column)):
        if v.is_valid:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) and np.isfinite(x).all():
                top = np.abs(x).max()
                if top > 0:
                    x = x / top
                    by_size.setdefault(len(x), []).append((i, x / np.sqrt(x @ x)))
    return by_size


def _described(shared, kind: str):
    """Components as they are (``kind``: their NumPy type) and the nearest pivots as a bit set; null if not usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, np.ndarray] = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2_000):
                batch = whole.slice(a, 2_000)
                raw: list[bytes | None] = [None] * batch.num_rows
                near: list[int | None] = [None] * batch.num_rows
                for size, rows in _usable(batch, "embedding").items():
                    bits = np.uint64(1) << _orders(pivots[size], np.stack([x for _, x in rows])).astype(np.uint64)
                    for (i, _), m in zip(rows, np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()):
                        raw[i], near[i] = batch.column("embedding")[i].values.to_numpy().astype(kind).tobytes(), m
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(near, pa.int64())], names=["vec_id", "raw", "near"]
                )

    return run


def _lists(kind: str):
    """A class under every combination of its pivots, as one number: the dimension, then the pivots in ascending order."""
    some = np.array(list(combinations(range(NEAREST), SHARED)))
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = batch.column("near").to_numpy().view(np.uint64)
            has = (mask[:, None] >> np.arange(PIVOTS, dtype=np.uint64)) & np.uint64(1) == 1
            pivots = np.nonzero(has)[1].reshape(-1, NEAREST)[:, some]  # ascending
            keys = np.diff(binary_values(batch.column("raw"))[1])[:, None] // width
            for k in range(SHARED):
                keys = keys << 8 | pivots[:, :, k]
            ids = np.repeat(batch.column("id").to_numpy(), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(ids)], names=["key", "id"])

    return run


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j): the least member of each joined set."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (low := root[root]).tobytes() != root.tobytes():
            root = low


def _verified(least: float, kind: str):
    """Rows of pairs of blocks sorted together -> for each class in it that has links their number, and a root.

    A pair is counted where its first SHARED common pivots are the list's own. Roots join the linked classes of a task.
    """

    def judge(key: int, within: bool, left, right, raw: bytes, mask, copies, ids) -> pa.RecordBatch | None:
        unit = np.frombuffer(raw, kind).reshape(len(ids), -1).astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt(np.einsum("nd,nd->n", unit, unit))[:, None]
        own = [key >> 8 * k & 255 for k in range(SHARED)]
        bits = np.uint64(sum(1 << x for x in own))
        upto = np.uint64((2 << max(own)) - 1)
        mask = mask & upto
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(left), PRODUCT):
            some = left[a : a + PRODUCT]
            good = (unit[some] @ unit[right].T >= least) & (mask[some, None] & mask[None, right] == bits)
            if within:
                good &= some[:, None] < right[None, :]
            i, j = np.nonzero(good)
            i, j = some[i], right[j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            root = _joined(root, i, j)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _and_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            names = [held.column(c).to_numpy() for c in ("key", "p", "q")]
            new = np.any([x[1:] != x[:-1] for x in names], axis=0)
            edge = np.concatenate([[0], np.flatnonzero(new) + 1, [held.num_rows]])
            ends = edge if batch is None else edge[:-1]
            key, p, q = names
            block, near, copies, ids = (held.column(c).to_numpy() for c in ("block", "near", "copies", "id"))
            near = near.view(np.uint64)
            data, at = binary_values(held.column("raw"))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a > 1:
                    left, right = (np.flatnonzero(block[a:b] == side[a]) for side in (p, q))
                    raw = data[at[a] : at[b]].tobytes()
                    found = judge(int(key[a]), p[a] == q[a], left, right, raw, near[a:b], copies[a:b], ids[a:b])
                    if found is not None:
                        yield found
            held = held.slice(int(ends[-1]))

    return run


def _and_end(batches):
    yield from batches
    yield None


def choose_pivots(vectors: DataFrame, sample: int = 20_000) -> dict[int, np.ndarray]:
    """For each dimension PIVOTS far-apart unit vectors out of about ``sample`` rows, chosen by the digest of their number.

    Of very long vectors only as many are drawn as SAMPLE_BYTES hold.
    Takes the vector farthest from those taken so far, again and again, while one lies APART; random directions fill up.
    """
    total, widest = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    sample = min(sample, SAMPLE_BYTES // (8 * max(widest or 0, 1)))
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(total, 1)))
    sizes = {r["n"] for r in vectors.select(F.size("embedding").alias("n")).where("embedding is not null").distinct().collect()}
    drawn: dict[int, list] = {n: [] for n in sizes if n > 0}
    batch = pa.RecordBatch.from_pylist(
        [{"v": r["embedding"]} for r in rows.orderBy("vec_id", "embedding").select("embedding").collect()],
        schema=pa.schema([("v", pa.list_(pa.float64()))]),
    )
    for n, found in _usable(batch, "v").items():
        drawn[n] = [x for _, x in found]
    out = {}
    for n, found in drawn.items():
        rng = np.random.default_rng(n)
        fill = rng.normal(size=(PIVOTS, n))
        pool = np.array(found).reshape(-1, n)
        taken, near = [], np.full(len(pool), -1.0)
        while len(taken) < PIVOTS and near.min(initial=np.inf) < APART:
            taken.append(int(near.argmin()))
            near = np.maximum(near, pool @ pool[taken[-1]])
            near[taken] = np.inf
        fill /= np.linalg.norm(fill, axis=1, keepdims=True)
        out[n] = np.concatenate([pool[taken], fill[: PIVOTS - len(taken)]])
    return out


def similar_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id: long, embedding: array of numbers).

    Rows whose cosine is at least ``least`` are linked if the index finds them; what it finds is verified in double
    precision. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and only
    vectors of one dimension are compared. Equal vectors are one class for the search, and its rows are linked with
    each other. component_id is the least non-null vec_id of the component, the row's own if it has no links;
    null ids count as rows but never name a component. Repeated rows are copies of each other.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind, name = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    shared = vectors.sparkSession.sparkContext.broadcast(choose_pivots(vectors))
    rows = vectors.mapInArrow(tidy(_described(shared, kind)), "vec_id long, raw binary, near long")
    rows = materialise(rows.withColumn("id", F.xxhash64("raw")), "pivot-rows")
    classes = materialise(
        rows.where("raw is not null")
        .groupBy("id")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.any_value("raw").alias("raw"), F.any_value("near").alias("near")),
        "pivot-classes",
    )
    listed = materialise(classes.select("id", "raw", "near").mapInArrow(tidy(_lists(kind)), "key long, id long"), "pivot-lists")
    widest = classes.agg(F.max(F.length("raw"))).first()[0] or 1
    block = max(1, min(BLOCK, BLOCK_BYTES // widest))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = listed.join(sizes, "key").withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id")
    found = (
        met.join(broadcast_checked(classes.select("id", "copies", "raw", "near"), 200 + widest), "id")
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
        .mapInArrow(tidy(_verified(least, kind)), "id long, links long, root long")
    )
    found = materialise(found, "pivot-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), "pivot-components")
    named = classes.select("id", "vec_id", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    component = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = named.join(component, "root").join(links, "id", "left")
    named = named.select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", F.when(F.col("raw").isNotNull(), F.col("id")).alias("id")).join(named, "id", "left")
    out = out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
