"""Near-duplicates by MinHash and a multi-index Hamming join.

A document's word shingles give a signature of 64 symbols of 16 bits. Two sets of similarity s differ in a symbol
with probability 1 - s. The signature is cut into 16 chunks of 4 symbols. Signatures that differ in at most 31
symbols have a chunk with at most one differing symbol (16 chunks with two each would need 32), so every chunk is
filed under its four one-error patterns, each naming three of its symbols: all pairs within distance 31 meet under
some key, without exception. A pair of similarity 0.8 exceeds that distance with probability 1e-8.

Pairs that meet are confirmed on their full shingle sets. Identical sets are one class from the start, so copies
cost nothing further. Under a key that few classes share all pairs are confirmed; under a large key each class is
first compared with the least one. Classes that large keys connect but these links leave in several components are
then dealt into blocks; each pair of blocks meets in a task that confirms the pairs within the distance whose
components still differ, and merges as it goes. No link that could change a component is left out, and a large group
never yields its pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameclinic.llm.common import RollingHash, binary_values, broadcast_checked, find_words, mix, steps, tidy, utf8
from frameclinic.llm.graph import components
from frameclinic.sources.workspace import materialise

SYMBOLS, CHUNK = 64, 4
#: Largest signature distance for which the chunks guarantee a meeting.
DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
#: Classes under a key up to which all their pairs are compared at once.
FEW = 12
#: Classes, and bytes of their shingle sets, in one block of the later comparison.
BLOCK, BLOCK_BYTES = 512, 4 << 20

_rng = np.random.Generator(np.random.PCG64(1))
_FACTOR = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
LETTERS = np.ones(256, bool)
LETTERS[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending per text, and the texts' offsets into them.

    A to Z count as a to z; words are separated by space and bytes 9 to 13. A text of fewer than ``size`` words is
    one shingle, one without words has none.
    """
    n = len(offsets) - 1
    data, start, stop, edge = find_words(texts, offsets, LETTERS)
    words = RollingHash(data).of(start, stop)
    count = np.diff(edge)
    long = np.maximum(count - size + 1, 0)
    total = np.where(count >= size, long, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(at[-1], np.uint64)
    # a shingle's place in ``out`` and its first word
    row = np.repeat(np.arange(n), total)
    head = edge[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    full = count[row] >= size
    h = np.zeros(int(full.sum()), np.uint64)
    for k in range(size):
        h += words[head[full] + k] * _PLACE[k]
    out[full] = mix(h)
    for r in np.flatnonzero((count > 0) & (count < size)):
        few = words[edge[r] : edge[r + 1]]
        out[at[r]] = mix(np.array([np.sum(few * _PLACE[: len(few)]) + _PLACE[63 - len(few)]], np.uint64))[0]
    for r in range(n):
        out[at[r] : at[r + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][total > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit symbols: the low bits of the least permuted hash; texts without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        low = hashes.astype(np.uint32)
        moved = np.empty_like(low)
        for i in range(SYMBOLS):
            np.multiply(low, _FACTOR[i], out=moved)
            np.add(moved, _SHIFT[i], out=moved)
            out[some, i] = np.minimum.reduceat(moved, offsets[some]).astype(np.uint16)
    return out


def _sums(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _binary(rows: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _described(size: int):
    """Per text: number of shingles, the 64-bit sum of their hashes that names the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = binary_values(batch.column("text"))
            for a, b in steps(offsets):
                h, at = shingle_sets(texts, offsets[a : b + 1], size)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(_sums(h, at)),
                        _binary(signatures(h, at), np.arange(b - a + 1) * 2 * SYMBOLS),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "sig"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every class under the one-error patterns of its chunks: (chunk, skipped symbol, the three others)."""
    for batch in batches:
        data, offsets = binary_values(batch.column("sig"))
        sig = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint16).reshape(-1, SYMBOLS // CHUNK, CHUNK)
        ids = batch.column("id").to_numpy()
        for skip in range(CHUNK):
            a, b, c = (sig[:, :, j].astype(np.int64) for j in range(CHUNK) if j != skip)
            chunk = np.arange(SYMBOLS // CHUNK, dtype=np.int64)[None, :] * CHUNK + skip
            keys = (chunk << 48) | (a << 32) | (b << 16) | c
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, SYMBOLS // CHUNK))], names=["key", "id"]
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id -> pairs to compare (kind 0) and members of large keys (kind 1: key, id).

    Holds back the rows of the last key until it is complete or known to be large: at most FEW + 1 rows.
    """
    kind = pa.schema([("kind", pa.int8()), ("x", pa.int64()), ("y", pa.int64())])

    def rows(k: int, x, y):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int8)), pa.array(x), pa.array(y)], schema=kind)

    held_k, held_v, large = np.empty(0, np.int64), np.empty(0, np.int64), None  # large: (key, first id) seen so far
    for batch in _and_end(batches):
        if batch is None:
            k, v, ended = held_k, held_v, True
        else:
            k = np.concatenate([held_k, batch.column("key").to_numpy()])
            v = np.concatenate([held_v, batch.column("id").to_numpy()])
            ended = False
        if not len(k):
            continue
        if large is not None:  # rows of a key that is already known to be large
            n = int(np.searchsorted(k, large[0], "right"))
            if n:
                yield rows(0, np.full(n, large[1]), v[:n])
                yield rows(1, k[:n], v[:n])
                k, v = k[n:], v[n:]
            if len(k):
                large = None
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([start, [len(k)]]))
        held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(k) and not ended and size[-1] <= FEW:
            held_k, held_v = k[start[-1] :], v[start[-1] :]
            k, v, start, size = k[: start[-1]], v[: start[-1]], start[:-1], size[:-1]
        elif len(k) and not ended:
            large = (k[start[-1]], v[start[-1]])
        if not len(k):
            continue
        many = np.repeat(size > FEW, size)
        if many.any():
            yield rows(0, np.repeat(v[start], size)[many], v[many])
            yield rows(1, k[many], v[many])
        for d in range(1, FEW):
            i = np.flatnonzero((k[d:] == k[:-d]) & ~many[d:])
            if not len(i):
                break
            yield rows(0, v[i], v[i + d])


def _and_end(batches):
    yield from batches
    yield None


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most DISTANCE symbols."""
    for batch in batches:
        a, b = (
            np.frombuffer(d[o[0] : o[-1]].tobytes(), np.uint16).reshape(-1, SYMBOLS)
            for d, o in (binary_values(batch.column(c)) for c in ("sig_u", "sig_v"))
        )
        near = np.count_nonzero(a != b, axis=1) <= DISTANCE
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("u", "v")], names=["u", "v"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = binary_values(batch.column("text"))
            for a, b in steps(offsets):
                h, at = shingle_sets(texts, offsets[a : b + 1], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_sums(h, at)), _binary(h, at * 8)], names=["id", "hashes"]
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (du, ou), (dv, ov) = (binary_values(batch.column(c)) for c in ("set_u", "set_v"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(d[o[i] : o[i + 1]].tobytes(), np.uint64) for d, o in ((du, ou), (dv, ov)))
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("u", "v")], names=["u", "v"])

    return run


def _blocks(percent: int):
    """Rows of pairs of blocks (cluster, p, q), sorted together -> links that join different components.

    Labels start as the components found so far and are merged with every link, so within a dense group few pairs
    are confirmed and at most one link for each member leaves the task. Pairs with equal labels or distant
    signatures are skipped, all others are confirmed.
    """

    def joined(rows: list[dict]) -> pa.RecordBatch:
        ids = np.array([r["id"] for r in rows], np.int64)
        label = np.array([r["root"] for r in rows], np.int64)
        block = np.array([r["block"] for r in rows])
        sig = np.stack([np.frombuffer(r["sig"], np.uint16) for r in rows])
        sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        right = np.flatnonzero(block == rows[0]["q"])
        us, vs = [], []
        for i in np.flatnonzero(block == rows[0]["p"]).tolist():
            j = right[(label[right] != label[i])]
            if not len(j):
                continue
            apart = np.count_nonzero(sig[j] != sig[i], axis=1)
            j, apart = j[apart <= DISTANCE], apart[apart <= DISTANCE]
            j = j[np.argsort(apart, kind="stable")]
            take = 2
            while len(j):
                some, j = j[:take], j[take:]
                take = 256
                found = np.isin(np.concatenate([sets[x] for x in some]), sets[i], assume_unique=False)
                shared = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                for x in some[100 * shared >= percent * (size[some] + size[i] - shared)].tolist():
                    if label[x] != label[i]:
                        us.append(ids[i])
                        vs.append(ids[x])
                        label[label == label[x]] = label[i]
                j = j[label[j] != label[i]]
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (us, vs)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if pending and (r["cluster"], r["p"], r["q"]) != tuple(pending[0][x] for x in ("cluster", "p", "q")):
                    yield joined(pending)
                    pending = []
                pending.append(r)
        if pending:
            yield joined(pending)

    return run


def _set_table(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the classes in ``ids``, made anew from one text of each."""
    wanted = classes.join(ids, "id").select(F.col("doc_id").alias("wanted"))
    texts = docs.join(broadcast_checked(wanted, 32), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = texts.select(utf8("text").alias("text")).mapInArrow(tidy(_sets(size)), "id long, hashes binary")
    # several rows of one document number, or copies of a text, may come along: one set for each class
    sets = materialise(sets.join(broadcast_checked(ids, 16), "id", "left_semi"), "minhash-sets")
    return sets.groupBy("id").agg(F.any_value("hashes").alias("hashes"))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of class ids that reach the similarity on their full sets."""
    sig = classes.select("id", "sig")
    near = (
        pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u")
        .join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v")
        .mapInArrow(tidy(_near), "u long, v long")
    )
    near = materialise(near, "minhash-near")
    ids = near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct()
    sets = _set_table(ids, classes, docs, size)
    met = near.join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("set_v")), "v").join(
        sets.select(F.col("id").alias("u"), F.col("hashes").alias("set_u")), "u"
    )
    return met.select("u", "v", "set_u", "set_v").mapInArrow(tidy(_confirmed(percent)), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id: long, text: string; others ignored).

    Texts are linked when 100 * shared shingles >= percent * all their shingles, on sets of ``size`` words.
    A null or wordless text has no shingles, is linked with nothing and is its own component. component_id is the
    least non-null doc_id of the component (null if it has none); a document is kept if it carries that id (null
    ids compare as equal). Repeated rows are copies of each other; those that share the kept id are all kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(
        docs.select("doc_id", utf8("text").alias("text")).mapInArrow(
            tidy(_described(size)), "doc_id long, n_shingles long, set_id long, sig binary"
        ),
        "minhash-signatures",
    )
    classes = materialise(
        described.where("n_shingles > 0")
        .groupBy(F.col("set_id").alias("id"))
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig")),
        "minhash-classes",
    )
    met = materialise(
        classes.select("id", "sig")
        .mapInArrow(tidy(_keys), "key long, id long")
        .repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(tidy(_met), "kind byte, x long, y long"),
        "minhash-met",
    )
    pairs = met.where("kind = 0 and x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
    links = materialise(_links(pairs, classes, docs, size, percent), "minhash-links")
    roots = materialise(components(links, "minhash-components"), "minhash-roots")
    # large keys whose classes the links so far leave in more than one component
    large = met.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("id"))
    large = large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = (
        large.groupBy("key")
        .agg(F.min("id").alias("first"), F.min("root").alias("a"), F.max("root").alias("b"))
        .where("a <> b")
        .select("key", "first")
    )
    rest = materialise(large.join(open_keys, "key").select("id", "root", "first"), "minhash-open")
    if not rest.isEmpty():
        # classes that such keys connect form a cluster; every pair of its blocks goes to a task
        cluster = components(rest.select(F.col("id").alias("u"), F.col("first").alias("v")), "minhash-clusters")
        member = rest.select("id", "root").distinct().join(cluster.withColumnRenamed("root", "cluster"), "id")
        member = materialise(member.join(classes.select("id", "n_shingles", "sig"), "id"), "minhash-members")
        blocks = member.groupBy("cluster").agg(
            F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
        )
        member = member.join(blocks, "cluster").join(_set_table(member.select("id"), classes, docs, size), "id")
        member = member.withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        more = (
            member.select(
                "cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                "block", "id", "root", "sig", "hashes",
            )
            .repartition("cluster", "p", "q")
            .sortWithinPartitions("cluster", "p", "q")
            .mapInArrow(tidy(_blocks(percent)), "u long, v long")
        )
        links = materialise(links.unionByName(more), "minhash-links")
        roots = materialise(components(links, "minhash-components"), "minhash-roots")
    named = classes.select("id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("id", "component_id")
    out = described.join(named, (F.col("n_shingles") > 0) & (F.col("set_id") == F.col("id")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
