"""Exact removal of long repeated byte strings with suffix orders built by linear grouping.

A byte goes if some string of ``width`` bytes that covers it also starts anywhere else, in the same text or another.

Suffix orders need the strings that may be equal side by side. Every window of ``width`` bytes holds an anchor: the
slice of ``ANCHOR`` bytes with the least hash among the slices inside it. Equal windows hold equal anchors at equal
places, so it is enough to compare the neighbourhoods (blocks) of equal anchors. Anchors that occur once settle
their windows at once, and so do blocks that occur twice, within a task before anything is shuffled. The blocks that differ, with one of each repeated one, are
split by the place of the window's start into four strips. All windows of a strip share a core, so only strips of
equal core can hold equal windows; the core is one symbol, the bytes left and right of it are one each, and the
strips of a core are ordered by ``suffix_order``: equal windows stand next to each other there. Of cores with very many
strips one of each kind is ordered, in parts, and windows met in several parts are brought together by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import RollingHash, binary_values, broadcast_checked, mix, slices, steps, tidy, utf8
from frameclinic.llm.lyndon import suffix_order
from frameclinic.sources.workspace import materialise

#: Bytes of an anchor; at most the width of the windows.
ANCHOR = 100
#: Strips a block's windows are split into, and strips of one core that are ordered together.
STRIPS, TOGETHER = 4, 1_000
#: Rows of one anchor that are held in memory.
HOLD = 50_000
#: Rows of one anchor within a step from which on its blocks are dealt out one by one.
HOT = 32
#: Rows of anchors: one of many, one of an anchor that is hot in its step, a sign that an anchor is hot elsewhere, a
#: stretch settled before the shuffle; MANY is added where the row stands for several equal blocks.
PLAIN, DEALT, SIGN, DONE, MANY = 0, 1, 2, 3, 4
#: Blocks met more than OFTEN times in a step are remembered by the task (SHOWN of them), so that each is sent once.
OFTEN, SHOWN = 3, 1 << 16


def _window_extreme(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest value of every ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    reach = 1
    while 2 * reach <= width:
        values = pick(values[: len(values) - reach], values[reach:])
        reach *= 2
    return pick(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def anchors(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Places whose hash is the least of some ``slots`` neighbouring ones; ties count all."""
    if len(hashes) < slots:
        return np.empty(0, np.int64)
    low = _window_extreme(hashes, slots, True)
    padded = np.concatenate([np.zeros(slots - 1, low.dtype), low, np.zeros(slots - 1, low.dtype)])
    return np.flatnonzero(_window_extreme(padded, slots, False) == hashes)


def _anchor_rows(width: int):
    slots = width - ANCHOR + 1

    def one(text: np.ndarray):
        """Anchor hash, block hash and place, in pieces of bounded size for very long texts."""
        piece = 1 << 20
        for begin in range(0, len(text) - ANCHOR + 1, piece):
            lead = min(begin, width)
            part = text[begin - lead : begin + piece + 2 * width]
            roll = RollingHash(part)
            at = anchors(roll.every(ANCHOR), slots)
            mine = (at >= lead) & (at < lead + piece)
            at = at[mine]
            left, right = np.maximum(at - slots + 1, 0), np.minimum(at + width, len(part))
            block = roll.of(left, right) ^ ((at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield roll.of(at, at + ANCHOR), block, at - lead + begin

    def many(data: np.ndarray, offsets: np.ndarray):
        """The same for several short texts in one go: slices that cross texts get hash values that never win."""
        roll = RollingHash(data)
        if len(data) < width:
            return
        every = roll.every(ANCHOR)
        starts = np.arange(len(every))
        row = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + ANCHOR <= offsets[row + 1]
        every[~inside] = np.uint64(2**64 - 1)
        low = _window_extreme(every, slots, True)
        window = np.arange(len(low))
        low[window + width > offsets[row[: len(low)] + 1]] = 0  # windows that leave their text win nothing
        padded = np.concatenate([np.zeros(slots - 1, low.dtype), low, np.zeros(slots - 1, low.dtype)])
        at = np.flatnonzero((_window_extreme(padded, slots, False) == every) & inside)
        r = row[at]
        left, right = np.maximum(at - slots + 1, offsets[r]), np.minimum(at + width, offsets[r + 1])
        block = roll.of(left, right) ^ ((at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield every[at], block, at - offsets[r], r

    names = ["anchor", "block", "doc_id", "spot", "kind"]

    def stretches(place: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and stop of what settled anchors cover, overlapping ones as one."""
        start, stop = np.maximum(place - (width - ANCHOR), 0), place + width
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] > stop[:-1])])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(r) - 1]])
        return r[new], start[new], stop[last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = signed = np.empty(0, np.uint64)
        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            ids, marks = batch.column("doc_id"), batch.column("mark").to_numpy().astype(np.int64)
            for a, b in steps(offsets):
                if b - a == 1 and offsets[b] - offsets[a] > 2 << 20:
                    found = ((*x, np.zeros(len(x[2]), np.int64)) for x in one(data[offsets[a] : offsets[b]]))
                else:
                    found = many(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for f, block, place, r in found:
                    pair = mix(f ^ mix(block))
                    each, head, at, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    before = shown[np.minimum(np.searchsorted(shown, each), len(shown) - 1)] == each if len(shown) else times < 0
                    again = (times > 1) | before
                    # a block met twice is settled; one row of it goes on, unless this task has sent one already
                    stays = ~again[at]
                    stays[head[~before]] = True
                    done = np.flatnonzero(again[at])
                    if len(done):
                        own, start, stop = stretches(place[done], r[done])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(mix(start.astype(np.uint64) + mix(pair[done[: len(own)]])).view(np.int64)),
                                pa.array(stop),
                                ids.slice(a, b - a).take(pa.array(own)),
                                pa.array((marks[a + own] << 32) | start),
                                pa.array(np.full(len(own), DONE, np.int8)),
                            ],
                            names=names,
                        )
                        shown = np.union1d(shown if len(shown) < SHOWN else shown[:0], each[times > OFTEN])
                    f, block, place, r, pair, often = f[stays], block[stays], place[stays], r[stays], pair[stays], again[at][stays]
                    each, at, times = np.unique(f, return_inverse=True, return_counts=True)
                    hot = times[at] >= HOT
                    signs = np.setdiff1d(each[times >= HOT], signed)
                    signed = np.union1d(signed if len(signed) < SHOWN else signed[:0], signs)
                    none = np.zeros(len(signs), np.int64)
                    kind = np.where(hot, DEALT, PLAIN) + np.where(often, MANY, 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.where(hot, pair, f), signs]).view(np.int64)),
                            pa.array(np.concatenate([block.view(np.int64), none])),
                            ids.slice(a, b - a).take(pa.array(np.concatenate([r, none]), mask=np.arange(len(r) + len(none)) >= len(r))),
                            pa.array(np.concatenate([(marks[a + r] << 32) | place, none])),
                            pa.array(np.concatenate([kind, none + SIGN]).astype(np.int8)),
                        ],
                        names=names,
                    )

    return run


_FOUND = "settled boolean, doc_id long, spot long, copies int, stop long"


def _sorted_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and block: blocks met twice are settled, the other blocks of repeated anchors are not.

    Stretches settled before the shuffle pass through, with their start as spot and their stop; a row that stands for
    several blocks counts as two.

    For an anchor with open blocks one row of each settled block comes along to be compared with. Rows of an anchor
    that is hot where they come from are dealt out by their block, so none of them waits for the others: they are
    open unless their block is settled, and a sign keeps the anchor's other rows open and shows its settled blocks. Rows of an anchor beyond HOLD
    are judged in parts; blocks met once in a part stay open, whatever the others hold.
    """

    def emit(k, b, ids, s, kind, part: bool):
        n = len(k)
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        new_b = new_k | np.concatenate([[True], b[1:] != b[:-1]])
        row_k, row_b = np.cumsum(new_k) - 1, np.cumsum(new_b) - 1
        size = np.bincount(row_k)
        often, kind = kind >= MANY, kind % MANY
        times = np.where(kind == SIGN, 0, np.bincount(row_b, 1 + often).astype(np.int64)[row_b])
        sure = (kind == DEALT) | part
        opened = (times == 1) & ((size[row_k] > 1) | sure)
        # a sign says that rows of the anchor lie elsewhere, which may hold the settled blocks too
        has_open = np.bincount(row_k[opened | (kind == SIGN)], minlength=len(size)) > 0
        shown = opened | (new_b & (times > 1) & (has_open[row_k] | sure))
        for rows, settled in ((np.flatnonzero(shown), False), (np.flatnonzero(times > 1), True)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), settled)),
                    ids.take(pa.array(rows)),
                    pa.array(s[rows]),
                    pa.array(times[rows].astype(np.int32)),
                    pa.nulls(len(rows), pa.int64()),
                ],
                names=names,
            )

    names = ["settled", "doc_id", "spot", "copies", "stop"]
    held, part_of = None, None
    for batch in _and_end(batches):
        if batch is not None:
            done = pc.equal(batch.column("kind"), DONE)
            ready, batch = batch.filter(done), batch.filter(pc.invert(done))
            if ready.num_rows:
                n = ready.num_rows
                told = [pa.array(np.full(n, True)), ready.column("doc_id"), ready.column("spot"), pa.array(np.full(n, 2, np.int32)), ready.column("block")]
                yield pa.RecordBatch.from_arrays(told, names=names)
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if held is None or not held.num_rows:
            continue
        k, b, s, kind = (held.column(c).to_numpy() for c in ("anchor", "block", "spot", "kind"))
        ids = held.column("doc_id").combine_chunks()
        cut = len(k) if batch is None else int(np.searchsorted(k, k[-1], "left"))
        first = int(np.searchsorted(k[:cut], k[0], "right")) if cut and part_of == k[0] else 0
        for x, y, part in ((0, first, True), (first, cut, False)):
            if y > x:
                yield from emit(k[x:y], b[x:y], ids.slice(x, y - x), s[x:y], kind[x:y], part)
        if len(k) - cut > HOLD:
            part_of = k[cut]
            yield from emit(k[cut:], b[cut:], ids.slice(cut), s[cut:], kind[cut:], True)
            held = None
        else:
            held = held.slice(cut)


def _and_end(batches):
    yield from batches
    yield None


def _strips(width: int):
    """The strips of the open blocks: hash of core, hash of all bytes, the bytes left and right of the core."""
    reach = width - ANCHOR
    edges = [-reach + (reach + 1) * i // STRIPS for i in range(STRIPS + 1)]
    names = ["core", "core_strip", "strip", "doc_id", "mark", "first", "copies", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            places = batch.column("places")
            for x, y in steps(offsets):
                part = data[offsets[x] : offsets[y]]
                roll = RollingHash(part)
                some = places.slice(x, y - x)
                many, flat = some.value_lengths().to_numpy(), some.flatten()
                row = np.repeat(np.arange(x, y), many)
                begin, end = offsets[row] - offsets[x], offsets[row + 1] - offsets[x]
                at = begin + (flat.field("spot").to_numpy() & 0xFFFFFFFF)
                copies = flat.field("copies").to_numpy()
                for i in range(STRIPS):
                    a, b = at + edges[i], at + edges[i + 1] - 1
                    low, high = np.maximum(a, begin), np.minimum(b + width, end)
                    good = np.flatnonzero(np.minimum(b, end - width) >= low)
                    a, b, low, high, own = a[good], b[good], low[good], high[good], row[good]
                    core = roll.of(b, a + width) ^ np.uint64(i)
                    strip = roll.of(low, high) ^ mix((low - a).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(core.view(np.int64)),
                            pa.array(np.full(len(good), i, np.int32)),
                            pa.array(strip.view(np.int64)),
                            batch.column("doc_id").take(pa.array(own)),
                            batch.column("mark").take(pa.array(own)),
                            pa.array(low - begin[good]),
                            pa.array(copies[good]),
                            slices(part, low, b).cast(pa.binary()),
                            slices(part, a + width, high).cast(pa.binary()),
                        ],
                        names=names,
                    )

    return run


def equal_windows(strips: Sequence[tuple[bytes, bytes]], width: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of (strip, offset) whose windows are equal, each window in one run.

    A strip is the bytes left and right of the common core; a window is ``width`` symbols with the core as one.
    """
    symbols: list[int] = []
    owner: list[tuple[int, int]] = []
    for j, (left, right) in enumerate(strips):
        # a separator (0) below all bytes (1 to 256); the core is above them
        symbols += [x + 1 for x in left]
        symbols.append(257)
        symbols += [x + 1 for x in right]
        symbols.append(0)
        last = len(left) + 1 + len(right) - width
        owner += [(j, o if o <= min(last, len(left)) else -1) for o in range(len(left) + len(right) + 2)]
    run: list[int] = []
    for i in suffix_order(symbols):
        if owner[i][1] < 0:
            continue
        if run and symbols[run[-1] : run[-1] + width] != symbols[i : i + width]:
            yield [owner[x] for x in run]
            run = []
        run.append(i)
    if run:
        yield [owner[x] for x in run]


def _ordered(width: int):
    """Strips sorted by core (and part) -> repeated stretches (window null); for cores in parts also their windows."""
    names = ["window", "doc_id", "mark", "start", "stop"]
    kinds_of = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    reach = width - ANCHOR
    symbols = [(reach + 1) * (i + 1) // STRIPS - (reach + 1) * i // STRIPS for i in range(STRIPS)]

    def settle(strips: list[dict], out: list[tuple]) -> None:
        """Orders one strip of each kind; ``often`` ones are settled already and only show what else is repeated."""
        parts = strips[0]["parts"] > 1
        # a window is one symbol for the core and as many bytes as the strip has further starts
        size = symbols[strips[0]["core_strip"]]
        hit = [bytearray(len(r["left"]) + 1) for r in strips]
        for run in equal_windows([(r["left"], r["right"]) for r in strips], size):
            spots = {(strips[j]["doc_id"], strips[j]["mark"], strips[j]["first"] + o) for j, o in run}
            again = len(spots) > 1 or any(strips[j]["often"] for j, _ in run)
            if again:
                for j, o in run:
                    hit[j][o] = 1
            if parts:  # what is repeated here is so for every equal window of other parts
                j, o = run[0]
                r = strips[j]
                window = hashlib.blake2b(
                    r["core"].to_bytes(8, "big", signed=True) + r["left"][o:] + b"|" + r["right"][: size - 1 - len(r["left"]) + o],
                    digest_size=8,
                ).digest()
                at = r["first"] + o
                row = (int.from_bytes(window, "big", signed=True), r["doc_id"], r["mark"], at, at + width)
                out += [row] * (2 if again else 1)
        for r, flags in zip(strips, hit):
            if not r["often"]:
                edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + flags + b"\0", np.int8))).reshape(-1, 2).tolist()
                out += [(None, r["doc_id"], r["mark"], r["first"] + a, r["first"] + b - 1 + width) for a, b in edge]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            core, part, strip = (held.column(c).to_numpy() for c in ("core", "part", "strip"))
            new = np.concatenate([[True], (core[1:] != core[:-1]) | (part[1:] != part[:-1])])
            cut = len(core) if batch is None else int(np.flatnonzero(new)[-1])
            done, held = held.slice(0, cut), held.slice(cut)
            if not cut:
                continue
            # rows of a group (core and part), and the kinds of strips in it
            fresh = new[:cut] | np.concatenate([[True], strip[1:cut] != strip[: cut - 1]])
            head, kind, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1, np.cumsum(new[:cut]) - 1
            copies = done.column("copies").to_numpy()
            often = (np.bincount(kind) > 1) | (copies[head] > 1)
            rows = np.flatnonzero(often[kind] & (copies == 1))
            if len(rows):  # equal strips: every window of theirs is repeated
                some = done.select(["doc_id", "mark", "first", "core_strip", "left", "right"]).take(pa.array(rows))
                left, right = (pc.binary_length(some.column(c)).to_numpy().astype(np.int64) for c in ("left", "right"))
                last = np.minimum(left, left + 1 + right - np.array(symbols)[some.column("core_strip").to_numpy()])
                first = some.column("first").to_numpy()
                whole = [pa.nulls(len(rows), pa.int64()), some.column("doc_id"), some.column("mark"), pa.array(first), pa.array(first + last + width)]
                yield from pa.Table.from_arrays(whole, names=names).to_batches()
            of = group[head]
            parted = done.column("parts").to_numpy()[head] > 1
            wanted = (np.bincount(of)[of] > 1) & (np.bincount(of, ~often)[of] > 0) | parted
            kinds = done.take(pa.array(head[wanted]))
            kinds = kinds.append_column("group", pa.array(of[wanted])).append_column("often", pa.array(often[wanted]))
            strips: list[dict] = []
            for small in kinds.to_batches(max_chunksize=1_000):
                out: list[tuple] = []
                for r in small.to_pylist():
                    if strips and r["group"] != strips[0]["group"]:
                        settle(strips, out)
                        strips = []
                    strips.append(r)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_of)], names=names)
            out = []
            if strips:
                settle(strips, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_of)], names=names)

    return run


def _cut(columns: list[str]):
    """Takes the union of each text's repeated stretches out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_values(batch.column("__text"))
            size, removed, spans, kept = [], [], [], []
            for i, s in enumerate(batch.column("__spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                gone = count = at = 0
                parts = []
                for a, b in sorted((x["start"], min(x["stop"], len(text))) for x in s or ()):
                    if count and a <= at:
                        gone += max(0, b - at)
                        at = max(at, b)
                        continue
                    parts.append(text[at:a])
                    gone += b - a
                    count, at = count + 1, b
                parts.append(text[at:])
                size.append(len(text)), removed.append(gone), spans.append(count), kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(x, pa.int64()) for x in (size, removed, spans)]
                + [pa.array(kept, pa.binary())],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_bytes"],
            )

    return run


def _dealt(strips: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Strips to order, with ``part`` and ``parts``, and the stretches that equal strips of large cores settle.

    A core with more than TOGETHER strips is ordered by one strip of each kind: the windows of equal strips are all
    repeated, and where they lie follows from each strip alone. A part thus holds about TOGETHER strips at most.
    """
    large = strips.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("core")
    large = materialise(large, "suffix-large")
    cores = broadcast_checked(large, 24)
    small = strips.join(cores, "core", "left_anti").withColumn("parts", F.lit(1))
    crowded = strips.join(cores, "core", "left_semi")
    one = F.min(F.struct("doc_id", "mark", "first", "left", "right")).alias("one")
    kinds = crowded.groupBy("core", "core_strip", "strip").agg(one, F.count("*").alias("n"), F.max("copies").alias("copies"))
    kinds = kinds.withColumn("copies", F.when(F.col("n") > 1, F.greatest("copies", F.lit(2))).otherwise(F.col("copies")).cast("int"))
    kinds = materialise(kinds.select("core", "core_strip", "strip", "one.*", "copies"), "suffix-kinds")
    parts = kinds.groupBy("core").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    kinds = kinds.join(broadcast_checked(parts, 32), "core")
    order = ["core", "core_strip", "strip", "doc_id", "mark", "first", "copies", "left", "right", "parts"]
    ordered = small.select(*order).unionByName(kinds.select(*order))
    ordered = ordered.withColumn("part", F.pmod(F.hash("strip"), F.col("parts")))
    repeated = kinds.where("copies > 1").select("core", "strip")
    reach = width - ANCHOR
    size = F.get(F.array(*[F.lit((reach + 1) * (i + 1) // STRIPS - (reach + 1) * i // STRIPS) for i in range(STRIPS)]), "core_strip")
    left, right = F.octet_length("left"), F.octet_length("right")
    last = F.least(left, left + 1 + right - size)
    whole = crowded.where("copies = 1").join(broadcast_checked(repeated, 32), ["core", "strip"], "left_semi")
    return ordered, whole.select("doc_id", "mark", F.col("first").alias("start"), (F.col("first") + last + width).alias("stop"))


def remove_repeats(docs: DataFrame, width: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id: long, text: string) without the bytes that repeated strings cover.

    Returns doc_id, the columns named in ``keep``, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_bytes (what is left, joined). Strings are judged on the input, overlapping ones too; a null text is empty,
    and texts under ``width`` bytes keep everything. Repeated rows are copies: all their bytes go if they are long
    enough. Null document numbers are allowed. ``width`` must be at least ANCHOR.
    """
    if width < ANCHOR:
        raise ValueError(f"width must be at least {ANCHOR}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("__text"), *keep)
    docs = docs.withColumn("__mark", F.hash("__text"))
    read = docs.select("doc_id", F.col("__mark").alias("mark"), F.col("__text").alias("text"))
    found = materialise(
        read.where(F.octet_length("text") >= width).mapInArrow(tidy(_anchor_rows(width)), "anchor long, block long, doc_id long, spot long, kind byte")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "block")
        .mapInArrow(tidy(_sorted_anchors), _FOUND),
        "suffix-anchors",
    )
    found = found.withColumn("mark", F.shiftright("spot", 32).cast("int"))
    place = F.col("spot").bitwiseAND(0xFFFFFFFF)
    settled = found.where("settled").select(
        "doc_id",
        "mark",
        F.when(F.col("stop").isNull(), F.greatest(place - (width - ANCHOR), F.lit(0))).otherwise(place).alias("start"),
        F.coalesce("stop", place + width).alias("stop"),
    )
    opened = found.where("not settled").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("spot", "copies")).alias("places"))
    opened = materialise(opened, "suffix-open")
    opened = opened.select(F.col("doc_id").alias("of"), F.col("mark").alias("its"), "places")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("its"))
    blocks = read.join(opened, same)
    strips = blocks.select("doc_id", "mark", "text", "places").mapInArrow(
        tidy(_strips(width)),
        "core long, core_strip int, strip long, doc_id long, mark int, first long, copies int, left binary, right binary",
    )
    strips = materialise(strips, "suffix-strips")
    dealt, whole = _dealt(strips, width)
    ordered = (
        dealt.repartition("core", "part")
        .sortWithinPartitions("core", "part", "strip")
        .mapInArrow(tidy(_ordered(width)), "window long, doc_id long, mark int, start long, stop long")
    )
    ordered = materialise(ordered, "suffix-ordered")
    spans = ordered.where("window is null").drop("window")
    windows = ordered.where("window is not null")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    late = windows.join(again, "window").where("start is not null").drop("window")
    every = settled.unionByName(whole).unionByName(spans).unionByName(late)
    every = every.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    every = materialise(every.withColumnsRenamed({"doc_id": "__of", "mark": "__its", "spans": "__spans"}), "suffix-spans")
    columns = ["doc_id", *keep]
    same = F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__mark") == F.col("__its"))
    out = docs.join(every, same, "left").select(*columns, "__text", "__spans")
    schema = T.StructType(
        [*docs.select(*columns).schema.fields]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_bytes", T.BinaryType())]
    )
    return out.mapInArrow(tidy(_cut(columns)), schema)
