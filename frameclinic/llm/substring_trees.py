"""Passages of words that an earlier document holds too, found in suffix trees that are split by prefix.

A suffix tree of all word suffixes is never built whole. Its suffixes are split by prefixes of variable length into
groups that fit a task's memory, and each group's subtree is built alone. A window of ``words`` words is repeated if
the node of its words, an internal node at that depth or deeper, has leaves in several documents; the least of those
documents keeps it.

Only suffixes that can share such a node are ever written out. Each window has a seed: its ``SEED`` words of least
hash (the leftmost of equal ones). Equal windows have equal seeds, so seeds that one document alone has rule their windows
out before any text moves. Neighbouring windows with one seed travel as one string, whose suffixes of at least ``words``
words are inserted one by one. The seed is the first prefix that strings are dealt by. Where a seed has too many
different strings (the edge of a passage that very many documents share), its strings fall apart into single suffixes,
dealt by longer and longer prefixes of their own; equal suffixes are one row by then, so a group always gets small.
Texts that occur several times are inserted once, under their least document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import RollingHash, binary_values, broadcast_checked, find_words, hash_runs, slices, steps, tidy, utf8
from frameclinic.sources.workspace import materialise

#: Words of a seed; at most the words of a window.
SEED = 4
#: Different strings of one prefix up to which its subtree is built in one go.
GROUP = 20_000
#: Bytes of strings whose subtrees are built side by side.
TOGETHER = 4 << 20
#: Words of one text that are looked at together.
PIECE = 1 << 19
#: The document number that stands for a missing one: later than all others.
LAST = 2**63 - 1
OUTPUTS = ("n_words", "n_removed", "kept_text")

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False
_PLACE = np.uint64((1 << 20) - 1)

Batches = Iterator[pa.RecordBatch]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


class Words:
    """Words of the texts of one step, and the runs of windows that share a seed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes, self.start, self.stop, self.before = find_words(data, offsets, WORD_BYTES, fold=False)

    def runs(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seed, text, and first and last window (by their first word) of every run."""
        code = RollingHash(self.bytes).of(self.start, self.stop)
        found = []
        for begin in range(0, max(1, len(code) - words + 1), PIECE):
            part = code[begin : begin + PIECE + words - 1]
            if len(part) < words:
                continue
            seed = hash_runs(part, SEED)
            marked = (seed & ~_PLACE) | np.arange(len(seed), dtype=np.uint64)
            owner = (_least(marked, words - SEED + 1) & _PLACE).astype(np.int64)
            first = np.arange(begin, begin + len(owner))
            text = np.searchsorted(self.before, first, "right") - 1
            inside = np.flatnonzero(first + words <= self.before[text + 1])  # windows within one text
            if len(inside) == 0:
                continue
            cut = np.flatnonzero((np.diff(inside) != 1) | (np.diff(owner[inside]) != 0)) + 1
            heads, tails = inside[np.r_[0, cut]], inside[np.r_[cut - 1, len(inside) - 1]]
            found.append((seed[owner[heads]].view(np.int64), text[heads], first[heads], first[tails]))
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*found))

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts and stops there."""
        size = self.stop - self.start
        start = np.cumsum(size + 1) - (size + 1)
        at = np.repeat(self.start - start, size + 1) + np.arange(int((size + 1).sum()))
        out = self.bytes[np.minimum(at, max(0, len(self.bytes) - 1))] if len(size) else np.empty(0, np.uint8)
        out[start + size] = 32
        return out, start, start + size


def _text_steps(batch: pa.RecordBatch, name: str):
    data, offsets = binary_values(batch.column(name))
    for begin, end in steps(offsets):
        yield begin, end, Words(data, offsets[begin : end + 1])


def _seeds(words: int):
    """(seed, least and greatest document that has it), once a step."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            for begin, _, found in _text_steps(batch, "text"):
                seed, text, _, _ = found.runs(words)
                if len(seed) == 0:
                    continue
                of = rank[begin + text]
                order = np.argsort(seed)
                heads = np.flatnonzero(np.r_[True, np.diff(seed[order]) != 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seed[order][heads]),
                        pa.array(np.minimum.reduceat(of[order], heads)),
                        pa.array(np.maximum.reduceat(of[order], heads)),
                    ],
                    ["seed", "low", "high"],
                )

    return run


def _places(words: int):
    """(seed, document, first word) of every run of windows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            for begin, _, found in _text_steps(batch, "text"):
                seed, text, head, _ = found.runs(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(rank[begin + text]), pa.array((head - found.before[text]).astype(np.int64))],
                    ["seed", "rank", "at"],
                )

    return run


def _strings(words: int):
    """The strings of the runs that start at the given places."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rank, key = batch.column("rank").to_numpy(), batch.column("key")
            places = batch.column("places")
            wanted, bounds = places.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())])
            for begin, end, found in _text_steps(batch, "text"):
                seed, text, head, tail = found.runs(words)
                mine = wanted[bounds[begin] : bounds[end]] + found.before[np.repeat(np.arange(end - begin), np.diff(bounds[begin : end + 1]))]
                pick = np.isin(head, mine)
                seed, text, head, tail = (x[pick] for x in (seed, text, head, tail))
                data, start, stop = found.spaced()
                if len(head) == 0:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seed),
                        slices(data, start[head], stop[tail + words - 1]).cast(pa.binary()),
                        pa.array(rank[begin + text]),
                        key.take(pa.array(begin + text)),
                        pa.array((head - found.before[text]).astype(np.int64)),
                    ],
                    ["prefix", "string", "rank", "key", "at"],
                )

    return run


def _suffixes(words: int, length: int):
    """Strings fall apart into their suffixes of ``words`` words, dealt by their first ``length`` words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = binary_values(batch.column("string"))
            for begin, end in steps(offsets):
                found = Words(data, offsets[begin : end + 1])
                count = np.diff(found.before) - words + 1
                row = np.repeat(np.arange(end - begin), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = found.before[row] + nth
                prefix = hash_runs(RollingHash(found.bytes).of(found.start, found.stop), length)
                take = pa.array(begin + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix[first].view(np.int64)),
                        slices(found.bytes, found.start[first], found.stop[first + words - 1]).cast(pa.binary()),
                        batch.column("rank").take(take),
                        batch.column("key").take(take),
                        pa.array(batch.column("at").to_numpy()[begin + row] + nth),
                    ],
                    ["prefix", "string", "rank", "key", "at"],
                )

    return run


def subtrees(group: np.ndarray, strings: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtrees of several groups, each as its suffixes in order with the words that neighbours share.

    Suffixes are those of at least ``words`` words, looked at to that depth. Returns, in that order: the string of each
    suffix, its place within the string, and the number of first words it shares with its predecessor in the same group.
    A node of depth d is a run of suffixes whose shared words, the first one's aside, are d or more.
    """
    parts = pc.split_pattern(strings, b" ")
    code = parts.flatten().dictionary_encode().indices.to_numpy()
    before = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())]).astype(np.int64)
    count = np.diff(before) - words + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    table = code[(before[row] + place)[:, None] + np.arange(words)].astype(np.int64)
    own = np.cumsum(np.r_[0, np.diff(group) != 0])[row]
    columns = [own, *(table[:, i] for i in range(words))]
    pairs = [columns[i] << 32 | (columns[i + 1] if i + 1 < len(columns) else 0) for i in range(0, len(columns), 2)]
    order = np.lexsort(pairs[::-1])
    row, place, table, own = row[order], place[order], table[order], own[order]
    equal = (table[1:] == table[:-1]) & (own[1:] == own[:-1])[:, None]
    shared = np.concatenate([[0], np.cumprod(equal, axis=1).sum(axis=1)]).astype(np.int64)
    return row, place, shared


def _first_documents(words: int):
    """For each string whose windows an earlier document may hold: the least document of every window's node."""

    def build(group: np.ndarray, strings: pa.Array, of: pa.Array, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        row, place, shared = subtrees(group, strings, words)
        nodes = np.flatnonzero(shared < words)
        least = np.repeat(np.minimum.reduceat(low[row], nodes), np.diff(np.r_[nodes, len(row)]))
        back = np.lexsort((place, row))
        row, least = row[back], least[back]
        size = np.bincount(row, minlength=len(strings))
        heads = np.cumsum(size) - size
        pick = np.flatnonzero(np.minimum.reduceat(least, heads) < high)
        flat = least[np.isin(row, pick)]
        offsets = np.concatenate([[0], np.cumsum(size[pick])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [of.take(pa.array(pick)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["of", "firsts"]
        )

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def built(most: bool) -> Batches:
            table = pa.Table.from_batches(held).combine_chunks()
            group = table["prefix"].to_numpy()
            end = len(group) if most else int(np.searchsorted(group, group[-1], "left"))  # rows come in order of their group
            if end:
                part = table.slice(0, end).combine_chunks().to_batches()[0]
                column = part.column
                yield build(group[:end], column("string"), column("of"), column("low").to_numpy(), column("high").to_numpy())
            held[:] = table.slice(end).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) > TOGETHER:
                yield from built(False)
        if held:
            yield from built(True)

    return run


def _cut(columns: list[str], words: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            starts = batch.column("__starts")
            flat = starts.flatten().to_numpy()
            size = pc.fill_null(pc.list_value_length(starts), 0).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(size)])
            copies = batch.column("__copy").to_numpy(zero_copy_only=False)
            for begin, end, found in _text_steps(batch, "__text"):
                before, n = found.before, np.diff(found.before)
                row = np.repeat(np.arange(end - begin), size[begin:end])
                at = before[row] + flat[bounds[begin] : bounds[end]]
                edge = np.zeros(len(found.start) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + words, -1)
                gone = np.cumsum(edge[:-1]) > 0
                gone |= np.repeat(copies[begin:end] & (n >= words), n)
                kept = np.concatenate([[0], np.cumsum(~gone)])[before]
                data, start, stop = found.spaced()
                size_of = (stop - start + 1) * ~gone
                left = data[np.repeat(~gone, stop - start + 1)]
                ends = np.concatenate([[0], np.cumsum(size_of)])[before]
                last = np.where(np.diff(kept) > 0, ends[1:] - 1, ends[1:])  # without the space after the last word
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(begin, end - begin) for i in range(len(columns))]
                    + [pa.array(n.astype(np.int64)), pa.array((n - np.diff(kept)).astype(np.int64))]
                    + [slices(left, ends[:-1], last).cast(pa.binary())],
                    [*columns, *OUTPUTS],
                )

    return run


STRINGS = "prefix long, string binary, rank long, key binary, at long"


def _split_crowded(strings: DataFrame, words: int) -> DataFrame:
    """Strings of prefixes with too many different strings, as suffixes under longer prefixes; the others as they are."""
    done, rest = None, strings
    lengths = [n for n in (2 * SEED, words) if n <= words]
    for length in lengths:
        many = rest.groupBy("prefix").count().where(F.col("count") > GROUP).select("prefix")
        many = broadcast_checked(materialise(many, "trees-many"), 16)
        different = rest.join(many, "prefix", "left_semi").select("prefix", "of").distinct()
        crowded = materialise(different.groupBy("prefix").count().where(F.col("count") > GROUP).select("prefix"), "trees-crowded")
        if crowded.isEmpty():
            break
        crowded = broadcast_checked(crowded, 16)
        calm = rest.join(crowded, "prefix", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        apart = rest.join(crowded, "prefix", "left_semi").select("prefix", "string", "rank", "key", "at")
        apart = apart.mapInArrow(tidy(_suffixes(words, length)), STRINGS).withColumn("of", F.unhex(F.md5("string")))
        rest = materialise(apart, "trees-suffixes")
    return rest if done is None else done.unionByName(rest)


def repeated_windows(texts: DataFrame, words: int) -> DataFrame:
    """(key, starts): for each text the first words of its windows that a text of a lower rank holds too.

    ``texts`` has key (binary), rank (long) and text (binary). Texts without such windows have no row.
    """
    seeds = texts.select("rank", "text").mapInArrow(tidy(_seeds(words)), "seed long, low long, high long")
    seeds = seeds.groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    seeds = materialise(seeds.where("low < high").select("seed"), "trees-seeds")
    places = texts.select("rank", "text").mapInArrow(tidy(_places(words)), "seed long, rank long, at long")
    places = places.join(seeds, "seed", "left_semi").groupBy("rank").agg(F.collect_set("at").alias("places"))
    strings = texts.join(places, "rank").select("rank", "key", "text", "places").mapInArrow(tidy(_strings(words)), STRINGS)
    strings = materialise(strings.withColumn("of", F.unhex(F.md5("string"))), "trees-strings")
    strings = _split_crowded(strings, words)
    nodes = strings.groupBy("prefix", "of", "string").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    nodes = nodes.repartition("prefix").sortWithinPartitions("prefix").select("prefix", "string", "of", "low", "high")
    nodes = materialise(nodes.mapInArrow(tidy(_first_documents(words)), "of binary, firsts array<long>"), "trees-nodes")
    starts = F.filter(
        F.transform("firsts", lambda first, i: F.when(first < F.col("rank"), F.col("at") + i)), lambda at: at.isNotNull()
    )
    found = strings.select("of", "rank", "key", "at").join(nodes, "of").select("key", starts.alias("starts")).where("size(starts) > 0")
    return found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_shared_passages(docs: DataFrame, words: int = 13, keep: Sequence[str] = ()) -> DataFrame:
    """Texts without the words of passages that a document with a smaller ``doc_id`` holds too.

    Words are runs of other bytes than space, tab and line ends, unchanged. A word goes if a window of ``words`` words
    of its document covers it whose words also start in a document of a smaller number; windows are judged on the input.
    Returns doc_id, the columns in ``keep``, n_words, n_removed and kept_text (binary; kept words joined by one space).

    A null or empty text has no words. A missing number counts as 2**63 - 1, later than all smaller ones, so documents
    without a number never take words from each other. Documents of one number don't either. Repeated rows each get
    their own row back. A column in ``keep`` that has an output's name gives way to the output; other columns of ``docs``
    play no part, whatever their names. An empty table gives an empty table. Texts of any length are taken whole, in
    pieces of bounded size; ``words`` must be at least ``SEED``.
    """
    if words < SEED:
        raise ValueError(f"words must be at least {SEED}")
    columns = ["doc_id", *(c for c in dict.fromkeys(keep) if c != "doc_id" and c not in OUTPUTS)]
    rows = docs.select(
        *columns,
        utf8("text").alias("__text"),
        F.unhex(F.md5(utf8("text"))).alias("__key"),
        F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("__rank"),
    )
    copies = rows.groupBy("__key").agg(F.min("__rank").alias("__first"), F.count("*").alias("n"))
    copies = broadcast_checked(materialise(copies.where("n > 1").select("__key", "__first"), "trees-copies"), 64)
    rows = rows.join(copies, "__key", "left").withColumn("__copy", F.col("__rank") > F.coalesce("__first", "__rank"))
    inner = [F.col(f"__{c}").alias(c) for c in ("key", "rank", "text")]
    once = rows.where("__rank = __first").select(*inner).groupBy("key").agg(F.first("rank").alias("rank"), F.first("text").alias("text"))
    texts = rows.where("__first is null").select(*inner).unionByName(once)
    found = materialise(repeated_windows(texts, words), "trees-windows")
    found = found.select(F.col("key").alias("__key"), F.col("starts").alias("__starts"))
    none = F.lit(None).cast("array<long>").alias("__starts")
    parts = rows.where("not __copy").join(found, "__key", "left").select(*columns, "__text", "__starts", "__copy")
    parts = parts.unionByName(rows.where("__copy").select(*columns, "__text", none, "__copy"))
    schema = T.StructType(
        [*docs.select(*columns).schema.fields]
        + [T.StructField(c, T.LongType()) for c in OUTPUTS[:2]]
        + [T.StructField("kept_text", T.BinaryType())]
    )
    return parts.mapInArrow(tidy(_cut(columns, words)), schema)
