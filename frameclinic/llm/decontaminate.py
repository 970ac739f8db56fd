"""Benchmark decontamination: an FM-index for each shard of the training texts, searched for the test phrases.

Every batch of documents is a shard. Its words become symbols; words and neighbouring word pairs that no test phrase
has cannot lie in an occurrence, so they only separate the stretches that the index covers. All phrases are searched
at once from their last word to their first, their suffix ranges are turned into positions by sampled suffixes,
and the stretches of one document are merged. The phrases go to every task; test sets beyond ``BLOCK_BYTES`` of text
are taken in blocks of that size, one pass over the documents for each, so what is broadcast has a fixed bound.
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
from frameclinic.llm.fm_index import FMIndex

#: Text of test items that one pass over the documents searches for.
BLOCK_BYTES = 8 << 20
#: Bytes of documents under one index.
SHARD_BYTES = 1 << 20

LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


@dataclass
class Phrases:
    """The windows of the test items as rows of word numbers (2 and up), and which items have them."""

    words: np.ndarray  # hashes, ascending
    rows: np.ndarray
    lengths: np.ndarray
    pairs: np.ndarray  # neighbouring words in any window, ascending
    window_item: np.ndarray  # (window, item) pairs, ascending
    items: list[str]

    @staticmethod
    def of(items: list[tuple[str, bytes]], window: int) -> Phrases:
        names = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(names)}
        texts = [t for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data, start, stop, edge = find_words(np.frombuffer(b"".join(texts), np.uint8), offsets, LETTERS)
        hashes = RollingHash(data).of(start, stop)
        words = np.unique(hashes)
        symbol = np.searchsorted(words, hashes) + 2
        windows: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        for n, (item, _) in enumerate(items):
            own = symbol[edge[n] : edge[n + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                row = tuple(own[i : i + window])
                pairs.add((windows.setdefault(row, len(windows)), number[item]))
        rows = np.zeros((len(windows), window), np.int64)
        for row, w in windows.items():
            rows[w, : len(row)] = row
        lengths = np.array([len(r) for r in windows], np.int64)
        base = len(words) + 2
        both = rows[:, :-1] * base + rows[:, 1:]
        return Phrases(
            words, rows, lengths, np.unique(both[rows[:, 1:] > 0]), np.array(sorted(pairs), np.int64).reshape(-1, 2), names
        )


def _occurrences(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Word starts, stops and text edges of a shard, and its occurrences: first word, number of words, window."""
    data, start, stop, edge = find_words(data, offsets, LETTERS)
    none = np.empty(0, np.int64)
    if not len(start) or not len(phrases.rows):
        return start, stop, edge, none, none, none
    hashes = RollingHash(data).of(start, stop)
    near = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    symbol = np.where(phrases.words[near] == hashes, near + 2, 0)
    opens = np.ones(len(symbol), bool)  # a stretch begins here: another text, or a pair that no window has
    known = np.flatnonzero((symbol[1:] > 0) & (symbol[:-1] > 0))
    pair = symbol[known] * (len(phrases.words) + 2) + symbol[known + 1]
    if len(phrases.pairs):
        slot = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
        opens[known[phrases.pairs[slot] == pair] + 1] = False
    opens[edge[:-1][edge[:-1] < len(opens)]] = True
    head = np.flatnonzero(opens)
    size = np.diff(np.concatenate([head, [len(symbol)]]))
    keep = np.repeat((size >= phrases.lengths.min()) & (symbol[head] > 0), size)
    place = np.flatnonzero(keep)
    if not len(place):
        return start, stop, edge, none, none, none
    # stretches with a separator (1) before each and the unique 0 at the end
    shift = np.cumsum(opens[place])
    text = np.ones(len(place) + int(shift[-1]) + 1, np.int64)
    at = np.arange(len(place)) + shift
    text[at] = symbol[place]
    text[-1] = 0
    back = np.zeros(len(text), np.int64)
    back[at] = place
    index = FMIndex(text)
    low, high = index.search(phrases.rows, phrases.lengths)
    times = high - low
    window = np.repeat(np.arange(len(times)), times)
    spot = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    return start, stop, edge, back[index.locate(spot)], phrases.lengths[window], window


def _search(columns: list[str], shared, clean: bool):
    names = [*columns, "n_words", "n_hit", "hit_words", "hit_bytes", "hit_items"] + ["clean"] * clean
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def runs(mask: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(mask) + 2, np.int8)
        padded[1:-1] = mask
        return np.flatnonzero(np.diff(padded)).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch in batches:
            data, offsets = binary_values(batch.column("__bytes"))
            words_before = batch.column("hit_words").to_pylist()
            items_before = batch.column("hit_items").to_pylist()
            for a, b in steps(offsets, SHARD_BYTES):
                start, stop, edge, first, size, window = _occurrences(data, offsets[a : b + 1], phrases)
                change = np.zeros(len(start) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + size, -1)
                for r in range(a, b):
                    for s in words_before[r] or ():
                        change[edge[r - a] + s["start"]] += 1
                        change[edge[r - a] + s["stop"]] -= 1
                hit = np.cumsum(change)[:-1] > 0
                # (text, item) pairs, each once
                text = np.searchsorted(edge, first, "right") - 1
                from_, to = (np.searchsorted(phrases.window_item[:, 0], window, side) for side in ("left", "right"))
                each = np.repeat(np.arange(len(window)), to - from_)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(to - from_) - (to - from_), to - from_)
                item = phrases.window_item[from_[each] + nth, 1]
                items: dict[int, set[str]] = {}
                for t, i in np.unique(np.stack([text[each], item], 1), axis=0).tolist():
                    items.setdefault(t, set()).add(phrases.items[i])
                count = np.concatenate([[0], np.cumsum(hit)])[edge]
                touched = np.flatnonzero(np.diff(count))
                words, spans = [None] * (b - a), [None] * (b - a)
                for t in touched.tolist():
                    own = runs(hit[edge[t] : edge[t + 1]])
                    words[t] = [{"start": x, "stop": y} for x, y in own.tolist()]
                    begin = int(offsets[a + t] - offsets[a])
                    spans[t] = [
                        {"start": int(start[edge[t] + x]) - begin, "stop": int(stop[edge[t] + y - 1]) - begin}
                        for x, y in own.tolist()
                    ]
                texts = []
                for t in range(b - a) if clean else ():
                    text, at, parts = data[offsets[a + t] : offsets[a + t + 1]].tobytes(), 0, []
                    for x in spans[t] or ():
                        parts.append(text[at : x["start"]])
                        at = x["stop"]
                    texts.append(b"".join([*parts, text[at:]]))
                listed = [sorted(items.get(t, set()) | set(items_before[a + t] or ())) for t in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in columns]
                    + [
                        pa.array(np.diff(edge), pa.int64()), pa.array(np.diff(count), pa.int64()), pa.array(words, span),
                        pa.array(spans, span), pa.array(listed, pa.list_(pa.string())),
                    ]
                    + [pa.array(texts, pa.binary())] * clean,
                    names=names,
                )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """Where the texts of ``docs`` (doc_id, text) repeat ``window`` consecutive words of ``benchmark`` (item_id, text).

    Returns, for each row, doc_id, the columns in ``keep``, n_words, n_hit (words inside any occurrence), hit_words
    and hit_bytes (merged stretches as word numbers and as byte offsets; null if none) and hit_items (item numbers as
    strings, ascending); with ``clean`` also the bytes of the text without those stretches. Words are runs of digits, letters and non-ASCII characters, A to Z lower-cased. An item of
    fewer words is one window, one without words or a null text has none; a null item number counts as "". Rows with
    the same item number are one item. Null texts have no words. Repeated documents are judged one by one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8("text").alias("utf8"))
    total = items.agg(F.sum(F.octet_length("utf8"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    columns = ["doc_id", *keep]
    fields = {f.name: f for f in docs.select(*columns).schema.fields}
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    new = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_words", spans),
        T.StructField("hit_bytes", spans), T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    now = docs.select(
        *columns, utf8("text").alias("__bytes"), F.lit(None).cast(spans).alias("hit_words"),
        F.lit(None).cast("array<string>").alias("hit_items"),
    )
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "utf8"), F.lit(blocks)) == block)
        phrases = Phrases.of([(r["item"], bytes(r["utf8"])) for r in part.toLocalIterator()], window)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        last = block == blocks - 1
        out = columns if last else [*columns, "__bytes"]
        schema = T.StructType([fields.get(c, T.StructField("__bytes", T.BinaryType())) for c in out] + new)
        if clean and last:
            schema.add("clean", T.BinaryType())
        now = now.mapInArrow(tidy(_search(out, shared, clean and last)), schema)
    return now


def with_digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item numbers."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``clean``: the bytes of the text without the merged stretches; keeps doc_id and ``keep``."""
    return find_contamination(docs, benchmark, window, keep, clean=True).select("doc_id", *keep, "clean")
