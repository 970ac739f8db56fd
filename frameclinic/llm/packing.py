"""Packing token streams into training sequences by an order-preserving dynamic programme.

Each task reads its documents in order, turns them into token ids and cuts the stream into windows of at most
``length`` ids. Windows may end at document ends, at sentence ends (at a price) and, inside long sentences, anywhere on
a coarse grid (at a higher price). The best cost of ending a window at a cut is

    best(j) = min over i with c(j) - c(i) <= length of best(i) + padding(c(j) - c(i)) + price(j)

and as the padding is ``length`` less the window, the minimum is over best(i) + c(i): a monotone queue gives it in
constant time. Windows of a power of two need no padding and are looked up besides. A task holds a block of windows at
a time and hands what follows the block's last cut to the next one, so its memory does not grow with its input, and
no document is moved between tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import RollingHash, binary_values, find_words, steps, tidy, utf8

#: Prices in ids of padding: a further sequence, a cut at a sentence end, a cut inside a sentence.
SEQUENCE, SENTENCE, INSIDE = 48, 8, 64
#: At most one sentence end in so many ids is a possible cut; gaps of GRID get cuts inside sentences.
THIN, GRID = 32, 512
#: Windows of a block, and words remembered with their ids; beyond, the half not met for the longest time goes.
BLOCK, REMEMBERED = 64, 400_000
#: Bytes of words that are merged together in tables of equal width; longer words go to the tokenizer one by one.
WIDTHS = (6, 10, 16, 32, 63)
#: Bytes of texts whose new words are looked up together.
STEP_CHARS = 512 << 10
NO_SPACE, LETTER, MARK = np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool)
NO_SPACE[list(b" \t\n\r\x0b\x0c")] = False
LETTER[list(range(65, 91)) + list(range(97, 123))] = True
MARK[list(b".,!?;:")] = True


class Merges:
    """Merges of letters to tokens for many words at once, by the vocabulary's own list of merges.

    A word's next merge is its adjacent pair of least rank, the leftmost of equal ones. All words of a table take one
    step at a time; ranks and places are one number, so a step is a minimum over the table and a few look-ups.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        last = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # a table of slots for the pairs, and one more for those whose slot is taken; sizes grow until no pair is left over
        self.tables, left, bits = [], np.arange(len(pairs)), 20
        while len(left):
            table = np.zeros(1 << bits, np.int32)
            slot = self._slot(self.keys[left], bits)
            table[slot] = left
            self.tables.append((bits, table))
            left, bits = left[table[slot] != left], bits - 1
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # the byte alphabet: printable Latin-1 signs stand for themselves, the other bytes for signs from 256 on
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {x: chr(x) for x in itself} | {x: chr(256 + i) for i, x in enumerate(sorted(set(range(256)) - set(itself)))}
        self.inner = np.array([vocab[signs[x]] for x in range(256)], np.int32)
        self.final = np.array([vocab[signs[x] + last] for x in range(256)], np.int32)
        self.none = np.int32(len(pairs) << 6)

    def _slot(self, key: np.ndarray, bits: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        out = np.full(len(key), self.none)
        for bits, table in self.tables:
            rank = table[self._slot(key, bits)]
            fits = np.flatnonzero(self.keys[rank] == key)
            out[fits] = rank[fits] << 6 | place[fits]
        return out

    def merged(self, words: list[bytes], width: int) -> list[bytes]:
        """Little-endian 32-bit ids of words of one piece, none empty or longer than ``width``."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        n, place = len(words), np.arange(width, dtype=np.int32)[:, None]
        at = np.minimum(start + place, len(data) - 1)
        sign = np.where(place == size - 1, self.final[data[at]], self.inner[data[at]])
        live = place < size
        # neighbours of each place; the border places stand before the first and after the last one
        after, before = np.repeat(place + 1, n, 1), np.repeat(place - 1, n, 1)
        rank = np.full((width, n), self.none)
        x, y = np.nonzero(place < size - 1)
        rank[x, y] = self._ranks(sign[x, y], sign[x + 1, y], x.astype(np.int32))
        rows = np.arange(n)
        # from here on places are numbers of the flattened tables
        flat = [t.reshape(-1) for t in (sign, live, rank, after, before)]
        signs, lives, ranks, nexts, priors = flat
        while True:
            best = rank[:, rows].min(0) if len(rows) < n else rank.min(0)
            some = best < self.none
            rows, best = rows[some], best[some]
            if not len(rows):
                break
            at = best & 63
            here = at * n + rows
            gone = nexts[here] * n + rows
            then = nexts[gone]
            made = signs[here] = self.made[best >> 6]
            lives[gone] = False
            ranks[gone] = self.none
            nexts[here] = then
            ranks[here] = self.none
            more = np.flatnonzero(then < size[rows])
            i, t = here[more], then[more] * n + rows[more]
            priors[t] = at[more]
            ranks[i] = self._ranks(made[more], signs[t], at[more])
            prior = priors[here]
            inner = np.flatnonzero(prior >= 0)
            p = prior[inner] * n + rows[inner]
            ranks[p] = self._ranks(signs[p], made[inner], prior[inner])
        raw = sign.T[live.T].astype("<u4").tobytes()
        edge = (4 * np.concatenate([[0], np.cumsum(live.sum(0))])).tolist()
        return [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]


class WordTokenizer:
    """Token ids of texts, word by word between ASCII spaces, with the ids of words already seen remembered.

    The vocabulary's splitting never joins what such a space parts, so the ids are those of the whole text. Words of
    ASCII letters, with or without a mark behind them, are folded and told apart by 64-bit hashes like all others; new
    ones of Latin letters are merged together, the rest is the tokenizer's own work. A control string inside a text has
    its own id, as the tokenizer gives it; it is matched in its own case only.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.merges = Merges(json.loads(vocabulary)["model"])
        # words seen: sorted hashes, where their ids lie in ``flat``, how many there are, and the last step with the word
        self.keys, self.at, self.count, self.used = np.empty(0, np.uint64), *np.empty((3, 0), np.int64)
        self.flat = np.empty(0, "<u4")
        self.step = 0

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that hold no ASCII space."""
        known: dict[bytes, bytes] = {}
        plain: dict[bytes, bytes] = {}
        for w in words:
            if w.isalpha():
                plain[w] = w.lower()
            elif not w.isascii():
                # one piece, too; below U+0250 lower case and normal form are a matter of single letters
                text = w.decode("utf-8", "replace")
                if max(text) < "\u0250" and (text := text.lower()).isalpha():
                    plain[w] = text.encode()
        own = sorted((w for w in plain if len(plain[w]) <= WIDTHS[-1]), key=lambda w: len(plain[w]))
        sizes = [len(plain[w]) for w in own]
        at = 0
        for width in WIDTHS:
            stop = bisect_right(sizes, width)
            for a in range(at, stop, 8_000):
                some = own[a : min(a + 8_000, stop)]
                known.update(zip(some, self.merges.merged([plain[w] for w in some], width)))
            at = stop
        others = [w for w in words if w not in known]
        for at in range(0, len(others), 2_000):
            some = others[at : at + 2_000]
            texts = [w.decode("utf-8", "replace") for w in some]
            for w, c in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[w] = np.array(c.ids, "<u4").tobytes()
        return [known[w] for w in words]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remembers new words by their sorted hashes; words not met for the longest time are forgotten."""
        coded = self._encode(words)
        count = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.used = np.insert(self.used, place, self.step)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(coded), "<u4")])
        if len(self.keys) > REMEMBERED:
            stays = (self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]) | (self.used == self.step)
            self.keys, self.count, self.used = self.keys[stays], self.count[stays], self.used[stays]
            self.flat = self.flat[_ranges(self.at[stays], self.count)]
            self.at = np.cumsum(self.count) - self.count

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self.ids_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The same for the texts that ``offsets`` cut out of ``data``; a long text is cut at ASCII spaces on the way."""
        if len(offsets) > 2 or offsets[-1] - offsets[0] <= 2 * STEP_CHARS:
            return self._ids(data, offsets)
        parts, a, b = [], int(offsets[0]), int(offsets[-1])
        while a < b:
            stop = min(a + STEP_CHARS, b)
            while stop < b and NO_SPACE[data[stop]]:
                ahead = np.flatnonzero(~NO_SPACE[data[stop : stop + STEP_CHARS]])
                stop = stop + int(ahead[0]) if len(ahead) else min(stop + STEP_CHARS, b)
            parts += self._ids(data, np.array([a, stop]))
            a = stop
        return [b"".join(parts)]

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        self.step += 1
        data, start, stop, before = find_words(data, offsets, NO_SPACE, False)
        if not len(start):
            return [b""] * (len(offsets) - 1)
        letter = np.concatenate([[0], np.cumsum(LETTER[data])])
        last = data[stop - 1]
        tail = MARK[last] & (stop - start > 1) & (letter[stop - 1] - letter[start] == stop - 1 - start)
        plain = tail | (letter[stop] - letter[start] == stop - start)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start] += plain
        inside[stop] -= plain
        folded = data | (LETTER[data] & (np.cumsum(inside[:-1], dtype=np.int8) > 0)).view(np.uint8) << np.uint8(5)
        end = stop - tail
        keys, head, which = np.unique(RollingHash(folded).of(start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        have = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.used[place[have]] = self.step
        if not have.all():
            new = head[~have]
            raw = folded.tobytes()
            self._learn(keys[~have], [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            place = np.searchsorted(self.keys, keys)
        place = place[which]
        count = self.count[place]
        size = np.concatenate([[0], np.cumsum(count + tail)])
        out = np.empty(size[-1], "<u4")
        out[_ranges(size[:-1], count)] = self.flat[_ranges(self.at[place], count)]
        out[size[1:][tail] - 1] = self.merges.final[last[tail]]
        edge = (4 * size[before]).tolist()
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``count`` of them."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def cut_points(ids: np.ndarray, document_ends: np.ndarray, sentence_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a block (0 and its end among them) and their prices."""
    n = len(ids)
    ends = np.flatnonzero(sentence_end[np.minimum(ids, len(sentence_end) - 1)]) + 1
    ends = ends[np.concatenate([[True], ends[1:] // THIN != ends[:-1] // THIN])] if len(ends) else ends
    price = np.full(n + 1, -1, np.int32)
    price[ends] = SENTENCE
    price[document_ends] = 0
    price[0] = 0
    price[n] = max(price[n], 0) if price[n] >= 0 else INSIDE
    fine = np.arange(n, max(0, n - length), -64)  # so that the end of a stream can be cut into powers of two
    price[fine[price[fine] < 0]] = INSIDE
    at = np.flatnonzero(price >= 0)
    step = min(GRID, length)
    for a, b in zip(at[:-1][np.diff(at) > step].tolist(), at[1:][np.diff(at) > step].tolist()):
        price[a + step : b : step] = INSIDE
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, length: int, whole: bool) -> list[int]:
    """Indices of the chosen cuts, first 0; the last is the block's end if ``whole``, else the cheapest within ``length``."""
    c, p = at.tolist(), price.tolist()
    m = len(c)
    exact: list[list[int]] = [[] for _ in range(m)]
    size = 64
    while size < length:
        i = np.searchsorted(at, at - size)
        for j in np.flatnonzero(at[i] == at - size).tolist():
            exact[j].append(int(i[j]))
        size *= 2
    best, back = [0] * m, [0] * m
    queue: deque[int] = deque([0])
    keys = [0] * m
    for j in range(1, m):
        end = c[j]
        while end - c[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + length - end
        for e in exact[j]:
            if best[e] < cost:
                cost, i = best[e], e
        best[j] = cost + p[j] + SEQUENCE
        back[j] = i
        key = keys[j] = best[j] + end
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    j = m - 1
    if not whole:
        first = int(np.searchsorted(at, max(1, c[-1] - length)))
        j = min(range(max(1, first), m), key=lambda x: (best[x], -x))
    path = [j]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def _packed(length: int, end_id: int, with_ids: bool, shared):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        tokenizer = WordTokenizer(vocabulary)
        tokens = json.loads(vocabulary)["model"]["vocab"]
        sentence_end = np.zeros(max(tokens.values()) + 2, bool)
        for token, number in tokens.items():
            bare = token.removesuffix("</w>")
            sentence_end[number] = bool(bare) and set(bare) <= set(".!?") and bare != token
        stop = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        # the open part of the stream: ids not yet packed, and its documents (number, ids in all, ids packed before)
        held: list[bytes] = []
        size = 0
        docs: deque[list] = deque()

        def pack(whole: bool):
            nonlocal held, size, sequence
            raw = b"".join(held)
            ids = np.frombuffer(raw, "<u4")
            ends = np.cumsum([d[1] - d[2] for d in docs])
            at, price = cut_points(ids, ends, sentence_end, length)
            path = at[best_cuts(at, price, length, whole)].tolist()
            rows: list[tuple] = []
            for a, b in zip(path[:-1], path[1:]):
                here = a
                while here < b:
                    doc = docs[0]
                    take = min(b - here, doc[1] - doc[2])
                    part = raw[4 * here : 4 * (here + take)]
                    rows.append((doc[0], doc[2], take, zlib.crc32(part), doc[1], sequence, here - a) + (part,) * with_ids)
                    doc[2] += take
                    here += take
                    if doc[2] == doc[1]:
                        docs.popleft()
                sequence += 1
            held, size = [raw[4 * path[-1] :]], size - path[-1]
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            for a, b in steps(offsets, STEP_CHARS):
                coded = tokenizer.ids_of(data, offsets[a : b + 1])
                for doc, ids in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), coded):
                    held.append(ids + stop)
                    docs.append([doc, len(ids) // 4 + 1, 0])
                    size += len(ids) // 4 + 1
                    if size >= BLOCK * length:
                        yield pack(False)
        while size:
            yield pack(True)

    return run


def pack(
    docs: DataFrame, vocabulary_path: str, length: int = 4096, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text) in sequences of at most ``length`` ids.

    A document is the ids of its text by the vocabulary (no special tokens), then ``end_id``; a null or empty text is
    that id alone. Returns doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id and offset (the piece's place in its sequence, gapless from 0), with ``with_ids`` also the ids as
    little-endian unsigned 32-bit numbers. Repeated rows and null document numbers are packed like any other.
    The vocabulary (1.7 MB) is read by the driver and broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    schema = T.StructType([T.StructField(c, T.LongType()) for c in fields] + [T.StructField("ids", T.BinaryType())] * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(
        tidy(_packed(length, end_id, with_ids, shared)), schema
    )
