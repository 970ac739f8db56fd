"""Language identification with bit-sliced Bloom filters over n-grams.

One table holds the filters of all languages: bit l of a row belongs to language l, and a row has as many 64-bit
words as the languages need. It has 2**16 rows, or more if a language has more n-grams than fill these to an eighth
per probe. An n-gram's three rows, and-ed, are the set of languages that may contain it. A text's n-grams are looked
up together, counted per language, and the counts are corrected for the share of false positives of each language's
filter; the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.llm.common import binary_values, steps, tidy, utf8
from frameclinic.sources.workspace import small_table

GRAM, ROW_BITS = 4, 16
#: Counts of texts times languages that one step of a decision holds.
COUNTS = 1 << 21
_PROBES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
UNKNOWN = "und"

# letters in lower case, everything else a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Filters:
    """The learned table: ``rows`` of words of language bits, the languages in ascending order, their false-positive shares."""

    languages: list[str]
    rows: np.ndarray
    false_share: np.ndarray
    most_frequent: int

    @staticmethod
    def of(grams: dict[str, np.ndarray], documents: dict[str, int]) -> Filters:
        languages = sorted(grams)
        most = max(map(len, grams.values()), default=0)
        row_bits = max(ROW_BITS, (8 * most - 1).bit_length())
        word = 64 if len(languages) > 8 else 8
        words = max(1, -(-len(languages) // word))
        rows = np.zeros((1 << row_bits, words), np.uint64 if word == 64 else np.uint8, order="F")
        full = np.zeros(len(languages))
        for number, language in enumerate(languages):
            column, bit = rows[:, number // word], rows.dtype.type(1 << number % word)
            for probe in _PROBES:
                column[_slot(grams[language], probe, row_bits)] |= bit
            full[number] = np.count_nonzero(column & bit)
        top = max(range(len(languages)), key=lambda b: (documents[languages[b]], -b), default=0)
        return Filters(languages, rows, (full / len(rows)) ** len(_PROBES), top)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and of them those of each language, false positives taken out."""
        codes, owner_edges = ngrams(data, offsets)
        total = np.diff(owner_edges)
        out = np.zeros((len(total), len(self.languages)))
        some = np.flatnonzero(total)
        kind, word = self.rows.dtype.type, self.rows.dtype.itemsize * 8
        slots = [_slot(codes, probe, len(self.rows).bit_length() - 1) for probe in _PROBES]
        for number in range(len(self.languages) if len(some) else 0):
            if number % word == 0:
                column = self.rows[:, number // word]
                found = column[slots[0]] & column[slots[1]] & column[slots[2]]
            hit = (found >> kind(number % word)) & kind(1)
            out[some, number] = np.add.reduceat(hit, owner_edges[some], dtype=np.int64)
        out = (out - total[:, None] * self.false_share) / (1 - np.minimum(self.false_share, 0.999))
        return total, np.maximum(out, 0)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1: no letter) and the language's share of all languages' counts."""
        if not self.languages:
            return np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        room = max(1, COUNTS // len(self.languages))
        if len(offsets) - 1 > room:
            parts = [self.decide(data, offsets[a : a + room + 1]) for a in range(0, len(offsets) - 1, room)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, counts = self.counts(data, offsets)
        every = counts.sum(axis=1)
        best = np.where(every > 0, counts.argmax(axis=1), self.most_frequent)
        score = np.where(every > 0, counts.max(axis=1) / np.maximum(every, 1e-9), 0.0)
        lettered = has_letter(data, offsets)
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def _slot(codes: np.ndarray, probe: np.uint32, row_bits: int = ROW_BITS) -> np.ndarray:
    return ((codes ^ (codes >> np.uint32(15))) * probe) >> np.uint32(32 - row_bits)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams as 32-bit codes and each text's edges among them; case folded, all but letters one space."""
    part = _FOLD[data[offsets[0] : offsets[-1]]]
    begin = offsets - offsets[0]
    blank = part == 32
    keep = np.ones(len(part), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[begin[:-1][begin[:-1] < len(part)]] = True
    edges = np.concatenate([[0], np.cumsum(keep)])[begin]
    part = part[keep].astype(np.uint32)
    if len(part) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    n = len(part) - GRAM + 1
    codes = part[:n] | part[1 : n + 1] << 8 | part[2 : n + 2] << 16 | part[3 : n + 3] << 24
    inside = np.ones(n + GRAM, bool)
    for back in range(1, GRAM):
        at = edges[1:] - back
        inside[at[at >= edges[:-1]]] = False
    inside = inside[:n]
    return codes[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(edges, n)]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    part = data[offsets[0] : offsets[-1]]
    before = np.concatenate([[0], np.cumsum(ascii_letter[part])])[offsets - offsets[0]]
    out = np.diff(before) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each language contain an n-gram, summed over a step."""
    for batch in batches:
        data, offsets = binary_values(batch.column("text"))
        language = batch.column("lang").to_numpy(zero_copy_only=False)
        for a, b in steps(offsets):
            codes, edges = ngrams(data, offsets[a : b + 1])
            text = np.repeat(np.arange(b - a), np.diff(edges))
            once = np.unique(text.astype(np.int64) << 32 | codes)
            for name in sorted(set(language[a:b])):
                own = language[a:b][once >> 32] == name
                grams, n = np.unique(once[own] & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"]
                )


def learn(docs: DataFrame, per_language: int = 2_000, grams: int = 8_000) -> Filters:
    """Filters from the labelled rows of ``docs`` (doc_id, text, lang).

    Learns from about ``per_language`` texts of each language, chosen by the digest of their number: the bound of
    the sample. Each language gets its ``grams`` n-grams that stand in the most texts, so all filters are equally
    full (ties by code). Every distinct value of lang is a language, however many there are. Rows with a null text or
    language are left out.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters.of({}, {})
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    shares = small_table(docs.sparkSession, [(language, min(1.0, per_language / n)) for language, n in sizes.items()], schema)
    rows = rows.join(F.broadcast(shares), "lang")
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = (
        drawn.select(utf8("text").alias("text"), "lang")
        .mapInArrow(tidy(_document_grams), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = (F.desc("n"), "gram")
    for share in (F.pmod("gram", F.lit(16)), F.lit(0)):  # in shares of a language first
        place = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
        counts = counts.withColumn("place", place).where(F.col("place") <= grams)
    top = counts.select("lang", "gram").toPandas()
    best = {language: np.empty(0, np.uint32) for language in sizes}
    best.update((language, own.to_numpy(np.uint32)) for language, own in top.groupby("lang")["gram"])
    return Filters.of(best, sizes)


def _predicted(columns: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        names = np.array([*filters.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = binary_values(batch.column("__utf8"))
            best, score = [], []
            for a, b in steps(offsets):
                one, two = filters.decide(data, offsets[a : b + 1])
                best.append(one), score.append(two)
            label = names[np.concatenate(best)] if best else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(label, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())],
                names=[*columns, "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with lang_pred and score (0 to 1).

    Only the whole text decides. A null text and one without a letter is ``und`` with score 0; a text whose n-grams
    no language has gets the most frequent language and score 0; ties go to the first language by name. Without any
    learned language all rows are ``und``. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(*keep, utf8("text").alias("__utf8"))
    schema = T.StructType(
        [*rows.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(tidy(_predicted(list(keep), shared)), schema)


def remainder(modulus: int):
    """crc32 of the document number's decimal text, modulo ``modulus``; null for a null number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
