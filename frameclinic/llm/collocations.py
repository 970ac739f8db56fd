"""Phrases whose words keep together, counted over a prefix-free parse of the corpus.

Texts are cut into chunks where their own words say so: a chunk ends where the hash of ``longest - 1`` words hits a
trigger, and the next one starts with those words. So repeated stretches give equal chunks wherever they stand, and the
corpus becomes a dictionary of distinct chunks with the number of times each is parsed. A phrase that occurs in a text lies
whole inside a chunk; one that lies in the words two chunks share belongs to the later one only. Phrases are
counted inside the distinct chunks, each times its chunk's frequency.

Longer phrases are counted only where their parts are frequent, since no phrase is more frequent than its parts. The
frequent parts are a sieve of ``SIEVE`` bits, whatever their number: a full sieve lets more through, and the exact counts
that follow decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameclinic.llm.common import RollingHash, binary_values, find_words, hash_runs, slices, steps, tidy, utf8
from frameclinic.sources.workspace import materialise

#: One in so many places of a text ends a chunk.
PERIOD = 24
#: Bits of the sieve of frequent phrases (8 MB).
SIEVE = 1 << 26
#: Bytes of chunks whose phrases are counted together in a task.
TOGETHER = 8 << 20
#: Shares of a language's candidates that are ranked apart before its best are ranked together.
SHARES = 256
#: The language of texts without one.
NO_LANGUAGE = "und"

SPLITS = np.zeros(256, bool)
SPLITS[[10, 11, 12, 13, *b".,;:!?"]] = True
WORD_BYTES = ~SPLITS
WORD_BYTES[[9, 32]] = False

Batches = Iterator[pa.RecordBatch]


def _words(data: np.ndarray, offsets: np.ndarray):
    """Bytes, starts and stops of words, words before each text, and whether each word starts a piece."""
    data, start, stop, before = find_words(data, offsets, WORD_BYTES)
    splits = np.concatenate([[0], np.cumsum(SPLITS[data])])
    opens = np.ones(len(start), bool)
    opens[1:] = splits[start[1:]] > splits[stop[:-1]]
    opens[before[:-1][before[:-1] < len(start)]] = True
    return data, start, stop, before, opens


def _chunks(overlap: int):
    """(lang, chunk, closed): words with a space, or a line end between pieces; closed chunks end with shared words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            for begin, end in steps(offsets):
                text, start, stop, before, opens = _words(data, offsets[begin : end + 1])
                if len(start) == 0:
                    continue
                hits = np.flatnonzero(hash_runs(RollingHash(text).of(start, stop), overlap) % np.uint64(PERIOD) == 0)
                row = np.searchsorted(before, hits, "right") - 1
                hits = hits[hits + overlap <= before[row + 1]]  # the trigger's words lie in one text
                heads = np.union1d(hits, before[:-1][np.diff(before) > 0])
                row = np.searchsorted(before, heads, "right") - 1
                after = np.r_[heads[1:], len(start)]
                closed = after < before[row + 1]
                last = np.where(closed, after + overlap, before[row + 1]) - 1
                # all words, each followed by what separates it from the next
                size = stop - start
                own = np.cumsum(size + 1) - (size + 1)
                at = np.repeat(start - own, size + 1) + np.arange(int((size + 1).sum()))
                flat = text[np.minimum(at, len(text) - 1)]
                flat[own + size] = np.where(np.r_[opens[1:], True], 10, 32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").take(pa.array(begin + row)),
                        slices(flat, own[heads], own[last] + size[last]).cast(pa.binary()),
                        pa.array(closed),
                    ],
                    ["lang", "chunk", "closed"],
                )

    return run


def parse(docs: DataFrame, overlap: int) -> DataFrame:
    """(lang, chunk, closed, times): the dictionary of the texts' chunks with their frequencies."""
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), utf8("text").alias("text"))
    chunks = rows.mapInArrow(tidy(_chunks(overlap)), "lang string, chunk binary, closed boolean")
    return chunks.groupBy("lang", "chunk", "closed").agg(F.count("*").alias("times"))


def _language_hash(values: pa.Array) -> np.ndarray:
    data, offsets = binary_values(values.cast(pa.binary()))
    return RollingHash(data[offsets[0] : offsets[-1]]).of(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _lanes(size: int):
    """64-bit words of the sieve with the bits of the given phrases."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = binary_values(batch.column("phrase"))
            text, start, stop, _, _ = _words(data, offsets)
            lang = batch.column("lang").dictionary_encode()
            salt = _language_hash(lang.dictionary)[lang.indices.to_numpy()] if len(lang) else np.empty(0, np.uint64)
            bit = (hash_runs(RollingHash(text).of(start, stop), size)[::size] ^ salt) % np.uint64(SIEVE)
            yield pa.RecordBatch.from_arrays(
                [pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))],
                ["lane", "bits"],
            )

    return run


def _sieve(phrases: DataFrame, size: int) -> np.ndarray:
    """The frequent phrases' bits; at most ``SIEVE`` bits reach the driver, whatever the number of phrases."""
    lanes = phrases.select("lang", "phrase").mapInArrow(tidy(_lanes(size)), "lane long, bits long")
    found = lanes.groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SIEVE >> 6, np.uint64)
    out[found["lane"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _count(size: int, overlap: int, sieve):
    """(lang, phrase, n): phrases of ``size`` words inside chunks, times the chunks' frequencies."""

    def count(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        data, offsets = binary_values(table["chunk"])
        text, start, stop, before, opens = _words(data, offsets)
        lang = table["lang"].combine_chunks().dictionary_encode()
        code = RollingHash(text).of(start, stop)
        first = np.arange(max(0, len(start) - size + 1))
        row = np.searchsorted(before, first, "right") - 1
        closed = table["closed"].to_numpy(zero_copy_only=False)
        good = first < np.where(closed, before[1:] - overlap, before[1:])[row]
        for i in range(1, size):
            good &= ~opens[i : len(first) + i]
        if size > 1:  # both parts of one word less are frequent
            salt = _language_hash(lang.dictionary)[lang.indices.to_numpy()] if len(lang) else np.empty(0, np.uint64)
            part = hash_runs(code, size - 1)
            for i in (0, 1):
                bit = (part[i : len(first) + i] ^ salt[row]) % np.uint64(SIEVE)
                good &= sieve.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0
        first, row = first[good], row[good]
        used = np.unique(first[:, None] + np.arange(size)) if size > 1 else first
        word = slices(text, start[used], stop[used]).cast(pa.binary()).dictionary_encode()
        of = np.zeros(len(start), np.int64)
        of[used] = word.indices.to_numpy()
        parts = [lang.indices.to_numpy()[row].astype(np.int64), *(of[first + i] for i in range(size))]
        pairs = [parts[i] << 32 | (parts[i + 1] if i + 1 < len(parts) else 0) for i in range(0, len(parts), 2)]
        order = np.lexsort(pairs[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for p in pairs:
            new[1:] |= np.diff(p[order]) != 0
        heads = np.flatnonzero(new)
        n = np.add.reduceat(table["times"].to_numpy()[row][order], heads) if len(heads) else np.empty(0, np.int64)
        order = order[heads]
        texts = [word.dictionary.take(pa.array(p[order])) for p in parts[1:]]
        phrase = reduce(lambda a, b: pc.binary_join_element_wise(a, b, b" "), texts)
        return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(parts[0][order])), phrase, pa.array(n)], ["lang", "phrase", "n"])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > TOGETHER:
                yield count(pa.Table.from_batches(held))
                held.clear()
        if held:
            yield count(pa.Table.from_batches(held))

    return run


def count_phrases(spark: SparkSession, chunks: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, total) of all words, and (lang, phrase, words, n) of the phrases that occur ``least`` times or more."""
    total, frequent, sieve = None, [], None
    for size in range(1, longest + 1):
        found = chunks.mapInArrow(tidy(_count(size, longest - 1, sieve)), "lang string, phrase binary, n long")
        found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            found = materialise(found, "phrases-words")
            total = found.groupBy("lang").agg(F.sum("n").alias("total"))
        found = materialise(found.where(F.col("n") >= least), f"phrases-{size}")
        frequent.append(found.withColumn("words", F.lit(size)))
        if size < longest:
            sieve = spark.sparkContext.broadcast(_sieve(found, size))
    return total, reduce(DataFrame.unionByName, frequent)


def mine_collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000) -> DataFrame:
    """Each language's ``most`` best phrases of 2 to ``longest`` words.

    A-Z count as a-z; texts are split at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words. All
    figures are per ``lang``: n counts its words; a phrase that occurs a >= ``least`` times is a candidate. Cut after k
    words, it scores floor(1000000 a a / (l r)) with l and r the counts of its parts; its lowest-scoring cut counts, the
    smallest k of equal ones. Candidates whose words lie inside a longer candidate that occurs at least ``inside`` percent
    as often are left out. Returns lang, rank (from 1: by score, then a, descending, then by the phrase's bytes), phrase,
    a, l, r, n, score.

    Null and empty texts have no words; a null lang counts as ``und``, together with texts marked so. Repeated rows count
    as often as they stand there. Texts of any length are parsed whole; one that never triggers is one chunk. Columns other
    than text and lang play no part; an empty table gives an empty table. Products are decimals of 38 digits, enough for
    counts up to 10**16.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    chunks = materialise(parse(docs, longest - 1), "phrases-chunks")
    total, counts = count_phrases(docs.sparkSession, chunks, longest, least)
    counts = counts.withColumn("phrase", F.col("phrase").cast("string"))
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substring_index(phrase, ' ', k - words)")
    )
    part = counts.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = "cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({exact}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "words").agg(lowest)
    # the phrases inside each candidate, with the most frequent candidate around them
    inner = candidates.where("words > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "words")
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("around"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    alone = scored.join(inner, ["lang", "phrase"], "left").where(f"around is null or 100 * around < {int(inside)} * a")
    # a language's best are among the best of its shares, so no task ranks all of its candidates
    place = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    shares = alone.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*place))
    best = shares.withColumn("rank", first).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*place))).where(F.col("rank") <= most)
    return best.join(total, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        F.col("total").alias("n"),
        F.col("cut.score").alias("score"),
    )
