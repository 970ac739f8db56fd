"""Shared passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, odd_rows, words
from pyspark.sql import functions as F

from frameclinic.llm import substring_trees as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size):
    """For each row (doc_id, text): words, words that go, and what is kept."""
    first = {}
    split = [(2**63 - 1 if d is None else d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, d), d)
    out = []
    for (d, w), (number, *_) in zip(split, rows):
        gone = {p for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for p in range(i, i + size)}
        out.append((number, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def found(spark, rows, size=13):
    got = S.remove_shared_passages(documents(spark, rows), words=size, keep=("lang", "n_words"))
    assert got.columns == ["doc_id", "lang", "n_words", "n_removed", "kept_text"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text).decode()) for r in got.collect()), key=str)


def passages(rng):
    """Shared passages in many contexts, near and exact copies, repeats within a document, small vocabularies."""
    common = words(rng, 40, 10**6)
    rows = [(100 + i, " ".join(words(rng, rng.randrange(30), 10**6) + common[rng.randrange(5) : 40 - rng.randrange(5)] + words(rng, 15, 10**6))) for i in range(60)]
    base = words(rng, 120, 10**6)
    for i in range(40):
        near = list(base)
        near[rng.randrange(120)] = "x"
        rows.append((300 + i, "  ".join(near)))
    rows += [(500 + i, "\n".join(base)) for i in range(3)] + [(600, "\n".join(base)), (600, "\n".join(base))]
    rows += [(700 + i, " ".join(words(rng, 60, 2))) for i in range(20)] + [(800, " ".join(["a"] * 300)), (801, " ".join(["a"] * 13))]
    rows += [(None, " ".join(base)), (None, " ".join(base[:60])), (None, " ".join(words(rng, 20, 10**6))), (5, " ".join(base[30:70]))]
    return rows


@pytest.mark.parametrize("size", [4, 13])
def test_brute_force(spark, size):
    rng = random.Random(size)
    rows = passages(rng) + odd_rows(rng)
    assert found(spark, rows, size) == brute(rows, size)


def test_crowded_prefixes_fall_apart_into_suffixes(spark, monkeypatch):
    """With room for three strings a prefix, the passage's edges are dealt out under longer prefixes: same answer."""
    monkeypatch.setattr(S, "GROUP", 3)
    rows = passages(random.Random(7))
    assert found(spark, rows) == brute(rows, 13)


def test_runs_cover_every_window_once_in_pieces_too(monkeypatch):
    """Pieces only cut runs; each window keeps its seed, and equal windows have equal seeds."""
    rng = random.Random(2)
    long = words(rng, 400, 12)
    texts = [" ".join(long), "", "a b", " ".join(long[70:300]), " ".join(words(rng, 13, 5))]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    by_piece = []
    for piece in (S.PIECE, 50):
        monkeypatch.setattr(S, "PIECE", piece)
        seeds = {}
        for seed, text, head, tail in zip(*(found := S.Words(data, offsets)).runs(13)):
            for i in range(head, tail + 1):
                assert (text, i - found.before[text]) not in seeds
                seeds[text, i - found.before[text]] = seed
        assert set(seeds) == {(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 12)}
        assert all(seeds[3, i] == seeds[0, i + 70] for i in range(218))
        by_piece.append(seeds)
    assert by_piece[0] == by_piece[1]


def test_subtrees_hold_all_suffixes_in_order():
    strings = pa.array([b"b a n a n a s", b"a n a n a x", b"b a n a n a s"], pa.binary())
    row, place, shared = S.subtrees(np.array([1, 1, 2]), strings, 4)
    texts = [strings[int(r)].as_py().split()[p : p + 4] for r, p in zip(row, place)]
    assert len(row) == 4 + 3 + 4 and sorted(zip(row, place)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    for i in range(1, len(row)):
        same = (row[i] == 2) == (row[i - 1] == 2)
        n = next((k for k in range(4) if texts[i][k] != texts[i - 1][k]), 4)
        assert shared[i] == (n if same else 0)


def test_empty_table_and_small_windows(spark):
    assert S.remove_shared_passages(documents(spark, [(1, "x")]).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        S.remove_shared_passages(documents(spark, [(1, "x")]), words=3)
