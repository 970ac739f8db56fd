import random
import re

import numpy as np
import pytest

from frameclinic.llm import decontaminate as M
from frameclinic.llm.fm_index import FMIndex, WaveletMatrix, suffix_positions
from helpers import documents, odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_suffixes_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 300):
        text = np.concatenate([rng.integers(1, 6, n), [0]])
        assert suffix_positions(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        wavelet = WaveletMatrix(text)
        at = rng.integers(0, n + 2, 40)
        symbol = rng.integers(0, text.max() + 1, 40)
        assert wavelet.rank(symbol, at).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, symbol)]
        assert wavelet.at(np.arange(n + 1)).tolist() == text.tolist()


def test_search_and_locate():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 500), [0]])
    index = FMIndex(text)
    phrases = rng.integers(1, 5, (60, 5))
    lengths = rng.integers(1, 6, 60)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(500) if text[i : i + n].tolist() == p[:n].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(rows, items, window):
    windows: dict = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((r[0], len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [M.BLOCK_BYTES, 300])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    rng = random.Random(7)
    texts = [words(rng, 40, 60) for _ in range(12)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(3, "A b c"), (None, "w1 w2"), (90, None), (91, "..."), (92, "single")]
    rows = odd_rows(rng) + [(30, "Single! one"), (31, "x W1, w2 y a B. c"), (32, "single single")]
    for i in range(40):
        t = rng.choice(texts)
        a = rng.randrange(25)
        rows.append((100 + i, ", ".join(words(rng, 20, 60) + t[a : a + rng.randrange(8, 16)] + words(rng, 5, 60)).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = M.find_contamination(documents(spark, rows), bench, 10, keep=("id", "kept")).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in found]
    assert sorted(got, key=str) == sorted(brute(rows, items, 10), key=str)
    by = {r.doc_id: r for r in M.remove_contamination(documents(spark, rows), bench, 10, keep=("lang",)).collect()}
    assert by[32].clean.decode().split() == [] and by[31].clean.decode() == "x  y "


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert M.find_contamination(documents(spark, []), bench).count() == 0
    rows = M.with_digest(M.find_contamination(documents(spark, [(1, "some words here"), (2, None)]), none)).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in sorted(rows)] == [(3, 0, 0, False), (0, 0, 0, False)]
