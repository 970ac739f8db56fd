import random
from collections import Counter

import pytest

from frameclinic.llm import minhash_dedup as M
from frameclinic.llm.graph import components
from helpers import documents, odd_rows, words

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute(rows, size, percent):
    """(n_shingles, component) of each row, over all pairs that share a shingle."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having: dict = {}
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in having.get(g, ()))
        for g in s:
            having.setdefault(g, []).append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def check(spark, rows, size=4, percent=80):
    got = M.near_duplicates(documents(spark, rows), size, percent).collect()
    want = sorted(((r[0], *b, r[0] == b[1]) for r, b in zip(rows, brute(rows, size, percent))), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_odd_rows(spark):
    check(spark, odd_rows(random.Random(1)))


def test_empty_table(spark):
    assert M.near_duplicates(documents(spark, []), 4, 80).count() == 0


@pytest.mark.parametrize("edits", [4, 7, 9])
def test_large_group_around_the_threshold(spark, edits):
    """Copies of one text with changed words: some pairs are links, some just miss, all keys are large."""
    rng = random.Random(edits)
    base = words(rng, 160)
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(len(text)), rng.randrange(edits)):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(words(rng, 60) + base[:40])) for i in range(40)]  # share a passage only
    check(spark, rows)


def test_signatures_within_the_distance_always_meet():
    rng = random.Random(3)
    import numpy as np
    import pyarrow as pa

    for _ in range(50):
        a = np.array([rng.randrange(65536) for _ in range(M.SYMBOLS)], np.uint16)
        b = a.copy()
        for at in rng.sample(range(M.SYMBOLS), M.DISTANCE):
            b[at] ^= 1 + rng.randrange(65535)
        batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes(), b.tobytes()]), pa.array([1, 2])], names=["sig", "id"])
        keys: dict = {}
        for out in M._keys([batch]):
            for k, i in zip(out.column("key").to_pylist(), out.column("id").to_pylist()):
                keys.setdefault(k, set()).add(i)
        assert {1, 2} in keys.values()


def test_runs_across_batches_give_the_same_pairs():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted({(k, rng.randrange(10**6)) for k in range(40) for _ in range(rng.choice([1, 2, 5, 30, 300]))})
    whole = pa.Table.from_pylist([{"key": k, "id": i} for k, i in rows])

    def pairs(chunk):
        return {tuple(r.values()) for b in M._met(iter(whole.to_batches(max_chunksize=chunk))) for r in b.to_pylist()}

    small = {p for p in pairs(10**6) if p[0] == 0 and p[1] != p[2]}
    for chunk in (1, 7, 64):
        assert {p for p in pairs(chunk) if p[0] == 0 and p[1] != p[2]} == small
        assert {p for p in pairs(chunk) if p[0] == 1} == {p for p in pairs(10**6) if p[0] == 1}


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), "test").collect())
    want = {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert got == want
