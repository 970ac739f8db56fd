import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameclinic.llm import suffix_dedup as M
from frameclinic.llm.lyndon import suffix_order
from helpers import documents, odd_rows, words


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_suffix_order(text):
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [b"a" * 500, b"ab" * 300, bytes(range(200)) * 3, b"mississippi" * 20, b""])
def test_suffix_order_of_regular_texts(text):
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, width=200):
    seen: dict = {}
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(spark, rows):
    got = M.remove_repeats(documents(spark, rows), keep=("mark", "lang")).drop("mark", "lang").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(rows))]
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(want, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(words(rng, n)) for n in (30, 60, 90, 400)]
    rows = []
    for i in range(200):  # enough for anchors that are hot within a step
        parts = [" ".join(words(rng, rng.randrange(80)))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece) // 3 + 1)
            parts += [piece[cut:], " ".join(words(rng, rng.randrange(50)))]
        rows.append((i, "é".join(parts)))
    rows += [(500, "a" * 1000), (501, "b" * 450), (502, "ab" * 150), (503, shared[1]), (504, shared[1]), (505, shared[3] * 2)]
    return rows


def test_passages(spark):
    check(spark, passages(1))


def test_large_cores_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 1)
    check(spark, passages(2))


def test_odd_rows(spark):
    check(spark, odd_rows(random.Random(5)) + [(20, "y" * 199), (21, "y" * 199), (None, "z" * 300), (None, "z" * 300)])


def test_empty_table(spark):
    assert M.remove_repeats(documents(spark, [])).count() == 0


def test_long_texts_give_the_same_anchors_as_short_ones():
    """A text in pieces, the same text whole, and the same among others."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 3_300_000).astype(np.uint8).tobytes()

    def rows(texts):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int32()), pa.array(texts, pa.binary())],
            names=["doc_id", "mark", "text"],
        )
        return [r for r in pa.Table.from_batches(list(M._anchor_rows(200)([batch]))).to_pylist() if r["kind"] == M.PLAIN]

    part = text[1_000_000:1_040_000]
    long = {r["spot"] & 0xFFFFFFFF: (r["anchor"], r["block"]) for r in rows([text])}
    short = {r["spot"] & 0xFFFFFFFF: (r["anchor"], r["block"]) for r in rows([b"x" * 50, part, b""]) if r["doc_id"] == 1}
    inner = {at: x for at, x in short.items() if 400 < at < 39_000}
    assert inner and all(long[at + 1_000_000] == x for at, x in inner.items())


def test_anchors_in_parts_settle_the_same(monkeypatch):
    """Rows of one anchor beyond what is held: settled blocks stay settled or become open, none is lost."""
    rng = random.Random(9)
    rows = sorted((rng.choice([1, 2, 3, 4]), rng.randrange(40), i, i, 0) for i in range(300))
    table = pa.Table.from_pylist([dict(zip(("anchor", "block", "doc_id", "spot", "kind"), r)) for r in rows])

    def found(chunk):
        return pa.Table.from_batches(list(M._sorted_anchors(iter(table.to_batches(max_chunksize=chunk))))).to_pylist()

    whole = found(1000)
    assert found(17) == whole or sorted(map(str, found(17))) == sorted(map(str, whole))
    monkeypatch.setattr(M, "HOLD", 20)
    parts = found(10)
    settled = {r["spot"] for r in parts if r["settled"]}
    opened = {r["spot"] for r in parts if not r["settled"]}
    for r in whole:
        assert r["spot"] in settled | opened


def test_signs_keep_single_rows_open():
    names = ("anchor", "block", "doc_id", "spot", "kind")
    rows = [(1, 0, None, 0, M.SIGN), (1, 5, 10, 11, M.PLAIN), (2, 6, 10, 12, M.PLAIN), (3, 7, 10, 13, M.DEALT),
            (4, 8, 10, 14, M.DEALT), (4, 8, 11, 15, M.DEALT), (5, 0, None, 0, M.SIGN), (5, 0, None, 0, M.SIGN)]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    for chunk in (1, 3, 100):
        found = pa.Table.from_batches(list(M._sorted_anchors(iter(table.to_batches(max_chunksize=chunk))))).to_pylist()
        assert {r["spot"] for r in found if not r["settled"]} == {11, 13, 14}
        assert {r["spot"] for r in found if r["settled"]} == {14, 15}


def test_settled_copies_meet_a_copy_dealt_out_elsewhere(spark):
    """An anchor that is hot in one step: the copy there is dealt out, the two copies of other batches settle each other."""
    rng = random.Random(4)
    low = 0
    while not 60 <= low <= 100:  # every window of the text has the same anchor
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=260))
        low = int(np.argmin(M.RollingHash(np.frombuffer(text.encode(), np.uint8)).every(M.ANCHOR)))

    def around(i):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=150))

    hot = [(i, around(i) + text[low - 30 : low + 130] + around(i)) for i in range(60)] + [(100, text)]
    rows = hot + [(101, text), (102, text)] + [(200 + i, "short") for i in range(len(hot) - 2)]
    slices = spark.sparkContext.parallelize(rows, 2)
    docs = spark.createDataFrame(slices, "doc_id long, text string")
    got = M.remove_repeats(docs).where("doc_id between 100 and 102").collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(100, 260), (101, 260), (102, 260)}


@pytest.mark.parametrize("most", [20, 150])
def test_equal_strips_of_a_common_core_are_not_gathered(spark, monkeypatch, most):
    """A passage in very many texts whose surroundings differ: no group to order grows with their number."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=330))

    def around():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(40, 90)))

    rows = [(i, around() + passage[rng.randrange(9) :][: rng.randrange(305, 331)] + around()) for i in range(300)] + passages(7)
    ordered = M._ordered

    def limited(width):
        def run(batches):
            met = {}

            def seen():
                for b in batches:
                    for group in zip(b.column("core").to_pylist(), b.column("part").to_pylist()):
                        met[group] = met.get(group, 0) + 1
                    yield b
                    if max(met.values(), default=0) > 2 * most + 40:
                        raise ValueError("too many strips are ordered together")

            yield from ordered(width)(seen())

        return run

    monkeypatch.setattr(M, "TOGETHER", most)
    monkeypatch.setattr(M, "_ordered", limited)
    check(spark, rows)


def test_anchors_at_the_end_of_a_long_text(spark):
    """The text ends shortly after a piece would begin: its last anchors lie in that piece."""
    rng = np.random.default_rng(1)
    before, last = 0, 0
    while last < 1 << 21 or before + 200 >= len(text):  # no earlier anchor reaches the end
        text = rng.integers(97, 123, (1 << 21) + 150).astype(np.uint8)
        before, last = M.anchors(M.RollingHash(text).every(M.ANCHOR), 101)[-2:]
    text = text.tobytes().decode()
    got = M.remove_repeats(documents(spark, [(1, text), (2, text)])).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(len(text), len(text))] * 2


def test_a_block_in_all_batches_is_sent_once_a_task(spark):
    """A passage in all texts: the rows that meet in one task grow with the tasks, not with the texts."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=700))
    rows = [(i, " ".join(words(rng, 3)) + passage + " ".join(words(rng, 3))) for i in range(3_000)]
    table = pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "mark": pa.array([0] * len(rows), pa.int32()),
            "text": pa.array([r[1].encode() for r in rows], pa.binary()),
        }
    )
    sent = pa.Table.from_batches(list(M._anchor_rows(200)(iter(table.to_batches(max_chunksize=500))))).to_pandas()
    sent = sent[sent.kind != M.DONE]
    assert sent.groupby(["anchor", "block"]).size().max() == 1 and (sent.kind % M.MANY == M.DEALT).any()
    assert (sent.kind >= M.MANY).sum() < 20
    check(spark, rows[:300] + [(5000 + i, passage[i * 100 :]) for i in range(6)] + passages(9))
