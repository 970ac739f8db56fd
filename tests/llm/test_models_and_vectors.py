import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.llm import language_id as L
from frameclinic.llm import pivot_index as V
from frameclinic.llm import toxicity as T
from helpers import documents, odd_rows

SYLLABLES = {"en": "the th er on an re he in ed nd".split(), "de": "der sch ein ung ich en te ch zu ver".split(), "es": "que de la os ción as ar ez ia no".split()}


def prose(rng, lang, n, insult=None):
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    if insult:
        out[rng.randrange(n)] = insult
    return " ".join(out)


def labelled(seed, n):
    rng = random.Random(seed)
    langs = sorted(SYLLABLES)
    return [(i, prose(rng, langs[i % 3], rng.randrange(10, 60)), langs[i % 3]) for i in range(n)]


def test_languages_of_held_out_texts(spark):
    docs = documents(spark, labelled(1, 600) + [(900, "some text", None), (None, "der sch ein", "de")])
    filters = L.learn(docs.where(L.remainder(4) != 2))
    assert filters.languages == ["de", "en", "es"]
    got = L.predict(docs.where(L.remainder(4) == 2), filters, ("doc_id", "lang"))
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1


def test_odd_languages(spark):
    filters = L.learn(documents(spark, labelled(2, 300)))
    rows = odd_rows(random.Random(3)) + [(50, "1234 ... ###"), (51, "日本語"), (52, "½ ² é")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(documents(spark, rows), filters).collect()}
    for number in (1, 2, 3, 12, 50):
        assert got[number] == ("und", 0.0)
    assert got[51][0] in filters.languages and got[52][0] in filters.languages and len(got) == len({r[0] for r in rows})
    none = L.learn(documents(spark, []))
    assert {r.lang_pred for r in L.predict(documents(spark, rows), none).collect()} == {"und"}
    assert L.predict(documents(spark, []), filters).count() == 0


def test_filters_return_every_language_of_a_gram():
    grams = {"a": np.arange(0, 3000, dtype=np.uint32), "b": np.arange(1500, 4500, dtype=np.uint32)}
    f = L.Filters.of(grams, {"a": 1, "b": 1})
    for bit, name in enumerate(f.languages):
        found = f.rows[L._slot(grams[name], L._PROBES[0])]
        for probe in L._PROBES[1:]:
            found = found & f.rows[L._slot(grams[name], probe)]
        assert ((found >> bit) & 1).all()
    assert (f.false_share < 0.01).all()


def test_any_number_of_languages(spark):
    """150 spellings of three languages, and a table that grows with the n-grams."""
    rows = [(i, text, f"{lang}-{i % 50:02d}") for i, text, lang in labelled(6, 900)]
    filters = L.learn(documents(spark, rows))
    assert len(filters.languages) == 150 and filters.rows.shape == (1 << 16, 3)
    got = L.predict(documents(spark, rows), filters, ("lang",)).collect()
    assert np.mean([r.lang[:2] == r.lang_pred[:2] for r in got]) > 0.98
    grams = {f"{k:03d}": np.arange(k * 700, k * 700 + 700, dtype=np.uint32) for k in range(130)}
    grams["all"] = np.arange(91_000, dtype=np.uint32)
    f = L.Filters.of(grams, dict.fromkeys(grams, 1))
    assert len(f.rows) == 1 << 20 and (f.false_share < 0.1).all()
    for number, name in enumerate(f.languages):
        found = [f.rows[L._slot(grams[name], probe, 20), number // 64] for probe in L._PROBES]
        assert ((found[0] & found[1] & found[2]) >> np.uint64(number % 64) & np.uint64(1)).all()


def test_decisions_do_not_depend_on_the_step(monkeypatch):
    grams = {"en": np.frombuffer(b"the his ", np.uint32), "de": np.frombuffer(b"der sich", np.uint32)}
    f = L.Filters.of(grams, {"en": 1, "de": 2})
    raw = [b"the his the", b"", b"der", b"sich sich", b"12", b"zzzzzz"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    whole = f.decide(data, offsets)
    monkeypatch.setattr(L, "COUNTS", 4)
    for a, b in zip(whole, f.decide(data, offsets)):
        assert (a == b).all()


def test_ngrams_stay_inside_texts():
    texts = ["abc", "", "ab  c!d", "éa", "x", "wxyz"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    codes, edges = L.ngrams(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [[int(c).to_bytes(4, "little") for c in codes[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    assert got == [[], [], [b"ab c", b"b c ", b" c d"], [], [], [b"wxyz"]]


def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    langs = sorted(SYLLABLES)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        rows.append((i, prose(rng, langs[i % 3], rng.randrange(8, 50), rng.choice(["idiot", "moron"]) if toxic else None), langs[i % 3]))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows + odd_rows(rng)[:3])
    table = spark.createDataFrame([*labels, (700, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs.where(L.remainder(5) != 0), table.where(L.remainder(5) != 0))
    got = T.score_toxicity(docs.where(L.remainder(5) == 0), model).join(table, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got.score.between(0, 1).all()
    odd = T.score_toxicity(documents(spark, odd_rows(rng)), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd) and len(odd) == 14
    assert T.score_toxicity(documents(spark, []), model).count() == 0
    nothing = T.fit(docs, table.limit(0))
    assert {round(r.score, 3) for r in T.score_toxicity(docs, nothing).collect()} == {0.5}


def test_scores_equal_the_plain_convolution():
    rng = np.random.default_rng(5)
    net = T.Network.start(rng)
    texts = [rng.integers(1, 1 << T.TABLE_BITS, n) for n in (0, 1, 2, 5, 40)]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = T.Scorer(net, net.tables()).logits(np.concatenate(texts), edge)
    for t, found in zip(texts, got):
        rows = np.concatenate([t, np.zeros(max(T.WIDTHS), np.int64)])
        hidden = []
        for w, kernel, bias in zip(T.WIDTHS, net.kernels, net.bias):
            answers = [sum(net.embedding[rows[i + k]] @ kernel[k] for k in range(w)) + bias for i in range(len(t) + max(T.WIDTHS) - w + 1)]
            hidden.append(np.maximum(np.max(answers, axis=0), 0))
        assert found == pytest.approx(np.concatenate(hidden) @ net.weight + net.offset, abs=1e-4)


def brute_links(rows, least):
    ok = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float) / np.linalg.norm(v)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least_id: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[find(i)] = min(least_id.get(find(i), r[0]), r[0])
    return [(r[0], links[i], least_id.get(find(i)), r[0] == least_id.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("kind, block", [("float", 8192), ("double", 50)])
def test_vectors_against_brute_force(spark, monkeypatch, kind, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        base = rng.normal(size=24) if i % 10 else np.ones(24)
        rows += [(3 * i + k, (base + rng.normal(size=24) * 0.1 * k).astype(np.float32).tolist()) for k in range(3)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, None] + [1.0] * 22), (5004, [float("nan")] * 24)]
    rows += [(5005, [float("inf")] + [0.0] * 23), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e-30] * 24), (None, [1.0] * 24)]
    rows += [rows[4], rows[4]]
    table = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, id int")
    got = V.similar_vectors(table, 0.9).collect()
    want = brute_links(rows, 0.9)
    found, there = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.97 * there
    same = sum(tuple(r) == w for r, w in zip(sorted(got, key=str), sorted(want, key=lambda w: str(V_row(w)))))
    assert len(got) == len(want) and same >= 0.97 * len(want)
    odd = {r.vec_id: tuple(r) for r in got if r.vec_id is not None and 5000 <= r.vec_id <= 5005}
    assert odd == {n: (n, 0, n, True) for n in range(5000, 5006)}
    assert V.similar_vectors(table.limit(0)).count() == 0


def V_row(w):
    from pyspark.sql import Row

    return Row(vec_id=w[0], n_links=w[1], component_id=w[2], kept=w[3])


def test_blocks_and_sample_bounded_by_bytes(spark, monkeypatch):
    """Small byte bounds change neither the links nor the components."""
    rng = np.random.default_rng(31)
    centre = rng.normal(size=(4, 24))
    rows = [(i, (centre[i % 4] + 0.05 * rng.normal(size=24)).tolist()) for i in range(240)] + [(900, None), (901, [0.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, V.similar_vectors(table).collect()))
    monkeypatch.setattr(V, "BLOCK_BYTES", 24 * 8 * 17)
    assert sorted(map(tuple, V.similar_vectors(table).collect())) == want
    assert {r[1] for r in want if r[0] < 900} == {59} and {r[2] for r in want} == {0, 1, 2, 3, 900, 901}
    monkeypatch.setattr(V, "SAMPLE_BYTES", 24 * 8 * 30)
    assert V.choose_pivots(table)[24].shape == (V.PIVOTS, 24)
