"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
from helpers import documents, odd_rows, words

from frameclinic.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def brute(rows, longest, least, most=2000, inside=50):
    out = []
    by_lang = {}
    for _, text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).extend(pieces(text))
    for lang, some in by_lang.items():
        f = Counter(tuple(w[i : i + k]) for w in some for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in some)
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        around = {}
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i : i + k]] = max(around.get(g[i : i + k], 0), a)
        scored = []
        for g, a in cand.items():
            if 100 * around.get(g, -1) >= inside * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(scored[:most])]
    return sorted(out)


def corpus(rng):
    rows = []
    line = "The quick, brown fox. Jumps over! the lazy\tdog\nagain and again;and again"
    for i in range(300):
        text = " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}{rng.choice(['', '', '', '.', ',', '!?'])}" for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    rows += [(500 + i, f"{line} {i}", "en") for i in range(30)] + [(600 + i, line, "fr") for i in range(12)]
    rows += [(700, "ha " * 500, "en"), (701, "É é Ä ä É é ß" * 40, "de"), (None, line, ""), (None, None, None)]
    return rows + [(r[0], r[1], "en") for r in odd_rows(rng)]


def found(spark, rows, **options):
    return sorted(tuple(r) for r in C.mine_collocations(documents(spark, rows), **options).collect())


def test_brute_force(spark):
    rows = corpus(random.Random(4))
    assert found(spark, rows, longest=3, least=10) == brute(rows, 3, 10)
    assert found(spark, rows, longest=4, least=4, most=7, inside=80) == brute(rows, 4, 4, 7, 80)
    assert found(spark, rows, longest=2, least=2) == brute(rows, 2, 2)


def test_exact_beyond_64_bits(spark):
    """The score's products, as the query writes them, pass 64 bits."""
    a, l, r = 10**13 + 7, 10**13 + 9, 3 * 10**13 + 1
    row = spark.sql(f"SELECT (cast(1000000 as decimal(38,0)) * cast({a}L as decimal(19,0)) * cast({a}L as decimal(19,0))) div (cast({l}L as decimal(19,0)) * cast({r}L as decimal(19,0))) s")
    assert row.first().s == 10**6 * a * a // (l * r)


def test_chunks_overlap_and_cover(spark):
    """Laid side by side without their shared words, a text's chunks give the text's words and pieces back."""
    rng = random.Random(9)
    texts = [" ".join(words(rng, 300, 50)) + ". " + ", ".join(words(rng, 100, 50)), "", "one", "a. b"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "z", "q"]), pa.array([t.encode() for t in texts])], ["lang", "text"])
    chunks = [r for b in C._chunks(2)(iter([batch])) for r in b.to_pylist()]
    for lang, text in zip("xyzq", texts):
        mine = [c for c in chunks if c["lang"] == lang]
        back = []
        for i, c in enumerate(mine):
            w = re.findall(rb"[^ \n]+[ \n]?", c["chunk"])
            assert c["closed"] == (i < len(mine) - 1) and (not c["closed"] or len(w) >= 3)
            back += [x.strip() for x in (w[:-2] if c["closed"] else w)]
        assert [x.decode() for x in back] == [x for p in pieces(text) for x in p]
    assert len(chunks) > 10 and len(offsets) == 5 and len(data)


def test_empty(spark):
    assert found(spark, [(1, None, None), (2, "", "en")]) == []
    assert C.mine_collocations(documents(spark, [(1, "x", "en")]).limit(0)).count() == 0
