"""The registered queries against SQL, and what the pipeline's stages promise."""

from pathlib import Path

import pytest

import corpus_pipeline as P
from compare import connect, differences
from frameclinic.llm.oracle import ORACLE
from frameclinic.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name], tolerance=0.0) == []


def _rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_pipeline_stages(spark):
    """Each stage on a small table with known cases: what must go goes, clean documents stay as they are."""
    import random

    from helpers import documents, words

    rng = random.Random(1)
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    clean = {i: " ".join(words(rng, 80, 10**5)) for i in range(20)}
    passage = " ".join(words(rng, 70, 10**5))
    rows = [(i, t) for i, t in clean.items()] + [(30, clean[3]), (31, clean[4] + " end"), (40, None), (41, "12 34 ..."), (None, clean[7])]
    rows += [(50 + i, f"{' '.join(words(rng, 40, 10**5))}. {passage} {' '.join(words(rng, 40, 10**5))}") for i in range(3)]
    rows += [(60, f"before it {bench[0]} after it"), (61, bench[1])]
    docs = documents(spark, rows)
    stages = dict(P.STAGES)
    one = stages["language_id"](spark, docs, FOLDER)
    assert one.columns == P.COLUMNS and set(_rows(one)) == {r[0] for r in rows} - {40, 41}
    two = stages["minhash_dedup"](spark, one, FOLDER)
    # a row without a number never stands for a group that has one
    assert two.columns == P.COLUMNS and set(_rows(two)) == {r[0] for r in rows} - {40, 41, 30, 31, None}
    three = stages["suffix_dedup"](spark, two, FOLDER)
    kept = _rows(three)
    assert three.columns == P.COLUMNS and set(kept) == set(_rows(two))
    assert all(kept[i].text == clean[i] and kept[i].n_chars == len(clean[i]) for i in clean)
    assert all(passage not in kept[50 + i].text and len(kept[50 + i].text) > 80 for i in range(3))
    four = stages["decontamination"](spark, three, FOLDER)
    last = _rows(four)
    assert four.columns == P.COLUMNS and all(last[i].text == clean[i] for i in clean)
    assert last[60].text.startswith("before it ") and last[60].text.rstrip(" .").endswith("after it") and bench[0][20:80] not in last[60].text
    assert 61 not in last or not any(c.isalnum() for c in last[61].text)
    five = stages["packing"](spark, four, FOLDER).toPandas()
    assert set(five.doc_id) == set(last) and (five.groupby("sequence_id").length.sum() <= 4096).all()
    for _, s, f in ((n, s, dict(P.STAGES)[n]) for n, s in P.STAGES):
        assert f(spark, docs.limit(0), FOLDER).count() == 0


def test_whole_pipeline(spark):
    packed = P.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 0 < packed.select("doc_id").distinct().count() <= docs.count()


def test_cut_characters_are_dropped_and_others_kept(spark):
    rows = [(1, bytearray("ä ok".encode()[1:])), (2, bytearray("ok � é".encode())), (3, bytearray(b"\xc3")), (4, bytearray(b""))]
    docs = spark.createDataFrame(rows, "doc_id long, b binary").selectExpr("*", "'en' lang", "'s' source", "'' text", "0L n_chars")
    assert {r.doc_id: (r.text, r.n_chars) for r in P._replaced(docs, "b").collect()} == {1: (" ok", 3), 2: ("ok � é", 6)}


def test_one_row_of_each_group_whatever_its_number(spark):
    """Null and repeated numbers with different texts: texts of their own stay, each group keeps exactly one row."""
    import random

    from helpers import documents, words

    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join(words(rng, 80, 10**5)) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (None, c + " end"), (2, d), (3, d), (3, e), (4, f), (4, f), (4, f + " end"),
            (5, None), (5, None), (None, " "), (None, " ")]
    got = P.drop_near_duplicates(spark, documents(spark, rows), FOLDER)
    assert got.columns == P.COLUMNS
    short = sorted(((r.doc_id, (r.text or "").removesuffix(" end")) for r in got.collect()), key=str)
    assert short == sorted([(1, a), (None, b), (None, c), (2, d), (3, e), (4, f), (5, ""), (5, ""), (None, " "), (None, " ")], key=str)
