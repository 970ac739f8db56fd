import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameclinic.llm import packing as M
from helpers import documents, odd_rows, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces(spark, rows, length=4096):
    return M.pack(documents(spark, rows).coalesce(1), PATH, length, 2, with_ids=True).toPandas()


@pytest.mark.parametrize("length", [4096, 100])
def test_every_id_in_one_piece(spark, length):
    rng = random.Random(1)
    rows = odd_rows(rng) + [(50 + i, ". ".join(" ".join(words(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(200, "İstanbul J̌ ǰ <|endoftext|> it's don't 1234 …日本語テキスト ñ"), (201, "x" * 3000)]
    rows = [r for r in rows if r[0] not in (None, 10)] + [(None, "no number"), (10, "same"), (10, "same")]
    got = pieces(spark, rows, length)
    tokenizer = Tokenizer.from_file(PATH)
    for number, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id.isna() if number is None else got.doc_id == number].sort_values(["sequence_id", "offset"])
        if number == 10:
            assert len(own) == 2 and (own.doc_tokens == len(ids)).all()
            continue
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
    assert [zlib.crc32(x) for x in got.ids] == got.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() <= length


def test_little_padding(spark):
    rng = random.Random(2)
    rows = [(i, ". ".join(" ".join(words(rng, rng.randrange(3, 20))) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    sizes = pieces(spark, rows, 4096).groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes.tolist())
    assert padding / (padding + sizes.sum()) < 0.01


def brute(at, price, length):
    """The recurrence without a queue."""
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = int(at[j] - at[i])
            if n <= length:
                free = n & (n - 1) == 0 and n >= 64
                best[j] = min(best[j], best[i] + (0 if free else length - n) + int(price[j]) + M.SEQUENCE)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        length = 128
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 60))])
        price = rng.integers(0, 3, 61) * 20
        path = M.best_cuts(at, price, length, True)
        cost = 0
        for i, j in zip(path[:-1], path[1:]):
            n = int(at[j] - at[i])
            assert 0 < n <= length
            cost += (0 if n & (n - 1) == 0 and n >= 64 else length - n) + int(price[j]) + M.SEQUENCE
        assert path[0] == 0 and path[-1] == 60 and cost == brute(at, price, length)


def test_empty_table(spark):
    assert len(pieces(spark, [])) == 0


def test_control_strings_have_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from frameclinic.llm.packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), WordTokenizer(open(path, encoding="utf-8").read())
    texts = ["hello <|endoftext|> there", "hello<|endoftext|>there", "<|startoftext|>abc", "<|ENDOFTEXT|> x", "a <|endoftext|>. B<|startoftext|><|endoftext|>!",
             "<|endoftext|", "É<|endoftext|>É, <|EndOfText|>.", "<| endoftext |>", "Case? CASE! case."]
    coded = own.ids([t.encode() for t in texts])
    for text, ids in zip(texts, coded):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_words_merged_together_have_the_tokenizers_ids(monkeypatch):
    """New words of many kinds, remembered or forgotten again, in short texts and in one long text."""
    rng = random.Random(12)
    plain, own = Tokenizer.from_file(PATH), M.WordTokenizer(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(M, "REMEMBERED", 500)
    monkeypatch.setattr(M, "STEP_CHARS", 3_000)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFG"

    def word():
        w = "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 13, 40, 63, 64, 70])))
        return w + rng.choice(["", "", "", ".", ",", "!?", "'s", "é", "ß", "İ", "ﬁ", "9", "日本", "́", "\x00", "<|endoftext|>", "<|EndOfText|>."])

    texts = ["".join(word() + rng.choice([" ", "\n", "\t ", " ", "\x1f"]) for _ in range(rng.randrange(120))) for _ in range(80)]
    texts += [" ".join(texts), "x" * 9_000 + " " + "y." * 5_000, "", " ", ".", "a", "aa" * 30 + " aaaa aaa aa"]
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [own.ids([t.encode()])[0] for t in texts] == expected
    assert own.ids([t.encode() for t in texts]) == expected
    assert len(own.keys) < 20_000
