import random

import pytest

from quarrylens.llm import tokenize_corpus as tk

SCHEMA = "doc_id long, text string, ids string, n_chars long"


def encoder():
    with open(tk.DEFAULT_VOCABULARY, "rb") as f:
        return tk._encoder(f.read())


def check(spark, texts, chunk, overlap):
    d = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.ids for r in tk.encode_corpus(d, chunk_chars=chunk, overlap=overlap).collect()}
    want = {i: encoder().encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert got == want


def test_defined_cases(spark):
    check(spark, [None, "", " ", "\n\n", "a", "<|endoftext|> stays text", "한국어와 日本語 🙂 e\u0301", "a", "a"], 16384, 256)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 16)])
def test_chunks_are_exact(spark, chunk, overlap):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgäß  \n\t'.,;12345漢字🙂") for _ in range(rng.randrange(1, 9)))
    check(spark, ["".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(40)], chunk, overlap)


def test_no_boundary_in_the_overlap(spark):
    check(spark, ["x" * 500, "a " + "y" * 300 + " b c d " * 30, " " * 400, "x" * 30 + " " * 200 + "z"], 50, 10)


def test_round_trip():
    t = "Grüße an alle — 日本 🙂\r\n\tx = 1"
    assert tk.decode(encoder().encode_ordinary(t)) == t


def test_empty_table(spark):
    assert tk.encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0
