import random

import pytest
import tiktoken

from quillon.llm.encode import Tokenizer, decoded, stitch, text_pieces, token_counts, token_ids

S = "doc_id long, text string, doc int, t string, ids int"


def texts():
    r = random.Random(7)
    words = ["index", "the", " ", "  \n", "'s", "don't", "Größe", "索引很大。", "ход", "🙂", "\t", "12345", "<|endoftext|>", "...", "é"]
    long = "".join(r.choice(words) + r.choice(["", " "]) for _ in range(3000))
    return [None, "", " ", "\n\n", "short text", long, "a" * 3000, " " * 3000, "x" * 900 + " " * 900 + long, "索" * 2500, "'" * 1500 + "s" * 1500, "\r\n" * 1200]


@pytest.fixture(scope="module")
def enc(spark):
    t = Tokenizer(spark)
    return t.get()


@pytest.mark.parametrize("chunk,overlap", [(200, 50), (997, 64), (32768, 1024)])
def test_ids_counts_and_round_trip(spark, enc, chunk, overlap):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts())], S)
    out = token_ids(df, chunk=chunk, overlap=overlap)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts())}
    assert {r.doc_id: r.tokens for r in token_counts(df, chunk=chunk, overlap=overlap).collect()} == {i: len(x) for i, x in got.items()}
    assert {r.doc_id: r.text for r in decoded(out).collect()} == {i: t or "" for i, t in enumerate(texts())}


def test_long_texts_are_really_cut(spark):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts())], S)
    n = {r.doc: r["count"] for r in text_pieces(df, chunk=200, overlap=50).groupBy("doc").count().collect()}
    assert n[5] > 20 and n[6] == 1 and n[4] == 1 and n[0] == 1


def test_blank_lines_before_a_chunk(spark, enc):
    cases = ["ab cd " * 3 + blanks + "foo bar baz " * 5 for blanks in ("\n\n", "\n\t", " \u3000")]  # the second chunk starts at foo
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(cases)], S)
    assert {r.doc_id: r.ids for r in token_ids(df, chunk=20, overlap=16).collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(cases)}
    assert text_pieces(df, chunk=20, overlap=16).groupBy("doc").count().where("count < 2").isEmpty()


def test_stitch_stops_without_agreement():
    assert stitch([([], [10, 12]), ([12, 15], [30]), ([31], [40]), ([40], [])]) == [12]


def test_same_as_the_other_library(spark, enc):
    from tokenizers import Tokenizer as T

    t = T.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in texts():
        assert t.encode(x or "", add_special_tokens=False).ids == enc.encode_ordinary(x or "")


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert token_ids(df).count() == token_counts(df).count() == 0
    assert tiktoken is not None


def test_other_kinds_of_vocabulary_are_refused(spark):
    with pytest.raises(ValueError):
        token_ids(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer="word_bpe_49k")
