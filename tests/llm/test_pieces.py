"""Encoding and decoding against the library, on fixtures and random texts."""

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import piece_codec

PARTS = ["▁", " ", "  ", "        ", "a", "th", "e", "é", "\n", "\t", "<0x41>", "<s>", "</s>", "<unk>", "日本", "𝒳", " ", "�", "ﬁ", "é", "\x00", "0", "99", '"', "ing", "ation"]


@pytest.fixture(scope="module")
def both(model_file):
    return piece_codec.PieceCodec(model_file), sentencepiece.SentencePieceProcessor(model_file=model_file)


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6).filter(lambda s: s.isprintable())), max_size=25))
def test_encodes_and_decodes_like_the_library(both, parts):
    own, library = both
    text = "".join(parts)
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(3, 258), st.integers(0, 31_999)), max_size=9))
def test_decodes_any_ids_like_the_library(both, ids):
    own, library = both
    assert own.decode(ids) == library.decode(ids)


def test_long_words_take_linear_time(both):
    own, library = both
    text = "abab" * 50_000
    assert own.encode(text) == library.encode(text)


def test_tokens_are_the_merges(both):
    own, _ = both
    for word in ("▁international", "▁▁▁x", "zzzz", "▁naïveté"):
        assert own.tokens(word) == own.merged(word)


def test_operators_keep_columns_and_handle_edges(spark, docs, model_file):
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    coded = piece_codec.decode(piece_codec.encode(docs.withColumnRenamed("score", "n_tokens"), model_file), model_file)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_tokens", "ids", "decoded"]
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    for r in piece_codec.round_trip_digests(docs, model_file).collect():
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_codec.encode(docs.limit(0), model_file).count() == 0


def test_clashing_names_and_an_empty_table(spark, model_file):
    df = spark.createDataFrame([(1, "some text", 7)], "doc_id long, text string, n int")
    clashing = df.selectExpr("*", "1 AS N_TOKENS", "2 AS IDS", "3 AS Decoded", "4 AS Ids_SHA256")
    got = piece_codec.round_trip_digests(clashing, model_file)
    assert got.columns == ["doc_id", "text", "n", "IDS", "Decoded", "n_tokens", "ids_sha256", "decoded_sha256"] and got.select("n_tokens").first()[0] > 1
    coded = piece_codec.encode(clashing, model_file)
    assert coded.columns == ["doc_id", "text", "n", "N_TOKENS", "Decoded", "Ids_SHA256", "ids"]
    back = piece_codec.decode(coded, model_file)
    assert back.columns[-1] == "decoded" and "Decoded" not in back.columns and back.select("decoded").first()[0] == "some text"
    assert piece_codec.round_trip_digests(clashing.limit(0), model_file).count() == 0 == piece_codec.encode(clashing.limit(0), model_file).count()


def test_the_round_trip_decodes_as_decode_does(model_file):
    rng = random.Random(12)
    own = piece_codec.codec(model_file)
    pieces = ["the", " ", "  ", "\n", "é", "日本", "\U0001f600", "a", "ing", ".", ",", "\t", "\u00a0", "▁", "1", "X", "\x00", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        n, ids, decoded = own.round_trip(text)
        coded = own.encode(text)
        assert n == len(coded) and ids == ",".join(map(str, coded)) and decoded == own.decode(coded)
