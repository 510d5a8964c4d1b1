"""Cross-parsing against a plain implementation, held-out accuracy, edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language, queries


def plain_phrases(text, index):
    """Greedy longest matches with a substring search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in index:
            size += 1
        at += size
        n += 1
    return n


def plain_index(symbols):
    return "".join(map(chr, symbols))


def check_phrases(samples, texts):
    parser = language.CrossParser(samples)
    symbols = [parser.symbols(t) for t in texts]
    rates = parser.rates(symbols)
    for k, name in enumerate(parser.names):
        index = plain_index(parser.symbols(samples[name]))
        for s, r in zip(symbols, rates[:, k], strict=True):
            assert round(r * len(s) / parser.scale[k]) == plain_phrases(plain_index(s), index)


def test_phrases_equal_greedy_matches():
    random.seed(5)
    samples = {"a": "".join(random.choice("abc ") for _ in range(300)), "b": "".join(random.choice("bcd ") for _ in range(300))}
    check_phrases(samples, ["".join(random.choice("abcde ") for _ in range(random.randrange(1, 500))) for _ in range(40)])


def test_long_texts_are_not_cut():
    random.seed(6)
    samples = {"a": "the cat sat on the mat " * 20, "b": "".join(random.choice("cat on") for _ in range(900))}
    check_phrases(samples, ["the cat sat " * 300, "x", "".join(random.choice("cat onz") for _ in range(3000)), *["the mat " * k for k in range(1, 40)]])


def test_every_letter_of_the_sample_counts():
    random.seed(7)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)] + ["\U00020000", "\U00020001"]
    samples = {"zh": "".join(random.choice(signs) for _ in range(4000)), "en": "some plain words " * 30}
    parser = language.CrossParser(samples)
    assert len(set(parser.symbols("".join(sorted(set(samples["zh"])))).tolist())) == len(set(samples["zh"])) + 1
    check_phrases(samples, [samples["zh"][100:1500], "".join(random.choice(signs) for _ in range(500)), "plain words"])


def test_packed_moves_are_the_automaton():
    random.seed(8)
    moves = language.automaton([random.choice([0, 2, 3, 4, 5, 6, 7]) for _ in range(3000)])
    base, owner, target = language.packed(moves, 9)
    for state, to in enumerate(moves):
        for c in range(9):
            slot = base[state] + c
            assert (target[slot] if owner[slot] == state else None) == to.get(c, 0 if state == 0 else None)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark, docs):
    samples = language.learn(docs)
    assert samples.names == ["en", "fr"]
    got = language.identify(docs, samples).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert {r.lang_pred for r in language.identify(docs, language.CrossParser({})).collect()} == {"und"}
    assert language.identify(docs.limit(0), samples).count() == 0
    assert language.learn(docs.withColumn("lang", F.lit(None).cast("string"))).names == []
    clash = language.identify(docs.withColumnRenamed("score", "Score").withColumn("_lang", F.lit(2)), samples)
    assert clash.columns == ["doc_id", "text", "lang", "source", "_lang", "lang_pred", "score", "phrase_rate"] and clash.count() == docs.count()


def test_every_part_of_a_long_text_is_learned(spark):
    rows = [(k, "header " * 400 + "".join("abcdefghij"[(k * 7 + i) % 10] for i in range(6000)), "en") for k in range(20)] + [(100 + k, "une copie", "fr") for k in range(90)]
    got = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = {name: 2 ** scale for name, scale in zip(got.names, got.scale, strict=True)}
    assert n["en"] > 10 * 8_000 and n["fr"] < 12
    assert got.rates([got.symbols(rows[3][1][5000:6000])])[0, 0] < got.rates([got.symbols("k" * 500)])[0, 0]


def test_rows_of_one_id_stay_within_the_bound(spark):
    rows = [(1, f"text number {'abcdefghij'[k % 10] * (k % 37)}", "en") for k in range(3000)] + [(2, "une copie", "fr")]
    got = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs=5)
    assert got.names == ["en", "fr"] and 2 ** got.scale[0] <= 5 * 60


def test_chosen_texts_are_learned_whole_and_once(spark):
    """Texts far above and below 2,048 characters, copies, empty ones: each distinct text with a letter is a text of the sample."""
    random.seed(11)
    words = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short = words(4000), words(20)
    rows = [(1, long, "x"), (2, short, "x"), (3, "", "x"), (4, None, "x"), (5, "12 34", "x")] + [(10 + k, long, "x") for k in range(200)] + [(300 + k, words(30), "y") for k in range(70)]
    parser = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert parser.names == ["x", "y"]
    pieces = [long[k : k + 300] for k in range(0, len(long) - 300, 1710)] + [short, long]
    counts = [round(r[0] * len(parser.symbols(p)) / parser.scale[0]) for r, p in zip(parser.rates([parser.symbols(p) for p in pieces]), pieces, strict=True)]
    assert counts == [1] * len(pieces)
    symbols = len(parser.symbols(long + "\n" + short))
    assert parser.scale[0] == np.log2(symbols)
