"""Stages of the corpus pipeline against what they stand for, each on its own input."""

import random
import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_near_copies import groups
from tests.llm.test_suffix_dedup import brute as cuts


def test_stages_in_order(spark, model_file):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "12 34 --", "en", None, 8), (None, "word salad " * 3, None, "src1", 33)], docs.schema)
    docs = docs.unionByName(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = before, rows
    before, rows = kept["language"]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in before if any(c.isalpha() for c in r.text or ""))
    before, rows = kept["near_copies"]
    assert sorted(str(r.doc_id) for r in rows) == sorted({str(c) for c in groups([(r.doc_id, r.text) for r in before])})
    before, rows = kept["repeats"]
    expected = {i: k.decode(errors="ignore") for i, _, _, _, k in cuts([(r.doc_id, r.text) for r in before], corpus_pipeline.PASSAGE_BYTES, 51)}
    assert {r.doc_id: r.text for r in rows} == expected and all(r.n_chars == len(r.text) for r in rows)
    before, rows = kept["mix"]
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
    assert abs(words(rows) / words(before) - 1.5) < 0.1 and {r.doc_id for r in rows} <= {r.doc_id for r in before}
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    texts = {r.doc_id: r.text for r in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    assert len(last) == len(rows) and all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in last)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_clashing_columns_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for c in ("Score", "kept", "target", "_size", "_aside0", "_mix_at"):
        docs = docs.withColumn(c, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert all(r.Score == r.kept == r.target == r._size == r._aside0 == r._mix_at == r.doc_id for r in rows)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_51_words_go_however_short_the_words(spark):
    """Words of one to four letters: passages of 101, 199, 201 and 400 bytes; one of 50 words stays."""
    stage = dict(corpus_pipeline.STAGES)["repeats"]
    rng = random.Random(3)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice(size))) for _ in range(n))
    passages = [words(51, [1]), words(51, [2, 3, 4]), words(51, [3]), words(51, [6, 7]), words(50, [5])]
    rows = [(10 * k + j, f"{words(30, [4, 5])} {p} {words(30, [4, 5])}") for k, p in enumerate(passages) for j in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    for k, p in enumerate(passages):
        for j in range(2):
            assert (p in texts[10 * k + j]) == (k == 4), (k, len(p))


def test_the_language_stage_tells_the_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.identify_language(spark, docs, "").collect()
    given = {r.doc_id: r.lang for r in docs.collect()}
    assert rows and sum(r.lang == given[r.doc_id] for r in rows) > 0.95 * len(rows)
    unlabelled = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), "").collect()
    assert len(unlabelled) == len(rows) and all(r.lang for r in unlabelled)
