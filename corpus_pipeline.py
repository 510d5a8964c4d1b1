"""A training corpus from raw documents, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, ngram_join, piece_codec, suffix_dedup
from tessera.llm.common import MADE, discard_since, stored, table, unused


#: Passages of more words than this that occur elsewhere are cut; no passage of 51 words has fewer bytes than 51 letters and 50 spaces.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 101


def beside(docs: DataFrame, outputs: tuple[str, ...], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What made() gives of the documents, in their columns; those named like one of its outputs are kept out of its way."""
    clashing = [c for c in docs.columns if c.lower() in outputs]
    aside = dict(zip(clashing, unused(docs, *(f"_aside{k}" for k in range(len(clashing)))), strict=True))
    return made(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others have the language that their text is in, whatever they were labelled."""
    samples = language.learn(docs.where(F.coalesce(language.remainder(F.col("doc_id"), 4) != 2, F.lit(True))))

    def told(d: DataFrame) -> DataFrame:
        known = language.identify(d, samples).where(F.col("lang_pred") != "und")
        return known.withColumn("lang", F.col("lang_pred")) if "lang" in d.columns else known

    return beside(docs, ("lang_pred", "score", "phrase_rate"), told)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that share four fifths of their runs of five words, or more."""
    return ngram_join.representatives(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over PASSAGE_WORDS words, and repeated strings that are as long, go from the texts; what a cut leaves of a character goes with it. Every document stays, if with less text."""
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))

    def cut(d: DataFrame) -> DataFrame:
        spans = suffix_dedup.dedup(d, as_text=True, length=PASSAGE_BYTES, words=PASSAGE_WORDS + 1)
        if "n_chars" in d.columns:
            spans = spans.withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
        return spans.withColumn("text", text)

    return beside(docs, ("n_bytes", "n_removed", "n_spans", "spans", "kept"), cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    size = unused(docs, "_size")[0]
    return beside(docs, ("source_size", "target", "repeats"), lambda d: mixing.repeated(mixing.mix(d.withColumn(size, mixing.n_words(F.col("text"))), size=size)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each document's text."""
    import public_tokenizers

    coded = piece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Most stages are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Each stage's rows are a table for the next one; what it was made of is deleted."""
    docs = table(spark, sf_dir, "documents")
    mark = len(MADE)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
