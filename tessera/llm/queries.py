"""One query for each operator of this package, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, spread, stored, table


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_codec import round_trip_digests

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integers, search

    vectors = integers(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, n_words

    sized = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn, remainder

    docs = spread(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    samples = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_column

    return media_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import remainder
    from .quality import featured, learn, scored

    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known, model = learn(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality"))
    result = scored(stored(featured(docs, known=known), "quality-features"), model)
    return result.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract

    return extract(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans", text)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import leaf, prove

    docs = table(spark, sf_dir, "documents")
    digest = lambda text: leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    was = docs.select("lang", "doc_id", digest(F.col("text")).alias("leaf"), F.when(changed, digest(lowered)).alias("lowered"))
    rows = prove(was.withColumn("claimed", F.coalesce("lowered", "leaf")), "lang", "doc_id", "leaf", "claimed")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduped, kept_text

    docs = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))
